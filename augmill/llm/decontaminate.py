"""Benchmark decontamination: BM25 over the test items, searched by block-max WAND.

The inverted index holds the test items: word -> postings (item, impact). An impact is the
word's BM25 weight in the item over the item's own total, so that a passage holding the
whole item scores 1. Items longer than the passage step can show only a part of
themselves at once, so their total is scaled to that part. Every stretch of a document is
a query: passages of ``PASSAGE`` words that begin every ``STEP`` words, so that any ``STEP``
words in a row lie within one. An item's *essential* words are its rarest, so many that its
others weigh less than ``COMMON`` together: a passage can reach the threshold for the item
only if its essential words there weigh ``THRESHOLD - COMMON``. The lists of essential words
are added up for all passages at once; those that some item can still reach go through
block-max WAND over the whole lists, which finds all items at or above ``THRESHOLD``.
Each hit is verified: of the item's question and of its answer (the last sentence; the
second half, if there is one sentence), the share of word 3-grams that the passage and as
many words as the item has, ``STEP`` at least, on either side hold must reach ``OVERLAP``;
so a whole copy of an item of any length is found.

The items are indexed in blocks of at most ``BLOCK_TERMS`` postings, a table in the shared
folder. One block after the other is fetched, broadcast, met by every document, and released
when its hits are stored, so the driver and the executors hold one block however many
items there are. Document frequencies and lengths are those of all items.

Edge cases: a null or empty text matches nothing; items without words match nothing;
repeated items give a row each; repeated documents give rows each; items with a null id
are indexed and reported under null; empty tables give an empty result. Only the ids and
texts are read, so other columns may clash.
"""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .common import SpanHash, byte_values, chunks, discard, mix, runs, shared_path, stored, text_buffer
from .registry import register

PASSAGE, STEP = 160, 80
THRESHOLD = 0.6
OVERLAP = 0.5
COMMON = 0.35
K1, B = 1.2, 0.75
BLOCK_TERMS = 2_000_000
#: Postings of a block of a list, for its maximum.
POSTINGS = 32

_C = np.arange(256)
_WORD = ((_C >= 48) & (_C <= 57)) | ((_C >= 65) & (_C <= 90)) | ((_C >= 97) & (_C <= 122)) | (_C >= 128)
_LOWER = np.where((_C >= 65) & (_C <= 90), _C + 32, _C).astype(np.uint8)
_VALUES = byte_values(9)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word: a run of letters and digits, lower-cased."""
    start, end, row = runs(_WORD[data], offs)
    return SpanHash(_LOWER[data], _VALUES)(start, end), row


def text_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def grams(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of the word n-grams; of the whole sequence, if it is shorter."""
    n = max(min(n, len(h)), 1)
    x = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        x = mix(x + h[k : k + len(x)])
    return x


def question_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words of the question and of the answer."""
    parts = [w for x in _SENTENCE.split(text) if len(w := text_words(x))]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    w = parts[0] if parts else np.empty(0, np.uint64)
    return w[: len(w) // 2], w[len(w) // 2 :]


class Index:
    """Inverted index of a block of items, with block maxima."""

    def __init__(self, ids: list, texts: list[str], lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``lists``: per item its distinct words, sorted, their counts, and their idf; ``ids`` in order."""
        self.ids, self.needs = ids, []
        for t in texts:
            q, a = question_answer(t)
            self.needs.append((len(q), grams(q), len(a), grams(a)))
        post: dict[int, list[tuple[int, float]]] = {}
        essential: dict[int, list[tuple[int, float]]] = {}
        for k, (w, impact, _) in enumerate(lists):
            for word, x in zip(w.tolist(), impact.tolist(), strict=True):
                post.setdefault(word, []).append((k, x))
        for k, (w, impact, idf) in enumerate(lists):
            rest = float(impact.sum())
            for i in np.lexsort((w, -idf)):
                if rest < COMMON:
                    break
                essential.setdefault(int(w[i]), []).append((k, float(impact[i])))
                rest -= float(impact[i])
        self.keys = np.array(sorted(post), np.uint64)
        rare = [essential.get(k, []) for k in self.keys.tolist()]
        self.rare = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int64)
        self.rare_item = np.array([i for x in rare for i, _ in x], np.int64)
        self.rare_impact = np.array([v for x in rare for _, v in x])
        self.lists = []
        for k in self.keys.tolist():
            items, impacts = zip(*post[k], strict=True)
            ends = list(range(POSTINGS - 1, len(items), POSTINGS))
            if not ends or ends[-1] != len(items) - 1:
                ends.append(len(items) - 1)
            self.lists.append((items, impacts, max(impacts), [items[e] for e in ends],
                               [max(impacts[e - e % POSTINGS : e + 1]) for e in ends]))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the index knows, and which they are."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(46)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]

    def reachable(self, block: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """Blocks of words that, with the block after, hold essential words of ``least`` weight of some item; the
        block before a row's first may be among them."""
        lists = self.rare[term + 1] - self.rare[term]
        where = np.repeat(np.arange(len(term)), lists)
        post = np.arange(len(where)) - np.repeat(np.cumsum(lists) - lists, lists) + self.rare[term][where]
        key, at = np.unique(block[where] * len(self.ids) + self.rare_item[post], return_inverse=True)
        weight = np.bincount(at, self.rare_impact[post], minlength=len(key))
        after = np.searchsorted(key, key + len(self.ids))
        more = np.where(key[np.minimum(after, len(key) - 1)] == key + len(self.ids), weight[np.minimum(after, len(key) - 1)], 0) if len(key) else weight
        # the block before may hold common words of the item alone; where it holds essential ones it has a key of its own
        found = np.concatenate([key[weight + more >= least], key[weight >= least] - len(self.ids)])
        return np.unique(found[found >= 0] // max(len(self.ids), 1))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over ``terms`` sum to the threshold at least, by block-max WAND."""
        end, out = len(self.ids), []
        cursors = [[self.lists[t][0][0], 0, *self.lists[t]] for t in terms]  # item, place, items, impacts, max, block ends, maxima
        while True:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                bound += c[4]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, upto = 0.0, end
            for c in cursors[: pivot + 1]:
                b = c[1] // POSTINGS
                while b < len(c[5]) and c[5][b] < item:
                    b += 1
                if b < len(c[5]):
                    bound += c[6][b]
                    upto = min(upto, c[5][b] + 1)
            if pivot + 1 < len(cursors):
                upto = min(upto, cursors[pivot + 1][0])
            if bound < threshold:  # no item before the next block's end can do
                target = max(upto, item + 1)
            elif cursors[0][0] == item:
                total = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                if total >= threshold:
                    out.append((item, total))
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                i, items = c[1], c[2]
                while i < len(items) and items[i] < target:
                    i += 1
                c[0], c[1] = (items[i] if i < len(items) else end), i


def index_blocks(items: DataFrame) -> tuple[DataFrame | None, int]:
    """(block, index): a pickled index for each block of items, stored, and the number of blocks; words,
    frequencies and blocks are Spark's work."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "item_key", F.xxhash64("item_id", "text"))

    def terms(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            h, row = words(data, offs)
            key = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(h.view(np.int64))], names=["item_key", "word"])

    word = rows.select("item_key", "text").dropDuplicates().mapInArrow(terms, "item_key bigint, word bigint")
    tf = word.groupBy("item_key", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    length = tf.groupBy("item_key").agg(F.sum("tf").alias("len"))
    n, mean, postings = length.join(tf.groupBy("item_key").agg(F.count("*").alias("terms")), "item_key").agg(
        F.count("*"), F.avg("len"), F.sum("terms")).first()
    if not n:
        return None, 0
    blocks = math.ceil(postings / BLOCK_TERMS)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    weights = tf.join(df, "word").join(length, "item_key").select("item_key", "word", idf.alias("idf"), weight.alias("weight"), "len")
    lists = weights.groupBy("item_key").agg(F.collect_list(F.struct("word", "weight", "idf")).alias("words"), F.max("len").alias("len"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["item_key"], kind="stable")
        lists = []
        for entries, length in zip(part["words"], part["len"], strict=True):
            w = np.array([x["word"] for x in entries], np.int64).view(np.uint64)
            order = np.argsort(w)
            x = np.array([x["weight"] for x in entries])[order]
            lists.append((w[order], x / (x.sum() * min(1.0, STEP / length)), np.array([x["idf"] for x in entries])[order]))
        ids = [None if pd.isna(x) else int(x) for x in part["item_id"]]
        return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "index": [pickle.dumps(Index(ids, list(part["text"]), lists))]})

    made = rows.join(lists, "item_key").withColumn("block", F.pmod("item_key", F.lit(blocks))).groupBy("block").applyInPandas(
        build, "block bigint, index binary")
    return stored(made, "item-index"), blocks


def _search_rows(index: Index, data: np.ndarray, offs: np.ndarray, threshold: float, overlap: float):
    """(row, item, score, question overlap, answer overlap, first word) of a chunk of texts, the best passage of each."""
    h, row = words(data, offs)
    at, term = index.terms(h)
    if not len(at):
        return
    first = np.searchsorted(row, np.arange(len(offs)))
    # words in blocks of STEP, an empty block after each row; a passage is a block and the one after
    blocks = -(-np.diff(first) // STEP) + 1
    start = np.cumsum(blocks) - blocks
    block = start[row[at]] + (at - first[row[at]]) // STEP
    passages = index.reachable(block, term, threshold - COMMON - 1e-9)
    owner = np.searchsorted(start, passages, "right") - 1
    inside = passages - start[owner] < blocks[owner] - 1  # not the empty block after a row
    passages, owner = passages[inside], owner[inside]
    best: dict[tuple[int, int], tuple] = {}
    for r, p in zip(owner.tolist(), passages.tolist(), strict=True):
        lo = int(first[r] + (p - start[r]) * STEP)
        hi = min(lo + PASSAGE, int(first[r + 1]))
        a, b = np.searchsorted(at, (lo, hi))
        known = np.unique(term[a:b])
        for item, score in index.search(known.tolist(), threshold):
            nq, q, na, answer = index.needs[item]
            reach = max(STEP, nq + na)
            near = h[max(lo - reach, int(first[r])) : min(hi + reach, int(first[r + 1]))]
            have = {n: grams(near, n) for n in {max(min(3, nq), 1), max(min(3, na), 1)}}
            share = lambda g, n: float(np.isin(g, have[max(min(3, n), 1)]).mean()) if len(g) else 1.0
            found = (score, share(q, nq), share(answer, na), lo - int(first[r]))
            if min(found[1:3]) >= overlap and found[:3] > best.get((r, item), (0.0,))[:3]:
                best[r, item] = found
    for (r, item), found in best.items():
        yield r, item, *found


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row per document and test item that it holds: (doc_id, item_id, score, question_overlap,
    answer_overlap, first_word), from the best passage. The call itself searches and stores the hits."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint"
    texts = docs.select("doc_id", F.col("text"))

    def searched(index):
        def work(batches):
            ix = pickle.loads(index.value)
            for batch in batches:
                data, offs = text_buffer(batch.column(1))
                ids, out = batch.column(0), []
                for lo, hi in chunks(offs):
                    for r, item, *found in _search_rows(ix, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], threshold, overlap):
                        out.append((ids[lo + r].as_py(), ix.ids[item], *found))
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        return texts.mapInArrow(work, schema)

    table, blocks = index_blocks(items)
    if table is None:
        return spark.createDataFrame([], schema)
    path = shared_path(spark, "leaks")
    for block in range(blocks):
        row = table.where(F.col("block") == block).select("index").first()
        if row is not None:
            index = spark.sparkContext.broadcast(bytes(row[0]))
            searched(index).write.mode("append").parquet(path)
            index.destroy()
    discard(table)
    return spark.read.schema(schema).parquet(path)


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(load(spark, sf_dir, "documents"), "doc_id"), load(spark, sf_dir, "benchmark"))
