"""Lexicon operators (L1-L3).

The reference looks synonyms up in WordNet. Here the resource is an input table
``(word, lemma)``; :func:`lexicon_from_contexts` derives one from the corpus
itself (distributional neighbours), and any user table of the same shape can be
passed instead.

L3 definition: a context is the (left, right) neighbour pair of a token, and its words have
their counts in it. Every (context, word) draws ``draws`` partners among the context's other
words, each as likely as it is frequent there: no word is beyond reach, whatever its rank. A
word's partners are scored by the number of draws they were met in, and the best ``top``
(score desc, partner asc), the stated size of a lexicon entry, become its lemmas.

The tokens of a context are counted where the texts are, meet in one group and are drawn from in the order
of the running counts (:mod:`augmill.operators.running`): neither draws nor intervals are rows that
move, and the pairs drawn are added up per word before they leave the task. Contexts are drawn from many at a
time, by arrays. The number of groups grows with the text, so that a task holds the tokens of a few MB
of it and a bounded number of pairs, and where pairs meet, the partners of one word.
"""

from __future__ import annotations

import hashlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from augmill.functions import draws as D
from augmill.functions import text as T
from augmill.functions.md5 import draws as drawn
from augmill.operators.running import DIGITS, duck_running


def context_triples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lft, word, rgt) for every interior token of the cleaned text."""
    w = docs.select(T.split_nonempty(T.clean_letters(F.col(text_col))).alias("w")).where(F.size("w") >= 3)
    n = F.size("w") - 2
    z = F.arrays_zip(F.slice("w", F.lit(1), n).alias("lft"), F.slice("w", F.lit(2), n).alias("word"),
                     F.slice("w", F.lit(3), n).alias("rgt"))
    return w.select(F.explode(z).alias("t")).select("t.lft", "t.word", "t.rgt")


def context_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lft, rgt, word, cnt), dealt out by context: what is asked of a context needs no other exchange."""
    tokens = context_triples(docs, text_col).repartition("lft", "rgt")
    return tokens.groupBy("lft", "rgt", "word").agg(F.count(F.lit(1)).alias("cnt"))


#: Bits a context has in the map of those asked for, and bits of a piece of the map.
BITS, PIECE = 16, 1 << 22


def asked_only(counts: DataFrame, contexts: DataFrame, n: int | None = None) -> DataFrame:
    """``counts`` (lft, rgt, ...) of the n given contexts (lft, rgt), and of few others: most of what nobody asks for is
    left out by a bit map of the contexts' hashes before it moves. The rest goes with the join that follows."""
    n = contexts.count() if n is None else n
    size = max(PIECE, 1 << (BITS * max(n, 1) - 1).bit_length())
    slot = F.pmod(F.xxhash64("lft", "rgt"), F.lit(size))

    def bits(t: pa.Table) -> pa.Table:
        at = t["slot"].to_numpy()
        held = np.zeros(PIECE // 8, np.uint8)
        np.bitwise_or.at(held, (at % PIECE) >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table({"piece": pa.array([int(at[0]) // PIECE]), "held": pa.array([held.tobytes()], pa.binary())})

    pieces = contexts.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / PIECE).alias("_p")).applyInArrow(bits, "piece bigint, held binary").collect()
    held = {r["piece"]: bytes(r["held"]) for r in pieces}
    held = b"".join(held.get(k, bytes(PIECE // 8)) for k in range(size // PIECE))

    @F.arrow_udf(BooleanType())
    def asked(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((np.frombuffer(held, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return counts.where(asked(slot))


#: Partners that a (context, word) draws, and lemmas of a lexicon entry.
DRAWS, TOP = 8, 8
#: Bytes of text and characters of added-up partners that a task takes at once, text of a group of contexts (a power of 2), tokens drawn for together.
CHUNK, TEXT, GROUP, TOKENS = 1 << 23, 1 << 23, 22, 1 << 18
#: Groups of contexts at least.
GROUPS = 32
_LETTERS = bytes(x if 97 <= x <= 122 else 32 for x in range(256))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _cleaned(text: bytes) -> bytes:
    """The letters of :func:`augmill.functions.text.clean_letters`, other bytes being spaces."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").replace("\u2019", "").lower().encode()
    return text.lower().translate(_LETTERS, b"'")


def _keyed(lft: np.ndarray, rgt: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, object]:
    """A number per (lft, rgt, word), in their order, and what takes numbers back apart; of n words, whatever n is."""
    pairs, known = lft * n + rgt, None
    if n >= 1 << 21:
        known, pairs = np.unique(pairs, return_inverse=True)

    def apart(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = key // n if known is None else known[key // n]
        return pair // n, pair % n, key % n

    return pairs * n + word, apart


def _triples(groups: int):
    """(grp, tokens): "lft rgt word count ..." of the tokens of many texts, by group of contexts."""

    def of_texts(texts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        letter = data > 32
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        text = np.searchsorted(np.flatnonzero(data == 10), begin)
        offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[letter])).dictionary_encode()
        words, t = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        n = len(words)
        inner = np.flatnonzero(text[2:] == text[:-2])
        key, apart = _keyed(t[inner], t[inner + 2], t[inner + 1], n)
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, cnt = key[first], np.diff(np.append(first, len(key)))
        left, right, word = apart(key)
        crc = np.array([crc32(x.encode()) for x in words.to_pylist()], np.uint64)
        grp = (((crc[left] * _ODD[0]) ^ (crc[right] * _ODD[1])) * _ODD[0] >> np.uint64(33)).astype(np.int64) % groups
        order = np.argsort(grp.astype(np.uint16 if groups <= 1 << 16 else np.int64), kind="stable")
        often, place = np.unique(cnt[order], return_inverse=True)
        named = pa.concat_arrays([words, pa.array(often).cast(pa.string())])
        flat = named.take(pa.array(np.stack([left[order], right[order], word[order], n + place], axis=1).ravel()))
        own, start = np.unique(grp[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)) * 4, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pc.binary_join(lists, " ")], ["grp", "tokens"])

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                if text.is_valid:
                    held.append(_cleaned(text.as_py()))
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield of_texts(held)
                        held, size = [], 0
        if held:
            yield of_texts(held)

    return work


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _added_up(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    return key[begin], np.add.reduceat(n[order], begin) if len(key) else n


def _partners(draws: int, seed: int):
    """(word, partners): "partner count" of the contexts of a group."""
    places = [str(k).encode() for k in range(draws)]

    def of_contexts(words: pa.Array, lft: np.ndarray, rgt: np.ndarray, w: np.ndarray, cnt: np.ndarray, begin: np.ndarray) -> pa.Table:
        """Whole contexts, one after another from ``begin`` on, each with two words or more, in order."""
        n, size = len(words), np.diff(np.append(begin, len(cnt)))
        two = begin[size == 2]  # each has but the other to draw
        keys = [w[two] * n + w[two + 1], w[two + 1] * n + w[two]]
        times = [np.full(2 * len(two), draws, np.int64)]
        more = np.repeat(size > 2, size)
        if more.any():
            c = np.repeat(np.arange(len(size)), size)[more]
            own, place = np.unique(w[more], return_inverse=True)
            digits = np.array([int(hashlib.md5(x.encode(), usedforsecurity=False).hexdigest()[:DIGITS], 16) for x in words.take(pa.array(own)).to_pylist()], np.int64)
            order = np.argsort(c * 16**DIGITS + digits[place], kind="stable")
            at = np.flatnonzero(more)[order]
            c, w, cnt = c[order], w[at], cnt[at]
            ends = np.cumsum(cnt)
            first = np.flatnonzero(np.diff(c, prepend=-1))
            before = np.append(0, ends)[first]
            place = np.cumsum(np.diff(c, prepend=-1) > 0) - 1
            others, lo = (np.append(before[1:], ends[-1]) - before)[place] - cnt, ends - cnt - before[place]
            heads = pc.binary_join_element_wise(f"lexicon|{seed}", *(words.take(pa.array(x)) for x in (lft[at], rgt[at], w)), "", "|")
            r = drawn(heads, places) % others[:, None]
            r += np.where(r >= lo[:, None], cnt[:, None], 0) + before[place][:, None]
            partner = w[np.searchsorted(ends, r.ravel(), "right")]
            keys.append(np.repeat(w, draws) * n + partner)
            times.append(np.ones(len(partner), np.int64))
        key, shared = _added_up(np.concatenate(keys), np.concatenate(times))
        told = pc.binary_join_element_wise(words.take(pa.array(key % n)), pa.array(shared).cast(pa.string()), " ")
        first = np.flatnonzero(np.diff(key // n, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), told)
        return pa.table({"word": words.take(pa.array(key[first] // n)), "partners": pc.binary_join(lists, " ")})

    def work(rows: pa.Table) -> pa.Table:
        flat = pa.concat_arrays([pc.split_pattern(x, " ").flatten() for x in rows["tokens"].chunks])
        cnt = flat.take(pa.array(np.arange(3, len(flat), 4))).cast(pa.int64()).to_numpy()
        coded = flat.take(pa.array(np.delete(np.arange(len(flat)), np.s_[3::4]))).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        words, n = coded.dictionary.take(pa.array(order)), len(order)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        t = rank[coded.indices.to_numpy()]
        key, apart = _keyed(t[::3], t[1::3], t[2::3], n)
        key, cnt = _added_up(key, cnt)
        begin = np.flatnonzero(np.diff(key // n, prepend=-1))
        size = np.diff(np.append(begin, len(key)))
        kept = np.repeat(size > 1, size)  # a word that is alone in a context draws nothing there
        key, cnt, size = key[kept], cnt[kept], size[size > 1]
        lft, rgt, word = apart(key)
        begin = np.cumsum(size) - size
        # contexts whose words are about TOKENS go together
        cuts = np.flatnonzero(np.diff(begin // TOKENS, prepend=-1))
        out = [pa.table({"word": pa.array([], pa.string()), "partners": pa.array([], pa.string())})]
        for a, b in zip(cuts, [*cuts[1:], len(begin)]) if draws else ():  # no cut: no context has two words
            own = slice(begin[a], begin[b] if b < len(begin) else len(key))
            out.append(of_contexts(words, lft[own], rgt[own], word[own], cnt[own], begin[a:b] - begin[a]))
        return pa.concat_tables(out)

    return work


def _best_partners(top: int):
    """(word, lemma, rank) of a partition whose "partner count" rows are sorted by word."""

    def work(batches):
        held, limit = [], TEXT

        def merged(rows: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
            word, partners = (rows[c].combine_chunks() for c in ("word", "partners"))
            new = _changes(word)
            parts = pc.split_pattern(partners, " ")
            each = np.diff(parts.offsets.to_numpy()) // 2
            flat = parts.flatten()
            of = np.repeat(np.cumsum(new) - 1, each)
            coded = flat.take(pa.array(np.arange(0, len(flat), 2))).dictionary_encode()
            shared = flat.take(pa.array(np.arange(1, len(flat), 2))).cast(pa.int64()).to_numpy()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key, shared = _added_up(of * len(order) + rank[coded.indices.to_numpy()], shared)
            return word.take(pa.array(np.flatnonzero(new))), key // len(order), coded.dictionary.take(pa.array(order)), key % len(order), shared

        def told(last: bool):
            nonlocal held, limit
            rows = pa.Table.from_batches(held)
            begin = np.flatnonzero(_changes(rows["word"].combine_chunks()))
            end = rows.num_rows if last else int(begin[-1])
            rest = rows.slice(end)
            if not last and rest.num_rows > 1:  # a word of many rows goes on as one
                word, _, names, partner, shared = merged(rest)
                text = " ".join(f"{p} {n}" for p, n in zip(names.take(pa.array(partner)).to_pylist(), shared.tolist(), strict=True))
                rest = pa.table({"word": word, "partners": pa.array([text], pa.string())})
            held = rest.to_batches()
            limit = max(TEXT, 2 * rest.nbytes)
            if end:
                word, of, names, partner, shared = merged(rows.slice(0, end))
                order = np.lexsort((partner, -shared, of))
                of, partner = of[order], partner[order]
                place = np.arange(len(of)) - np.flatnonzero(np.diff(of, prepend=-1))[of]
                kept = place < top
                yield pa.RecordBatch.from_arrays([word.take(pa.array(of[kept])), names.take(pa.array(partner[kept])), pa.array(place[kept] + 1, pa.int64())],
                                                 ["word", "lemma", "rank"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.nbytes for b in held) >= limit:
                    yield from told(False)
        if held:
            yield from told(True)

    return work


def lexicon_from_contexts(docs: DataFrame, draws: int = DRAWS, top: int = TOP, seed: int = 0, text_col: str = "text") -> DataFrame:
    """L3: returns (word, lemma, rank) with rank 1..top."""
    # what a task finds of a group of contexts is one row; cleaned words have no spaces
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = texts.mapInArrow(_triples(max(GROUPS, size >> GROUP)), "grp bigint, tokens string")
    found = tokens.groupBy("grp").applyInArrow(_partners(draws, seed), "word string, partners string")
    # what follows stays where its word is
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(_best_partners(top), "word string, lemma string, rank bigint")


def eda_synonyms(lex: DataFrame) -> DataFrame:
    """L1: EDA rule. '_' and '-' to space, lowercase, keep a-z and space,
    distinct, minus the word itself -> (word, syns sorted, n_syn)."""
    lemma = F.regexp_replace(F.lower(F.regexp_replace("lemma", "[_-]", " ")), "[^a-z ]", "")
    s = lex.select("word", lemma.alias("syn")).where(F.col("syn") != F.col("word")).distinct()
    return s.groupBy("word").agg(F.sort_array(F.collect_list("syn")).alias("syns")).withColumn(
        "n_syn", F.size("syns").cast("bigint")
    )


def geca_synonyms(lex: DataFrame) -> DataFrame:
    """L2: GECA rule. Lemmas whose lowercase differs from the word's lowercase,
    '_' to space, case kept -> (word, syns sorted, n_syn)."""
    s = lex.where(F.lower("lemma") != F.lower("word")).select(
        "word", F.regexp_replace("lemma", "_", " ").alias("syn")
    ).distinct()
    return s.groupBy("word").agg(F.sort_array(F.collect_list("syn")).alias("syns")).withColumn(
        "n_syn", F.size("syns").cast("bigint")
    )


def pick_synonym(syns_df: DataFrame, seed: int = 0) -> DataFrame:
    """L2 draw: one synonym per word, uniform by hash."""
    idx = F.pmod(D.draw("geca_pick", seed, F.col("word")), F.col("n_syn")) + 1
    return syns_df.select("word", F.element_at("syns", idx.cast("int")).alias("synonym"))


# DuckDB twins -----------------------------------------------------------------

def duck_context_counts(docs: str) -> str:
    toks = f"list_filter(string_split({T.duck_clean_letters('text')}, ' '), lambda x: x <> '')"
    return f"""(SELECT lft, rgt, word, count(*) AS cnt FROM (
      SELECT unnest(w[1:len(w)-2]) AS lft, unnest(w[2:len(w)-1]) AS word, unnest(w[3:len(w)]) AS rgt
      FROM (SELECT {toks} AS w FROM {docs}) WHERE len(w) >= 3) GROUP BY ALL)"""


def duck_lexicon(docs: str, draws: int = DRAWS, top: int = TOP, seed: int = 0) -> str:
    draw = D.sql_draw("lexicon", seed, "lft", "rgt", "word", "k")
    return f"""(WITH run AS MATERIALIZED (SELECT * FROM {duck_running(duck_context_counts(docs), 'lft, rgt')} WHERE total > cnt),
  dr AS (SELECT lft, rgt, word, lo, cnt, {draw} % (total - cnt) AS r FROM run, range(0, {draws}) t(k)),
  sh AS (SELECT d.word, m.word AS partner, count(*) AS shared FROM (
      SELECT lft, rgt, word, r + CASE WHEN r >= lo THEN cnt ELSE 0 END AS r FROM dr) d
      JOIN run m ON m.lft = d.lft AND m.rgt = d.rgt AND m.lo <= d.r AND d.r < m.hi GROUP BY ALL)
  SELECT word, partner AS lemma, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY shared DESC, partner ASC) AS rank FROM sh)
  WHERE rank <= {top})"""


def duck_eda_synonyms(lex: str) -> str:
    lemma = "regexp_replace(lower(regexp_replace(lemma, '[_-]', ' ', 'g')), '[^a-z ]', '', 'g')"
    return f"""(SELECT word, list_sort(list(syn)) AS syns, count(*) AS n_syn FROM (
      SELECT DISTINCT word, {lemma} AS syn FROM {lex}) WHERE syn <> word GROUP BY word)"""


def duck_geca_synonyms(lex: str) -> str:
    return f"""(SELECT word, list_sort(list(syn)) AS syns, count(*) AS n_syn FROM (
      SELECT DISTINCT word, replace(lemma, '_', ' ') AS syn FROM {lex} WHERE lower(lemma) <> lower(word))
      GROUP BY word)"""
