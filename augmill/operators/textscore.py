"""Generated-text evaluation (G1-G8, G10-G12) as joins and aggregates; words and trees of a key meet once.

Inputs are token arrays per pair id: ``hyp`` (sid, h) and ``ref`` (sid, r).
BLEU is corpus level (clipped n-gram counts summed over all pairs); ROUGE and
METEOR are per pair, then averaged. ROUGE-L uses the bit-parallel LCS
recurrence (``V' = (V + (V & M)) | (V & ~M)``) over whole texts. Bracket F1 and tree distance work
on span multisets parsed from bracketed strings.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from augmill.functions.stem import stemmed


def ngrams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)),
                                              lambda i: F.array_join(F.slice(w, i, n), " "))) \
        .otherwise(F.array().cast("array<string>"))


def line_check(hyp: DataFrame, ref: DataFrame) -> DataFrame:
    """G1: full outer join on the id; unmatched rows on either side."""
    j = hyp.select("sid", F.lit(1).alias("_h")).join(ref.select("sid", F.lit(1).alias("_r")), "sid", "full_outer")
    return j.agg(F.count("_h").alias("n_hyp"), F.count("_r").alias("n_ref"),
                 F.count(F.when(F.col("_h").isNull(), 1)).alias("missing_hyp"),
                 F.count(F.when(F.col("_r").isNull(), 1)).alias("missing_ref"))


def _struct(*fields: tuple) -> StructType:
    out = StructType()
    for name, kind in fields:
        out.add(name, kind)
    return out


def _longs(*names: str) -> list[tuple]:
    return [(n, LongType()) for n in names]


def _nested(col: pa.ListArray) -> list[list[list]]:
    """The rows of array<array<string>>, through one flat list of words."""
    inner = col.flatten()
    words, ends = inner.flatten().to_pylist(), inner.value_lengths().to_pylist()
    arrays, at = [], 0
    for n in ends:
        arrays.append(words[at : at + n])
        at += n
    rows, at = [], 0
    for n in col.value_lengths().to_pylist():
        rows.append(arrays[at : at + n])
        at += n
    return rows


def _grams(arrays: list[list], n: int) -> Counter:
    counts: Counter = Counter()
    for w in arrays:
        if n == 1:
            counts.update("" if x is None else x for x in w)
        else:
            parts = zip(*(w[k:] for k in range(n)))
            counts.update(map(" ".join, parts) if None not in w else (" ".join(x for x in p if x is not None) for p in parts))
    return counts


def _overlaps(pairs: DataFrame, n_max: int, limit: int | None) -> DataFrame:
    """(sid, by_n): the clipped overlap and both sides' gram totals of each order. The words of a pair meet
    once, by sid; its grams are counted where they are and never leave as rows."""
    @F.arrow_udf(ArrayType(_struct(("n", IntegerType()), *_longs("match", "h_total", "r_total"))))
    def counted(h: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for left, right in zip(_nested(h), _nested(r), strict=True):
            per = []
            for n in range(1, n_max + 1):
                hc, rc = _grams(left, n), _grams(right, n)
                per.append({"n": n, "match": sum(min(c, rc[g]) for g, c in hc.items() if g in rc), "h_total": sum(hc.values()), "r_total": sum(rc.values())})
            out.append(per)
        return pa.array(out, pa.list_(pa.struct([("n", pa.int32()), *[(c, pa.int64()) for c in ("match", "h_total", "r_total")]])))

    side = lambda c: F.coalesce(F.slice(c, 1, limit) if limit else F.col(c), F.array().cast("array<string>"))
    met = pairs.groupBy("sid").agg(*[F.collect_list(side(c)).alias(c) for c in ("h", "r")])
    return met.select("sid", counted("h", "r").alias("by_n"))


def overlap_by_n(pairs: DataFrame, n_max: int, limit: int | None = None) -> DataFrame:
    """(sid, n, match, h_total, r_total): clipped overlap and gram totals per
    pair and order; pairs without grams of an order get zeros."""
    return _overlaps(pairs, n_max, limit).select("sid", F.inline("by_n"))


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """Corpus BLEU x100 (n = 1..4, brevity penalty, 0 if any precision is 0).
    The corpus sums come straight from the grams' counts; the totals of order 1
    are the lengths of both sides."""
    o = overlap_by_n(pairs, 4).groupBy("n").agg(F.sum("match").alias("m"), F.sum("h_total").alias("t"), F.sum("r_total").alias("r"))
    s = o.groupBy().agg(
        F.min(F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.lit(0.0))).alias("pmin"),
        F.avg(F.log(F.when(F.col("m") > 0, F.col("m") / F.col("t")))).alias("logmean"),
        F.max(F.when(F.col("n") == 1, F.col("t"))).alias("c"), F.max(F.when(F.col("n") == 1, F.col("r"))).alias("rl"),
        *[F.max(F.when((F.col("n") == k) & (F.col("t") > 0), F.col("m") / F.col("t"))).alias(f"p{k}") for k in range(1, 5)])
    bp = F.when(F.col("c") > F.col("rl"), F.lit(1.0)).when(F.col("c") > 0, F.exp(1.0 - F.col("rl") / F.col("c"))).otherwise(F.lit(0.0))
    bleu = F.when(F.col("pmin") > 0, bp * F.exp(F.col("logmean")) * 100.0).otherwise(F.lit(0.0))
    return s.select(F.round(bleu, 6).alias("bleu"), F.round(bp, 6).alias("bp"),
                    *[F.round(F.col(f"p{k}"), 6).alias(f"p{k}") for k in range(1, 5)])


def _stems(pairs: DataFrame, stem: bool | DataFrame) -> DataFrame:
    return stemmed(pairs, ["h", "r"], "sid", None if stem is True else stem) if stem is not False else pairs


def rouge_n(pairs: DataFrame, limit: int | None = None, stem: bool | DataFrame = False) -> DataFrame:
    """Per pair ROUGE-1/2 F (alpha .5) over whole texts, or the first ``limit`` words. ``stem``: over
    stems, the published ones (True) or those of a table (word, stem)."""
    pairs = _stems(pairs, stem)
    o = _overlaps(pairs, 2, limit)

    def f(x: Column) -> Column:
        p, r = x["match"] / x["h_total"], x["match"] / x["r_total"]
        return F.when(x["match"] > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))

    return o.select("sid", f(F.col("by_n")[0]).alias("rouge1"), f(F.col("by_n")[1]).alias("rouge2"))


@F.pandas_udf(LongType())
def _lcs(h: pd.Series, r: pd.Series) -> pd.Series:
    """Bit-parallel LCS length: one integer with a bit per word of ``r``, one add/and/or per word of ``h``."""
    out = []
    for left, right in zip(h, r, strict=True):
        masks: dict = {}
        for k, w in enumerate(right):
            masks[w] = masks.get(w, 0) | 1 << k
        full = v = (1 << len(right)) - 1
        for w in left:
            both = v & masks.get(w, 0)
            v = (v + both | v - both) & full
        out.append(len(right) - v.bit_count())
    return pd.Series(out, dtype="int64")


def lcs_length(df: DataFrame, h: str, r: str, out: str = "lcs") -> DataFrame:
    """LCS length of two array columns of any length (Arrow batches; a 64-bit column holds no longer state)."""
    return df.withColumn(out, _lcs(h, r))


def rouge_l(pairs: DataFrame, limit: int | None = None, stem: bool | DataFrame = False) -> DataFrame:
    """Per pair LCS F1 over whole texts, or the first ``limit`` words; ``stem`` as in :func:`rouge_n`."""
    pairs = _stems(pairs, stem)
    d = pairs.select("sid", *[(F.slice(c, 1, limit) if limit else F.col(c)).alias(f"{c}4") for c in ("h", "r")])
    d = lcs_length(d, "h4", "r4").select("sid", "lcs", F.size("h4").alias("nh"), F.size("r4").alias("nr"))
    p = F.col("lcs") / F.col("nh")
    rc = F.col("lcs") / F.col("nr")
    return d.select("sid", "lcs", F.when(F.col("lcs") > 0, 2 * p * rc / (p + rc)).otherwise(F.lit(0.0)).alias("rougel"))


def _placed(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place, word) of the words of array<array<string>>, by row and place; arrays of one key lie over each other."""
    inner = col.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = inner.flatten()
    if len(inner) == len(col):
        return row, place, words
    order = np.lexsort((place, row))
    return row[order], place[order], words.take(pa.array(order))


@F.arrow_udf(_struct(*_longs("m", "c")))
def _exact_links(h: pa.Array, r: pa.Array) -> pa.Array:
    """Links between the k-th occurrences of a word on both sides, and their chunks: words of a batch are
    numbers, sorted once by row and word on each side."""
    sides = [_placed(x) for x in (h, r)]
    code = pa.concat_arrays([words for *_, words in sides]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known, n_left = code.max(initial=0) + 1, len(sides[0][0])
    keyed = []
    for (row, place, _), own in zip(sides, (code[:n_left], code[n_left:]), strict=True):
        told = own >= 0  # a null word has no link
        row, place, key = row[told], place[told], (row * known + own)[told]
        order = np.argsort(key, kind="stable")
        keyed.append((row, place, order, key[order]))
    (row, hp, left, key), (_, rplace, right, other) = keyed
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    at = np.searchsorted(other, key) + nth
    linked = np.append(other, -1)[np.minimum(at, len(other))] == key
    rp = np.full(len(key), -1)
    rp[left[linked]] = rplace[right[at[linked]]]
    row, hp, rp = (x[rp >= 0] for x in (row, hp, rp))
    goes_on = np.zeros(len(row), bool)
    goes_on[1:] = (row[1:] == row[:-1]) & (hp[1:] == hp[:-1] + 1) & (rp[1:] == rp[:-1] + 1)
    return pa.StructArray.from_arrays([pa.array(np.bincount(x, minlength=len(h)).astype(np.int64)) for x in (row, row[~goes_on])], ["m", "c"])


def meteor_exact(pairs: DataFrame) -> DataFrame:
    """G5 (exact-match stage): the k-th occurrence of a word in the hypothesis
    aligns with its k-th occurrence in the reference; a chunk starts at an
    aligned position whose predecessor in the hypothesis is not aligned to the
    preceding reference position. Recall-weighted F-mean with penalty
    0.5 * (chunks / matches)^3. The words of a pair meet once, by sid, and are
    aligned there by one sort: no token is a row."""
    empty = F.array().cast("array<string>")
    met = pairs.groupBy("sid").agg(*[F.collect_list(F.coalesce(c, empty)).alias(c) for c in ("h", "r")],
                                   F.collect_list(F.struct(F.size("h").alias("nh"), F.size("r").alias("nr"))).alias("sizes"))
    d = met.select("sid", "sizes", _exact_links("h", "r").alias("x"))
    d = d.select("sid", F.col("x.m").alias("matches"), F.col("x.c").alias("chunks"), F.inline("sizes"))
    p = F.col("matches") / F.col("nh")
    rc = F.col("matches") / F.col("nr")
    fmean = 10 * p * rc / (rc + 9 * p)
    pen = 0.5 * F.pow(F.col("chunks") / F.col("matches"), 3)
    return d.select("sid", "matches", "chunks",
                    F.when(F.col("matches") > 0, fmean * (1 - pen)).otherwise(F.lit(0.0)).alias("meteor"))


def chunk_tree(w: Column, size: int, top: str = "S", mid: str = "P", tag=None) -> Column:
    """Bracketed string (S (P (W a) (W b)) ...) grouping words in chunks; ``tag`` maps a word to its
    tag. Each chunk makes its own leaves, so the work is linear in the sentence."""
    tag = tag or (lambda x: F.lit("W"))
    n_chunks = F.ceil(F.size(w) / F.lit(size)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: F.concat(
        F.lit(f"({mid} "), F.array_join(F.transform(F.slice(w, c * size + 1, size), lambda x: F.concat(
            F.lit("("), tag(x), F.lit(" "), x, F.lit(")"))), " "), F.lit(")")))
    return F.concat(F.lit(f"({top} "), F.array_join(chunks, " "), F.lit(")"))


_TOKEN = re.compile(r"[()]|[^() \t\n\x0b\f\r]+")


def _brackets(trees: list[str]) -> list[tuple[str, int, int]]:
    """(label, start, end) of a key's tree in one walk; several trees of one key lie over each other, token by token."""
    toks = _TOKEN.findall(trees[0]) if len(trees) == 1 else [
        x for at in zip_longest(*map(_TOKEN.findall, trees)) for x in at if x is not None]
    out, opened, depth, leaves, prev = [], {}, 0, 0, ""
    for k, tok in enumerate(toks):
        if tok == "(":
            opened[depth] = (k, leaves)
            depth += 1
        elif tok == ")":
            depth -= 1
            if (found := opened.pop(depth, None)) and toks[found[0] + 2 : found[0] + 3] == ["("]:
                out.append((toks[found[0] + 1], found[1], leaves))
        elif prev != "(":
            leaves += 1
        prev = tok
    return out


def _struct_lists(rows: list[list[tuple]], fields: list[tuple]) -> pa.Array:
    flat = [x for row in rows for x in row]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    columns = [pa.array([x[k] for x in flat], kind) for k, (_, kind) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, [name for name, _ in fields]))


_SPAN = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]


@F.arrow_udf(ArrayType(_struct(("label", StringType()), *_longs("start", "end"))))
def _spans(trees: pa.Array) -> pa.Array:
    return _struct_lists([_brackets(x) if x else [] for x in trees.to_pylist()], _SPAN)


@F.arrow_udf(ArrayType(_struct(("label", StringType()), *_longs("start", "end", "gc", "pc"))))
def _both_spans(gold: pa.Array, pred: pa.Array) -> pa.Array:
    out = []
    for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True):
        gc, pc = (Counter(_brackets(x) if x else []) for x in (g, p))
        out.append([(*span, gc[span], pc[span]) for span in {**gc, **pc}])
    return _struct_lists(out, [*_SPAN, ("gc", pa.int64()), ("pc", pa.int64())])


def bracket_spans(trees: DataFrame, tree_col: str = "tree", keys: tuple = ("sid",)) -> DataFrame:
    """(keys, label, start, end) for every node whose first child has
    children (preterminals are skipped); positions are leaf indexes.
    A '(' at depth d closes at the next ')' back to depth d. A tree is parsed in
    one walk where its key's trees meet; its tokens are never rows."""
    met = trees.groupBy(*keys).agg(F.collect_list(tree_col).alias("_trees"))
    return met.select(*keys, F.inline(_spans("_trees")))


def _bracket_lists(trees: DataFrame, carry: tuple = ()) -> DataFrame:
    """(sid, carry, spans): array of (label, start, end, gc, pc), the brackets of both trees of every pair that has any."""
    met = trees.groupBy("sid", *carry).agg(F.collect_list("gold").alias("gold"), F.collect_list("pred").alias("pred"))
    # not deterministic in name only: the filter would else be pushed below and parse every tree again
    return met.select("sid", *carry, _both_spans.asNondeterministic()("gold", "pred").alias("spans")).where(F.size("spans") > 0)


def bracket_counts(trees: DataFrame, carry: tuple = ()) -> DataFrame:
    """(sid, carry, label, start, end, gc, pc): the brackets of both trees, ``gold`` and ``pred``, of every pair, in one parse."""
    return _bracket_lists(trees, carry).select("sid", *carry, F.inline("spans"))


def _sum_of(spans: str, value) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + value(x))


def bracket_f1(trees: DataFrame) -> DataFrame:
    """(sid, len_bucket, gold, pred) -> match = sum min(pred, gold) over (label, i, j); micro F1 per length
    bucket and in total (rollup)."""
    per = _bracket_lists(trees, ("len_bucket",)).select(
        "len_bucket", _sum_of("spans", lambda x: F.least(x["gc"], x["pc"])).alias("match"),
        _sum_of("spans", lambda x: x["gc"]).alias("gold"), _sum_of("spans", lambda x: x["pc"]).alias("parse"))
    r = per.rollup("len_bucket").agg(F.sum("match").cast("bigint").alias("match"),
                                     F.sum("gold").cast("bigint").alias("gold"),
                                     F.sum("parse").cast("bigint").alias("parse"))
    f1 = F.when(F.col("match") > 0, 2.0 * F.col("match") / (F.col("gold") + F.col("parse"))).otherwise(F.lit(0.0))
    return r.withColumn("f1", F.round(f1, 6))


def tree_distance(trees: DataFrame) -> DataFrame:
    """G12 (re-aimed): (sid, gold, pred) -> sum |pred - gold| over the bracket multisets per pair."""
    return _bracket_lists(trees).select("sid", _sum_of("spans", lambda x: F.abs(x["gc"] - x["pc"])).alias("distance"))


def tag_accuracy(tagged: DataFrame) -> DataFrame:
    """(sid, len_bucket, gold ARRAY, pred ARRAY) -> position-wise accuracy per bucket and total."""
    ex = tagged.select("len_bucket", F.explode(F.arrays_zip(F.col("gold").alias("g"), F.col("pred").alias("p")))
                       .alias("z"))
    r = ex.rollup("len_bucket").agg(F.count(F.lit(1)).alias("n_tags"),
                                    F.sum((F.col("z.g") == F.col("z.p")).cast("int")).cast("bigint").alias("n_equal"))
    return r.withColumn("acc", F.round(F.col("n_equal") / F.col("n_tags"), 6))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, inter / union)

