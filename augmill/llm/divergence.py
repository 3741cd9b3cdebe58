"""Source divergence audit: how far the term shares of a source lie from those of others of its language.

Terms are runs of letters: ASCII letters, of which only A-Z are lower-cased, and whatever
isn't ASCII. Per chunk of texts they are counted by length: terms of up to 8 bytes are one
64-bit word, up to 16 bytes two words, radix-sorted by 16-bit digits and run-counted; longer
ones are byte strings sorted in a bucket of their own length. What leaves a chunk is one row
per (lang, source, term), so a frequent term costs a shuffle one row per chunk and source.

A term's share in a group is p = 1 + floor(SCALE * (count + 1) / (N + V)): N occurrences in the
group, V kept terms of the language. Two shares differ by f(p, q) = floor((p - q)^2 / q).
All numbers are integers; sums that may pass 64 bits are decimals.

Sums over all V terms take only the counts that there are. With z the share of a count of 0,

    sum f(p, q) = V f(zp, zq) + sum over p's terms (f(p, zq) - f(zp, zq))
                + sum over q's terms (f(zp, q) - f(zp, zq))
                + sum over shared terms (f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq));

the second and third sum run over distinct shares with their frequencies, the last over the
rows of a term, which stream by in order of (lang, term): no task holds a source's terms,
and pairs of sources are added up inside the tasks.

Edge cases: null lang, source and text are ''; each repeated row is a document of its own, as
are rows with null ids (ids aren't read); a group without terms has N = 0 and all ranks of
`pair`; a language without kept terms has value 0 for all pairs; a source alone in its
language has no `pair` rows; equal values rank by the item's UTF-8; an empty table gives an
empty table. Other columns aren't read and may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augmill.sources.tables import load

from .common import chunks, runs, stored, text_buffer
from .registry import register

SCALE = 1_000_000_000
#: Bytes of text that are counted together.
CHUNK = 16 << 20
#: Pairs of sources that a task adds up before it hands them on.
PAIRS = 1 << 18

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = (_BYTES + 32 * ((_BYTES >= 0x41) & (_BYTES <= 0x5A))).astype(np.uint8)
#: The first n bytes of a big-endian word.
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * n)) for n in range(9)], np.uint64)


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order``, stably sorted by the words (the first is the most significant), 16 bits at a time."""
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _words(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each start as a big-endian word, filled up with zeros."""
    at = np.lib.stride_tricks.sliding_window_view(low, 8)[start]
    return np.ascontiguousarray(at).view(">u8").ravel().astype(np.uint64) & _FIRST[np.minimum(size, 8)]


def _strings(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """(n, width) bytes, of which each row's first ``size`` count, as strings."""
    data = raw[np.arange(raw.shape[1]) < size[:, None]]
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data.tobytes()))


def count_terms(data: np.ndarray, offs: np.ndarray, group: np.ndarray):
    """(group, term, occurrences, documents) of the rows' UTF-8 ``data``, as arrays per bucket of lengths."""
    start, end, row = runs(_LETTER[data], offs)
    size, own = end - start, group[row]
    low = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    by_group = np.argsort(own.astype(np.uint16), kind="stable") if (len(own) and own.max() < 1 << 16) else np.argsort(own, kind="stable")

    def counted(order: np.ndarray, changes: np.ndarray):
        """First place, occurrences and documents of each run of one term and group."""
        g, r = own[order], row[order]
        new = changes | (np.diff(g, prepend=-1) != 0)
        begin = np.flatnonzero(new)
        docs = np.add.reduceat((new | (np.diff(r, prepend=-1) != 0)).astype(np.int64), begin)
        return order[begin], np.diff(np.append(begin, len(order))), docs

    def packed(least: int, most: int):
        """Terms of ``least`` to ``most`` bytes, at most 16, as one or two words."""
        order = by_group[(size[by_group] >= least) & (size[by_group] <= most)]
        if not len(order):
            return
        words = [np.zeros(len(size), np.uint64) for _ in range(-(-most // 8))]
        for k, word in enumerate(words):
            word[order] = _words(low, start[order] + 8 * k, size[order] - 8 * k)
        order = radix_order(words, order)
        changes = np.zeros(len(order), bool)
        for word in words:
            changes |= np.concatenate([[True], word[order][1:] != word[order][:-1]])
        at, n, docs = counted(order, changes)
        raw = np.concatenate([word[at].astype(">u8").view(np.uint8).reshape(-1, 8) for word in words], axis=1)
        yield own[at], _strings(raw, size[at]), n, docs

    yield from packed(1, 8)
    yield from packed(9, 16)
    far = by_group[size[by_group] > 16]
    far = far[np.argsort(size[far], kind="stable")]
    for bucket in np.split(far, np.flatnonzero(np.diff(size[far])) + 1) if len(far) else ():
        width = int(size[bucket[0]])
        raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, width)[start[bucket]])
        text = raw.view(f"S{width}").ravel()
        sort = np.argsort(text, kind="stable")
        at, n, docs = counted(bucket[sort], np.concatenate([[True], text[sort][1:] != text[sort][:-1]]))
        where = np.lib.stride_tricks.sliding_window_view(low, width)[start[at]]
        yield own[at], _strings(np.ascontiguousarray(where), size[at]), n, docs


def _count(batches):
    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, code = np.unique(codes, return_inverse=True)
        langs = lang.dictionary.take(pa.array(groups // max(1, len(source.dictionary))))
        sources = source.dictionary.take(pa.array(groups % max(1, len(source.dictionary))))
        data, offs = text_buffer(batch.column(2))
        for lo, hi in chunks(offs, CHUNK):
            for g, term, n, docs in count_terms(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], code[lo:hi]):
                at = pa.array(g)
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                                 names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, total, first): counts of the terms that stand in at least ``min_docs``
    documents of their language, the language's total, and whether the row is its term's first."""
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = read.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # dealt out by (lang, term) once, for the counts and for what is asked of all rows of a term
    sums = made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return sums.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("first")).where(F.col("docs") >= min_docs).drop("docs")


def _share(n: Column, total: Column, kept: Column) -> Column:
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", scaled, (total + kept).cast("decimal(20,0)"))).cast("bigint")


def _differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(batches):
    """Rows (lang, source, p, z, first) in order of their terms -> (lang, source, item, amount): the last
    of the sums above."""

    def differ(p, q):
        return (p - q) * (p - q) // q

    numbers: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}
    rest = None

    def flush():
        names = list(numbers)
        a, b = [names[k >> 32] for k in sums], [names[k & 0xFFFFFFFF] for k in sums]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()),
                                          pa.array([x[1] for x in b], pa.string()), pa.array(list(sums.values()), pa.int64())],
                                         names=["lang", "source", "item", "amount"])
        sums.clear()

    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        width = len(source.dictionary)
        pairs, inverse = np.unique(lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy(), return_inverse=True)
        names = zip(lang.dictionary.take(pa.array(pairs // width)).to_pylist(), source.dictionary.take(pa.array(pairs % width)).to_pylist())
        own = np.array([numbers.setdefault(x, len(numbers)) for x in names], np.int64)[inverse]
        rows = [own, *(batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)), batch.column(4).to_numpy(zero_copy_only=False)]
        own, p, z, first = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        heads = np.flatnonzero(first)
        cut = heads[-1] if len(heads) else 0  # the last term may go on in the next batch
        rest = [x[cut:] for x in (own, p, z, first)]
        _add(sums, own[:cut], p[:cut], z[:cut], np.cumsum(first[:cut]), differ)
        if len(sums) > PAIRS:
            yield from flush()
    if rest is not None:
        own, p, z, first = rest
        _add(sums, own, p, z, np.cumsum(first), differ)
    yield from flush()


def _add(sums, own, p, z, term, differ) -> None:
    lag, live = 1, np.arange(len(own) - 1)
    while len(live := live[live + lag < len(own)]) and len(live := live[term[live] == term[live + lag]]):
        for a, b in ((live, live + lag), (live + lag, live)):
            amount = differ(p[a], p[b]) - differ(p[a], z[b]) - differ(z[a], p[b]) + differ(z[a], z[b])
            keys, inverse = np.unique(own[a] << 32 | own[b], return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, inverse, amount)
            for k, x in zip(keys.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + x
        lag += 1


def divergence(docs: DataFrame, top: int = 200, min_docs: int = 3) -> DataFrame:
    """(lang, source, part, item, value, rank). ``pair``: the other sources of the language, by how far they
    are; ``term``: the ``top`` terms that a source has more of than its language."""
    kept = stored(term_counts(docs, min_docs), "term-counts")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("bigint")).alias("new"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(held, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("new", F.lit(0)).alias("new"))
    whole = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("new").alias("kept"))
    zero = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("size"), F.col("kept")))
    groups = stored(groups.drop("new").join(whole, "lang").withColumn("z", zero), "groups")

    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "total", "lang_size", "kept", "z", _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.withColumn("q", _share(F.col("total"), F.col("lang_size"), F.col("kept"))).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    both = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    none = _differ(F.col("z"), F.col("other_z"))
    wide = "decimal(38,0)"
    base = both.select("lang", "source", "item", F.coalesce(F.col("kept").cast(wide) * none, F.lit(0)).cast(wide).alias("amount"))
    often = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("often"))
    met = often.join(other, "lang").where(F.col("source") != F.col("item"))
    mine = met.select("lang", "source", "item", (F.col("often").cast(wide) * (_differ(F.col("p"), F.col("other_z")) - none)).cast(wide).alias("amount"))
    back = _differ(F.col("other_z"), F.col("p")) - _differ(F.col("other_z"), F.col("z"))
    theirs = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"),
                        (F.col("often").cast(wide) * back).cast(wide).alias("amount"))
    nth = F.row_number().over(Window.partitionBy("lang", "term").orderBy("source"))
    shared = shares.select("lang", "source", "p", "z", (nth == 1).alias("first")).mapInArrow(
        _shared_terms, "lang string, source string, item string, amount bigint")
    shared = shared.select("lang", "source", "item", F.col("amount").cast(wide).alias("amount"))
    pairs = base.unionByName(mine).unionByName(theirs).unionByName(shared).groupBy("lang", "source", "item").agg(
        F.sum("amount").cast("bigint").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  grp AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
  n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
  lt AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
  ln AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang),
  p AS (SELECT grp.lang, grp.source, kept.term, coalesce(c.c, 0) AS c,
      1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)::HUGEINT) // (coalesce(n.n, 0) + v.v)::HUGEINT AS p
      FROM grp JOIN kept ON kept.lang = grp.lang JOIN v ON v.lang = grp.lang
      LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term
      LEFT JOIN n ON n.lang = grp.lang AND n.source = grp.source),
  q AS (SELECT lt.lang, lt.term, 1 + (1000000000::HUGEINT * (lt.c + 1)::HUGEINT) // (ln.n + v.v)::HUGEINT AS q
      FROM lt JOIN ln ON ln.lang = lt.lang JOIN v ON v.lang = lt.lang),
  two AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(two.value, 0)::BIGINT AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
  terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""


@register("op12_divergence", SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))
