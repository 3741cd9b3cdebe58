"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is its white-space-separated words, hashed. Of its runs of ``K`` words those are
anchors whose smallest run of ``S`` words stands first or last in them. Whether a run is
an anchor depends on its own words only, so equal passages give equal anchors wherever
they stand and whatever surrounds them. An anchor is a 64-bit number: 44 bits of the
run's hash, then 20 bits of its word position. The fingerprint is all of a text's distinct
anchor hashes, each at its first position, ascending, in hexadecimal, 16 digits each: about
one for two words. Two texts are alike by the Jaccard likeness of their whole hash sets; the
positions of matched anchors tell where the shared part ends. A text without words has no
anchors, and two such texts are alike (1.0) only with each other.

A text with few words, or one whose longest word takes more than 1 / ``FEW`` of it, is the
characters of its words, joined by one blank, instead: either half of any other text then
holds whole runs. So is a text without white space. Below ``SHORT`` characters its anchors
are all runs of one and of two characters. ``unit`` names the choice (word, char or short),
made from the text alone; positions count units. A text is compared with its edit and with
the next text in its own unit, the other's anchors made anew in it where they differ.

The next document by ascending id comes from windows over narrow id ranges: quantiles of
the ids, each divided evenly, so that a range holds about ``RANGE_ROWS`` rows; the first
row of the next range is added to each as a guest. Only texts are shuffled; anchors, larger
than their text, are made where the windows are.

Edge cases: a null text is empty; null ids come first; rows of one id are ordered by their
text, repeated rows follow one another, each with its row; a single document is followed
by itself; an empty table gives an empty table. Only id and text are read, so other
columns may clash. Positions from 2^20 - 1 on count as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augmill.sources.tables import load, spread

from .registry import register

K, S = 5, 2
FEW, SHORT = 20, 24
RANGE_ROWS = 2_000
_QUANTILES = 64
_POSITION = (1 << 20) - 1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the functions above read many times: a one-row Generate keeps the
    optimiser from copying the expression into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_anchors(df: DataFrame, text: str, out: str, unit: str | None = None) -> DataFrame:
    """Add ``out``: the text's anchors in ascending order, of equal hashes the first in the text. They are made in
    the unit that column ``unit`` names; without one, in the text's own, which is added as ``<out>_unit``."""
    h, mers, low, pick = f"{out}_h", f"{out}_m", f"{out}_l", f"{out}_p"
    split, joined = f"{out}_w", f"{out}_j"
    inner = K - S + 1
    df = _once(df, split, F.filter(F.split(F.col(text), r"[\s]+"), lambda w: w != ""))
    df = _once(df, joined, F.array_join(split, " "))
    if unit is None:
        unit = f"{out}_unit"
        longest = F.coalesce(F.array_max(F.transform(split, lambda w: F.length(w))), F.lit(0))
        df = _once(df, unit, F.when(longest * FEW <= F.length(joined), "word").when(F.length(joined) < SHORT, "short").otherwise("char"))
    units = F.when(F.col(unit) == "word", F.col(split)).otherwise(F.filter(F.split(F.col(joined), ""), lambda c: c != ""))
    df = _once(df, h, F.transform(units, lambda w: F.xxhash64(w)))
    n = F.size(h)
    df = _once(df, mers, F.zip_with(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), F.slice(F.col(h), 2, F.greatest(n - 1, F.lit(0))),
                                    lambda a, b: F.xxhash64(a, b)))
    # the smallest of `inner` neighbours, by doubling
    m = F.size(mers)
    pairs = F.zip_with(F.slice(mers, 1, F.greatest(m - 1, F.lit(0))), F.slice(F.col(mers), 2, F.greatest(m - 1, F.lit(0))),
                       lambda a, b: F.least(a, b))
    df = _once(df, f"{low}2", pairs)
    m = F.size(f"{low}2")
    width = F.greatest(m - (inner - 2), F.lit(0))
    df = _once(df, low, F.zip_with(F.slice(f"{low}2", 1, width), F.slice(F.col(f"{low}2"), inner - 1, width),
                                   lambda a, b: F.least(a, b)))
    # 1-based places of the runs whose smallest inner run is the first or the last
    edge = F.zip_with(F.slice(F.col(mers), 1, F.size(low)), F.slice(F.col(mers), inner, F.size(low)), lambda a, b: F.least(a, b))
    marked = F.zip_with(F.col(low), edge, lambda a, b: a == b)
    place = F.filter(F.transform(marked, lambda x, i: F.when(x, i + 1)), lambda x: x.isNotNull())
    df = _once(df, pick, place)
    pack = lambda x, i: x.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(F.least(i, F.lit(_POSITION)).cast("bigint"))
    alone = F.concat(F.transform(h, lambda x, i: pack(F.xxhash64(x), i)), F.transform(mers, pack))
    anchors = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.col(unit) == "short", alone).when(
        F.size(h) < K, F.array(pack(F.xxhash64(h), F.lit(0)))).otherwise(
        F.transform(pick, lambda i: pack(F.xxhash64(F.slice(F.col(h), i, F.lit(K))), i - 1)))
    every = f"{out}_e"
    df = _once(df, every, F.sort_array(anchors))
    df = _once(df, out, F.filter(every, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(F.col(every), i - 1)))))
    return df.drop(split, joined, h, mers, f"{low}2", low, pick, every)


def fingerprint(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, 20)


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: the Jaccard likeness of two texts' anchor hashes, 0 to 1."""
    both = F.size(F.array_intersect(F.transform(a, _hash), F.transform(b, _hash)))
    df = _once(df, f"{out}_b", both)
    union = F.size(a) + F.size(b) - F.col(f"{out}_b")
    return df.withColumn(out, F.when(union == 0, F.lit(1.0)).otherwise(F.col(f"{out}_b") / union)).drop(f"{out}_b")


def id_range(docs: DataFrame) -> Column:
    """The number of the narrow id range of a row: ascending with the id, about ``RANGE_ROWS`` rows each."""
    steps = [k / _QUANTILES for k in range(_QUANTILES + 1)]
    row = docs.agg(F.count("id").alias("n"), F.percentile_approx("id", steps, 10_000).alias("q")).first()
    if not row["n"]:
        return F.lit(0).cast("bigint")
    q, parts = [int(x) for x in row["q"]], max(1, -(-row["n"] // (_QUANTILES * RANGE_ROWS)))
    if row["n"] <= RANGE_ROWS:
        return F.lit(0).cast("bigint")
    low, width = q[:-1], [max(1, -(-(b - a) // parts)) for a, b in zip(q, q[1:], strict=False)]
    part = F.greatest(F.size(F.filter(F.array(*map(F.lit, low)), lambda x: x <= F.col("id"))), F.lit(1))
    inside = F.least(F.greatest(F.floor((F.col("id") - F.element_at(F.array(*map(F.lit, low)), part))
                                        / F.element_at(F.array(*map(F.lit, width)), part)), F.lit(0)), F.lit(parts - 1))
    return F.coalesce(part * parts + inside, F.lit(-1)).cast("bigint")


#: Up to so many ranges their heads, 24 bytes each, are broadcast to find the guests; beyond, the join shuffles.
BROADCAST_RANGES = 100_000


def with_guests(docs: DataFrame) -> DataFrame:
    """Number the ranges of (id, text) and add to each the row that follows it, as a guest: the first
    row of the next range, after the last that of the first. Only numbers and smallest ids
    reach the window over all ranges."""
    ranged = docs.withColumn("range", id_range(docs))
    heads = ranged.groupBy("range").agg(F.min("id").alias("id"))
    order = Window.orderBy(F.desc("range"))
    links = heads.select(F.col("id").alias("head"), F.col("range").alias("of"), F.lead("range").over(order).alias("to"),
                         F.max("range").over(Window.partitionBy()).alias("last"))
    links = links.select("head", "of", F.coalesce("to", "last").alias("to"))
    if heads.count() <= BROADCAST_RANGES:
        links = F.broadcast(links)
    guests = ranged.join(links, (ranged["range"] == links["of"]) & ranged["id"].eqNullSafe(links["head"])).select(
        *docs.columns, F.col("to").alias("range"), F.lit(True).alias("guest"))
    return ranged.withColumn("guest", F.lit(False)).unionByName(guests)


def with_next(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows in the range."""
    w = Window.partitionBy("range").orderBy("guest", "id", "text")
    return rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry)).where(~F.col("guest")).drop("guest", "range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of the text whose second half is replaced by the next
    document's beginning, in the same unit, and how alike they are."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_anchors(with_guests(rows).repartition("range"), "text", "own"), ["text", "own", "own_unit"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = _once(rows.withColumn("n_chars", n.cast("long")), "edited",
                 F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    other = F.col("own_unit") != F.col("next_own_unit")
    rows = rows.withColumn("anew", F.when(other, F.col("next_text")).otherwise("")).drop("text", "next_text")
    rows = with_anchors(with_anchors(rows, "edited", "changed", "own_unit"), "anew", "next_anew", "own_unit")
    rows = _once(rows, "next_alike", F.when(other, F.col("next_anew")).otherwise(F.col("next_own")))
    rows = likeness(likeness(rows, "own", "changed", "near_edited"), "own", "next_alike", "near_next")
    # the position up to which anchors stand where they stood
    shared = F.array_max(F.transform(F.array_intersect("own", "changed"), lambda x: x.bitwiseAND(F.lit(_POSITION))))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
                       "near_edited", "near_next", shared.alias("shared_until"), F.col("own_unit").alias("unit"))


@register("op8_syncmers")
def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spread(load(spark, sf_dir, "documents"), "doc_id"))
