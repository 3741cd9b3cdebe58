"""Running counts of weighted tables, and draws from them, without a window over a whole key.

:func:`running_counts` gives every (key, word) the interval [lo, hi) of its key's cumulated
counts. The order inside a key is (bucket, word), the bucket being leading hex digits of the
word's md5: a word's place in its bucket comes from a window over (key, bucket), the buckets'
offsets from a window over the at most 16^digits bucket sums of a key. A key that holds half of
all rows is thus 16^digits windows and one short one.

:func:`intervals` splits the intervals into blocks of the count axis, so that a draw finds its
word by an equi-join on (key, draw div BLOCK) and one range check; :func:`drawn` does that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counts that a block of the interval table spans, and md5 digits of a bucket.
BLOCK = 4096
DIGITS = 2


def running_counts(counts: DataFrame, keys: list[str], digits: int = DIGITS) -> DataFrame:
    """(keys, word, cnt) -> with ``lo``, ``hi`` and the key's ``total``."""
    rows = counts.select(*keys, "word", "cnt", F.substring(F.md5("word"), 1, digits).alias("_b"))
    inside = Window.partitionBy(*keys, "_b").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_s"))
    key = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, "_b", F.coalesce(F.sum("_s").over(key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_s").over(key).alias("total"))
    placed = rows.withColumn("_hi", F.sum("cnt").over(inside)).join(offsets, [*keys, "_b"])
    hi = F.col("_off") + F.col("_hi")
    return placed.select(*keys, "word", "cnt", (hi - F.col("cnt")).alias("lo"), hi.alias("hi"), "total")


def intervals(running: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, blk, lo, hi, word): every interval, once per block of the count axis that it touches."""
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    return running.select(*keys, "word", "lo", "hi", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("blk"))


def drawn(rows: DataFrame, running: DataFrame, keys: list[str], out: str, how: str = "inner", block: int = BLOCK) -> DataFrame:
    """``rows`` (keys, r, ...) with the word of their key whose interval holds ``r``. No match: not there, or null if ``how`` is left."""
    table = intervals(running, keys, block).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("blk").alias("_blk"), "lo", "hi", F.col("word").alias(out))
    on = F.floor(F.col("r") / block).cast("bigint") == F.col("_blk")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return rows.join(table, on & (F.col("lo") <= F.col("r")) & (F.col("r") < F.col("hi")), how).drop(
        *[f"_k_{k}" for k in keys], "_blk", "lo", "hi")


def other_than_own(draw: F.Column, lo: F.Column, cnt: F.Column, total: F.Column) -> F.Column:
    """A draw over a key's counts without the own interval [lo, lo + cnt); null when there is nothing else."""
    r = F.pmod(draw, F.when(total > cnt, total - cnt))
    return r + F.when(r >= lo, cnt).otherwise(F.lit(0))


# DuckDB twin ------------------------------------------------------------------

def duck_running(counts: str, keys: str, digits: int = DIGITS) -> str:
    return f"""(SELECT *, hi - cnt AS lo FROM (SELECT {keys}, word, cnt::BIGINT AS cnt, (sum(cnt) OVER (PARTITION BY {keys}
      ORDER BY substr(md5(word), 1, {digits}), word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS hi,
      (sum(cnt) OVER (PARTITION BY {keys}))::BIGINT AS total FROM {counts}))"""
