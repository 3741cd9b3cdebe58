"""Salted global index: dense 0..N-1 position of each row inside its group,
in the order of (random key, id), without putting a whole group, bucket or
run of equal keys into one task.

A plain ``row_number() over (partition by label order by key, id)`` sends a
whole label to one task; a label may hold a third of the corpus, and so may
one run of equal keys (exact text copies when the key is ``md5(text)``).
Three levels keep every window small and the result identical to the plain
window:

1. bucket = the key's leading hex digits; the (group, bucket) count table has
   at most 16^digits rows per group and gives each bucket its offset;
2. inside a bucket, rows are cut into runs (key, id div ``id_range``, or for ids
   that are strings the first two hex digits of their md5); the run count table
   gives each run its offset within the bucket, so a hot key is split into many runs;
3. ``row_number`` inside a run (at most ``id_range`` ids, or a 256th of them).

The order is that of (key, id) for numeric ids, of (key, md5 digits, id) for strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_index(
    df: DataFrame,
    group_cols: list[str],
    order_key: Column,
    id_col: str,
    out: str = "idx",
    size_out: str | None = "group_size",
    bucket_digits: int = 4,
    id_range: int = 1 << 20,
) -> DataFrame:
    """Add ``out`` (0-based rank by (order_key, id_col) within ``group_cols``)
    and optionally the group size. ``order_key`` must be a hex string."""
    keyed = df.withColumn("_okey", order_key).withColumn("_bkt", F.substring("_okey", 1, bucket_digits))
    numeric_id = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    run = (F.floor(F.col(id_col) / F.lit(id_range)) if numeric_id
           else F.conv(F.substring(F.md5(F.col(id_col)), 1, 2), 16, 10))
    keyed = keyed.withColumn("_run", run.cast("bigint"))
    grp = [F.col(c) for c in group_cols]

    # level 1: bucket offsets within the group (a window over at most
    # 16^bucket_digits count rows per group, also when the group is the table)
    b_counts = keyed.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before_b = Window.partitionBy(*grp).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    b_off = b_counts.withColumn("_off_b", F.coalesce(F.sum("_cnt").over(before_b), F.lit(0)))
    if size_out:
        b_off = b_off.withColumn(size_out, F.sum("_cnt").over(Window.partitionBy(*grp)))
    b_off = b_off.drop("_cnt")

    # level 2: run offsets within the bucket
    r_counts = keyed.groupBy(*group_cols, "_bkt", "_okey", "_run").agg(F.count(F.lit(1)).alias("_cnt"))
    before_r = (Window.partitionBy(*grp, F.col("_bkt")).orderBy("_okey", "_run")
                .rowsBetween(Window.unboundedPreceding, -1))
    r_off = r_counts.withColumn("_off_r", F.coalesce(F.sum("_cnt").over(before_r), F.lit(0))).drop("_cnt")

    # level 3: rank inside the run
    local = Window.partitionBy(*grp, F.col("_okey"), F.col("_run")).orderBy(F.col(id_col))
    ranked = keyed.withColumn("_local", F.row_number().over(local))
    # null-safe: rows without a label are a group of their own
    def met(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
        on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols]
        return left.join(right, on).drop(*[f"_r_{c}" for c in cols])

    res = met(met(ranked, r_off, [*group_cols, "_bkt", "_okey", "_run"]), b_off, [*group_cols, "_bkt"])
    res = res.withColumn(out, (F.col("_off_b") + F.col("_off_r") + F.col("_local") - 1).cast("bigint"))
    return res.drop("_okey", "_bkt", "_run", "_local", "_off_b", "_off_r")
