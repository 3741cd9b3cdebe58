"""Shared DataFrame helpers for the augmentation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTPUT_COLUMNS = ["src_id", "technique", "copy_no", "text", "label", "is_original"]


def barrier(df: DataFrame, **exprs: Column) -> DataFrame:
    """Materialise ``exprs`` behind a one-row Generate.

    Catalyst collapses projections and would inline an alias that is used once
    inside a lambda, evaluating it per array element (for example a whole sort
    per word). ``explode(array(struct(...)))`` is not collapsed, so the values
    are computed once per row.
    """
    packed = F.explode(F.array(F.struct(*[e.alias(k) for k, e in exprs.items()]))).alias("_b")
    return df.select("*", packed).select(*df.columns, *[F.col(f"_b.{k}").alias(k) for k in exprs])


def fan_out(df: DataFrame, naug: int) -> DataFrame:
    """One row per (source row, copy_no) with copy_no in 1..naug."""
    if naug < 1:  # sequence(1, 0) counts down
        return df.withColumn("copy_no", F.lit(1).cast("bigint")).where(F.lit(False))
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(int(naug)).cast("bigint"))))


def originals(df: DataFrame, technique: str, text: Column | None = None) -> DataFrame:
    return df.select(
        "src_id",
        F.lit(technique).alias("technique"),
        F.lit(0).cast("bigint").alias("copy_no"),
        (text if text is not None else F.col("text")).alias("text"),
        "label",
        F.lit(True).alias("is_original"),
    )


def as_output(df: DataFrame, technique: str, text: Column) -> DataFrame:
    return df.select(
        "src_id",
        F.lit(technique).alias("technique"),
        F.col("copy_no").cast("bigint").alias("copy_no"),
        text.alias("text"),
        "label",
        F.lit(False).alias("is_original"),
    )
