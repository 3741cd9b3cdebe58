"""Bounded samples of labelled rows, for the operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(-1)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, size: int) -> DataFrame:
    """(doc_id, text, label) of up to ``size`` labelled rows outside the held-out fold, those with
    the smallest hash of the id. Of an id's several labels the largest counts; null labels
    don't. Only ids are ordered; the chosen ones, at most ``size`` (id, label) pairs, are
    broadcast to the scan of the texts."""
    ids = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", parts) != held_out))
           .groupBy("doc_id").agg(F.max("label").alias("label")))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
