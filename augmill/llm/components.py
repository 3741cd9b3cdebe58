"""Connected components of a table of links, by alternating large and small stars.

What a task reads is first replaced by the stars of its own components, ``TASK_LINKS`` links
at a time. Then each step is two windows over the links, written to the shared folder with a
mark on those that have moved; when none has, they are the stars of the components. A step
makes one link of each, so that the table never grows. Nothing but one row reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Links that a task joins at once, about.
TASK_LINKS = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, u) of every id in the links (a, b) that is not the smallest id u that they reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    return ids[leaf], ids[root[leaf]]


def _joined(batches):
    held, size = [], 0

    def out():
        v, u = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], names=["v", "u"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        size += batch.num_rows
        if size >= TASK_LINKS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(id, component): of every id in ``links`` (a, b), the smallest id that links reach."""
    edges = stored(links.select("a", "b").where("a <> b").mapInArrow(_joined, "v bigint, u bigint"), "links")
    moved = bool(edges.head(1))
    while moved:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = F.least(F.min("u").over(Window.partitionBy("v")), "v")
        large = both.select("v", "u", least.alias("m")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"), (F.col("m") < F.col("v")).alias("moved"))
        least = F.min("u").over(Window.partitionBy("v"))
        own = F.col("u") == F.col("m")
        small = large.select("v", "u", "moved", least.alias("m")).select(
            F.when(own, F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"), (F.col("moved") | ~own).alias("moved"))
        before, edges = edges, stored(small, "links")
        discard(before)
        moved = bool(edges.where("moved").head(1))
    edges = edges.select("v", "u").dropDuplicates(["v"])
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
