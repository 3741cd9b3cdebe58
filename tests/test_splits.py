"""Exact split sizes, disjointness, and the salted index equal to a plain window."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.operators import splits as SP
from augmill.operators.indexing import global_index
from augmill.sources import tables as TB


def test_global_index_equals_plain_window(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir)
    key = D.sort_key("t", 1, F.col("src_id"))
    a = global_index(lab, ["label"], key, "src_id", bucket_digits=1).select("src_id", "idx")
    w = Window.partitionBy("label").orderBy(key, "src_id")
    b = lab.select("src_id", (F.row_number().over(w) - 1).alias("idx"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_split_sizes(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir)
    n = lab.count()
    two = SP.split_two_way(lab).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in two}
    assert sizes["val"] == math.ceil(0.1 * n) and sizes["train"] == n - math.ceil(0.1 * n)
    three = {r.split: r["count"] for r in SP.split_three_way(lab).groupBy("split").count().collect()}
    hold = math.ceil(0.4 * n)
    assert three["test"] == math.ceil(0.5 * hold) and three["val"] == hold - math.ceil(0.5 * hold)


def test_group_split_has_no_source_leak(spark, sf_dir):
    from augmill.operators.aeda import aeda

    aug = aeda(TB.labelled(spark, sf_dir), naug=2)
    g = SP.group_split(aug)
    per_src = g.groupBy("src_id").agg(F.countDistinct("split").alias("k"))
    assert per_src.where("k > 1").count() == 0
    audit = SP.leak_audit(g, "group", F.md5(F.col("text"))).first()
    assert audit.n_src_leak == 0


def test_undersample_round_half_even(spark):
    rows = [(i, 1) for i in range(25)] + [(100 + i, 0) for i in range(7)]
    df = spark.createDataFrame(rows, "src_id long, label int")
    out = {r.label: r["count"] for r in SP.undersample(df).groupBy("label").count().collect()}
    assert out[1] == round(25 / 10) == 2 and out[0] == 7


def test_global_index_hot_key_runs(spark):
    """A third of the rows share one key: runs of 4 ids still give the plain window."""
    rows = [(i, "same" if i % 3 == 0 else f"t{i}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "sid long, text string, label int")
    key = F.md5(F.col("text"))
    a = global_index(df, ["label"], key, "sid", bucket_digits=1, id_range=4).select("sid", "idx")
    w = Window.partitionBy("label").orderBy(key, "sid")
    b = df.select("sid", (F.row_number().over(w) - 1).alias("idx"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
