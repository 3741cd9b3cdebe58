"""Label statistics, label-wise undersampling and leak-free splits.

Every sample/split is exact: a row's place in a hash order (salted global
index) decides, so sizes equal the reference's rounding rules and results do
not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.operators.indexing import global_index


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


def undersample(df: DataFrame, reduce_labels=(1, 2, 3, 4, 5), factor: int = 10, seed: int = 42) -> DataFrame:
    """Labels in ``reduce_labels`` keep round-half-even(N/factor) rows
    (uniform, by hash order); other labels are kept whole."""
    idx = global_index(df, ["label"], D.sort_key("undersample", seed, F.col("src_id")), "src_id")
    n_keep = F.bround(F.lit(1.0 / factor) * F.col("group_size"), 0)
    reduced = F.coalesce(F.col("label").isin(list(reduce_labels)), F.lit(False))  # rows without a label are kept
    keep = ~reduced | (F.col("idx") < n_keep)
    return idx.where(keep).drop("idx", "group_size")


def label_index(df: DataFrame, order_col: str = "src_id") -> DataFrame:
    """Labels numbered by first appearance (smallest ``order_col``).
    The aggregated table has one row per label; the join is left to AQE."""
    first = df.groupBy("label").agg(F.min(order_col).alias("_first"))
    # one row per label: the unpartitioned window is bounded by the label count
    first = first.withColumn("label_idx", (F.row_number().over(Window.orderBy("_first", "label")) - 1).cast("bigint"))
    first = first.select(F.col("label").alias("_label"), "label_idx")
    return df.join(first, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def split_two_way(df: DataFrame, id_col: str = "src_id", test_size: float = 0.1, seed: int = 93) -> DataFrame:
    """ceil(test_size * N) rows go to 'val', the rest to 'train'."""
    idx = global_index(df, [], D.sort_key("split", seed, F.col(id_col)), id_col)
    n_val = F.ceil(F.lit(float(test_size)) * F.col("group_size"))
    return idx.withColumn("split", F.when(F.col("idx") < n_val, "val").otherwise("train")).drop("idx", "group_size")


def split_three_way(df: DataFrame, id_col: str = "src_id", held: float = 0.4, seed: int = 93) -> DataFrame:
    """P5: ceil(held * N) rows held out; of those ceil(0.5 * held) are 'test',
    the rest 'val'; the remainder is 'train'."""
    idx = global_index(df, [], D.sort_key("split", seed, F.col(id_col)), id_col)
    n_hold = F.ceil(F.lit(float(held)) * F.col("group_size"))
    n_test = F.ceil(F.lit(0.5) * n_hold)
    split = F.when(F.col("idx") < n_test, "test").when(F.col("idx") < n_hold, "val").otherwise("train")
    return idx.withColumn("split", split).drop("idx", "group_size")


def group_split(augmented: DataFrame, test_size: float = 0.1, seed: int = 93) -> DataFrame:
    """Split on the source id, then every copy follows its source."""
    sources = augmented.select("src_id").distinct()
    side = split_two_way(sources, "src_id", test_size, seed)
    return augmented.join(side, "src_id")


def row_split(augmented: DataFrame, test_size: float = 0.1, seed: int = 93) -> DataFrame:
    """The reference behaviour: split augmented rows independently."""
    keyed = augmented.withColumn("_rid", F.concat_ws(":", "src_id", "copy_no"))
    return split_two_way(keyed, "_rid", test_size, seed).drop("_rid")


def leak_audit(split_df: DataFrame, policy: str, text_key) -> DataFrame:
    """Held-out rows whose source or cleaned text also occurs in train.
    Two left joins against the distinct train keys, then one aggregate."""
    s = split_df.withColumn("_tkey", text_key)
    train = s.where(F.col("split") == "train")
    held = s.where(F.col("split") != "train")
    src_keys = train.select("src_id").distinct().withColumn("_src_hit", F.lit(1))
    txt_keys = train.select("_tkey").distinct().withColumn("_txt_hit", F.lit(1))
    flagged = held.join(src_keys, "src_id", "left").join(txt_keys, "_tkey", "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_heldout"),
        F.count("_src_hit").alias("n_src_leak"),
        F.count("_txt_hit").alias("n_text_leak"),
    ).select(F.lit(policy).alias("policy"), "n_heldout", "n_src_leak", "n_text_leak")
