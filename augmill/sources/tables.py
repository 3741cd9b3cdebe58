"""Driver tables and the derived inputs every operator works on.

``labelled``  = documents JOIN labels  -> (src_id, text, label, lang, source)
``sentences`` = non-blank newline lines of labelled.text -> (src_id, sent_no, text, label)
``pairs``     = conversations user turn JOIN the assistant turn at turn + 1

Joins are left to Catalyst/AQE: ``labels`` grows with the corpus, so it is never
force-broadcast; AQE turns the join into a broadcast only when the runtime size
is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.functions import text as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition on ``key`` when the scan yields fewer partitions than
    the cluster's parallelism (few large row groups), so CPU-heavy row-local
    operators do not run in a handful of tasks. A scan of many files already
    has enough splits and is returned unchanged (no extra shuffle)."""
    if df.isStreaming:
        return df
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access (e.g. Spark Connect)
        return df
    if current >= target:
        return df
    return df.repartition(target, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    labs = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labs, "doc_id").select(
        F.col("doc_id").alias("src_id"), "text", F.col("quality").alias("label"), "lang", "source"
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir)
    return (
        lab.select("src_id", "label", F.posexplode(F.split("text", "\n")).alias("sent_no", "text"))
        .where(T.not_blank(F.col("text")))
        .select("src_id", F.col("sent_no").cast("bigint").alias("sent_no"), "text", "label")
    )


def sentence_key() -> Column:
    """A sentence's key, the id of its text and its line: unique for texts of any length and ids of any size."""
    return F.concat_ws(":", "src_id", "sent_no")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as augmentation rows, src_id being the sentence's key."""
    return sentences(spark, sf_dir).select(sentence_key().alias("src_id"), "text", "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spread(load(spark, sf_dir, "conversations"), "conv_id")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("s1"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2")
    )
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", "s1", "s2")


# DuckDB twins (views registered by the driver) -------------------------------

DUCK_LABELLED = (
    "(SELECT d.doc_id AS src_id, d.text, l.quality AS label, d.lang, d.source "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)

DUCK_SENTENCES = (
    "(SELECT src_id, sent_no, text, label FROM ("
    "SELECT src_id, label, unnest(string_split(text, chr(10))) AS text, "
    "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_no "
    f"FROM {DUCK_LABELLED}) WHERE {T.duck_not_blank('text')})"
)

DUCK_PAIRS = (
    "(SELECT u.conv_id, u.turn, u.text AS s1, a.text AS s2 FROM conversations u "
    "JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant')"
)

DUCK_SENTENCE_KEY = "concat_ws(':', src_id, sent_no)"

DUCK_SENTENCE_ROWS = f"(SELECT {DUCK_SENTENCE_KEY} AS src_id, text, label FROM {DUCK_SENTENCES})"
