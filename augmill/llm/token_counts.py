"""Token counts behind a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). A run joins
the digests of its texts to it, encodes each distinct text that it lacks once, appends
those counts, and reads every row's count from the table. The content digest is the
SHA-256 of the normalised text; the only normalisation that can't change a count is
"null is empty", so it is the only one. The tokenizer digest is the SHA-256 of its
file, so another vocabulary never reads these counts.

Edge cases: a null or empty text has no bytes and 0 tokens; each repeated row gives its
row (one encoding in all); rows with a null id stay; an empty table gives an empty table
and an empty cache. Only the id and the text are read, so other columns may clash.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augmill.sources.tables import load

from .common import shared_path
from .registry import register

SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"

#: Stands for a null id in the join that fetches the texts; what the id is doesn't matter there.
_NO_ID = -(1 << 63)


@lru_cache(maxsize=2)
def _counter(path: str):
    """texts -> counts, by the library that the file's ending names."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(x)) for x in texts]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content_digest, n_tokens) of one tokenizer; empty if there is no cache yet.
    Runs that append at the same time may store a count twice; it is the same count."""
    try:
        table = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], SCHEMA)
    return table.where(F.col("tokenizer_digest") == tokenizer).groupBy("content_digest").agg(
        F.min("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. ``path``: the tokenizer's file, which every
    executor has; ``cache``: a folder that driver and executors share. The call itself
    fills the cache."""
    spark, tokenizer = df.sparkSession, tokenizer_digest(path)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content_digest"))
    # One row of each distinct text: the smallest id. Only ids and digests move here; a text
    # that a third of the rows share is reduced before the shuffle.
    key = F.coalesce(F.col("id").cast("bigint"), F.lit(_NO_ID))
    one = rows.select("content_digest", key.alias("key")).groupBy("content_digest").agg(F.min("key").alias("key"))
    missing = one.join(read_cache(spark, cache, tokenizer), "content_digest", "left_anti")
    # Rows that repeat the id and the text (or have none) are one miss; the join has dealt them out by both already.
    texts = rows.withColumn("key", key).join(missing, ["key", "content_digest"], "left_semi").dropDuplicates(["key", "content_digest"])

    def work(batches):
        count = _counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())],
                                                 names=["content_digest", "n_tokens"])

    counted = texts.select("content_digest", "text").mapInArrow(work, "content_digest binary, n_tokens bigint")
    counted.select("content_digest", F.lit(tokenizer).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(spark, cache, tokenizer)
    counts = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest")
    return counts.join(known, "content_digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own each time, so that a run never finds the counts of an earlier one."""
    import public_tokenizers as P

    counts = count_tokens(load(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), shared_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
