"""Row-local operators on Structured Streaming.

AEDA (A6), random deletion (A4) and letter cleaning (T1) keep no state across
rows, and every draw is keyed by (src_id, copy), so a micro-batch result
equals the batch result for the same rows whatever the trigger sizes are.
The stream side is a folder of document files; labels are a static table
(stream-static join).

Results go to a folder of Parquet files whose log names each finished batch once: a query that
is stopped, or loses its driver, between or within files goes on from its checkpoint, and a batch
that runs again replaces its own files. ``read_output`` reads that log, so half-written batches
don't show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augmill.functions import text as T
from augmill.operators.aeda import aeda
from augmill.operators.eda import single_technique
from augmill.sources import tables as TB


def labelled_stream(spark: SparkSession, sf_dir: str, max_files: int = 1, folder: str | None = None) -> DataFrame:
    """(src_id, text, label) of the document files of ``folder`` (by default those beside the tables), as they arrive."""
    schema = TB.load(spark, sf_dir, "documents").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    docs = reader.parquet(folder) if folder else reader.option("pathGlobFilter", "documents*.parquet").parquet(sf_dir)
    labs = TB.load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labs, "doc_id").select(F.col("doc_id").alias("src_id"), "text",
                                            F.col("quality").alias("label"))


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch of ``rows`` to ``path`` once; ``checkpoint`` is where the next start goes on."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(path)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches."""
    return spark.read.parquet(path)


def stream_aeda(rows: DataFrame, path: str, checkpoint: str, naug: int = 2) -> StreamingQuery:
    """Originals and marked copies."""
    return start(aeda(rows, naug=naug), path, checkpoint)


def stream_deletion(rows: DataFrame, path: str, checkpoint: str, naug: int = 2, p: float = 0.1) -> StreamingQuery:
    """A4: copies from which words are deleted at random."""
    return start(single_technique(rows, None, "rd", naug=naug, alpha=p), path, checkpoint)


def stream_clean(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Cleaned texts."""
    return start(rows.select("src_id", T.clean_letters(F.col("text")).alias("text"), "label"), path, checkpoint)
