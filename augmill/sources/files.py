"""File sources and sinks (S1-S12) with explicit schemas.

CSV/TSV are read with Spark's own readers; rows that don't fit a format are
returned beside the good ones, never lost. Files that belong together line by
line are aligned by global line numbers (:func:`numbered_lines`), which come
from the files' splits and not from the order in which tasks deliver them.
:func:`materialize` keeps a computed table once in a shared folder, under a key
of its inputs and parameters.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augmill.functions import text as T


def read_labelled_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with ``text`` and ``label`` columns (quotes, embedded
    newlines, BOM handled); fails fast when a column is missing."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .option("encoding", encoding).csv(path))
    missing = {"text", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"CSV needs 'text', 'label' (missing {sorted(missing)})")
    return df.select("text", "label")


# Windows-1252 is ISO-8859-1 but for these characters, in the order of their bytes;
# five of the 32 bytes have none.
WINDOWS_1252_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
WINDOWS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
ONE_BYTE = {"windows-1252", "cp1252"}

#: A raw CSV record of a single field, quoted or not.
_ONE_FIELD = r'^(?s:"(?:[^"]|"")*"[^,]*|[^,"][^,]*|)$'


def positional_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Header skipped, column 0 = text, column 1 = label; blanks are ''. Returns the good rows
    and the raw records of fewer than two fields. Windows-1252, which Spark's readers don't
    take, is read as ISO-8859-1 with the 27 characters that differ put right."""
    one_byte = encoding.lower() in ONE_BYTE
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("encoding", "ISO-8859-1" if one_byte else encoding))
    names = [f"c{i}" for i in range(max(2, len(reader.csv(path).columns)))]
    raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").option("enforceSchema", True).schema(
        ", ".join(f"{c} string" for c in names) + ", _raw string").csv(path)

    def put_right(c: str) -> Column:
        return F.translate(c, WINDOWS_1252_BYTES, WINDOWS_1252) if one_byte else F.col(c)

    # a record of another number of fields than the header's is kept raw too; it is short only with one field
    short = F.col("c1").isNull() & F.col("_raw").isNotNull() & F.col("_raw").rlike(_ONE_FIELD)
    good = raw.where(~F.coalesce(short, F.lit(False))).select(*[F.coalesce(put_right(c), F.lit("")).alias(n) for c, n in zip(names, ("text", "label"))])
    return good, raw.where(short).select(put_right("_raw").alias("raw"))


def read_positional_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The good rows of :func:`positional_csv`."""
    return positional_csv(spark, path, encoding)[0]


def write_positional_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """S2/S3 sink: header ``sentence,label``. Characters that Windows-1252 lacks become '?'."""
    one_byte = encoding.lower() in ONE_BYTE
    text = F.translate("text", WINDOWS_1252, WINDOWS_1252_BYTES) if one_byte else F.col("text")
    (df.select(text.alias("sentence"), F.col("label").cast("string").alias("label")).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("encoding", "ISO-8859-1" if one_byte else encoding).csv(path))


def read_tsv_fields(spark: SparkSession, path: str, n_fields: int, lower: bool = False):
    """Strip, split on TAB; rows with the wrong field count go to the
    reject frame. Returns (good with f1..fn, rejects)."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("_line", T.strip(F.col("value")))
    if lower:
        lines = lines.withColumn("_line", F.lower("_line"))
    lines = lines.where(F.col("_line") != "").withColumn("_f", F.split("_line", "\t"))
    good = lines.where(F.size("_f") == n_fields).select(
        *[F.col("_f")[i].alias(f"f{i + 1}") for i in range(n_fields)], F.col("value").alias("raw"))
    bad = lines.where(F.size("_f") != n_fields).select(F.col("value").alias("raw"))
    return good, bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file, or of a folder's files in the order of their names, from 0.

    A line's number is its place in its split plus the lines of all splits before it: a first
    aggregation counts the lines of each (file, split start), one row per split, whose running sum
    is small; the second scan adds it. No line moves, and the numbers don't depend on which task
    reads what. Lines end with a newline; a carriage return is part of its line."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), "value")
    splits = lines.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_row").alias("first"), F.max("_row").alias("last"))
    # a split is read in one piece by one task; were it not, its rows' numbers would have gaps
    first = F.when(F.col("last") - F.col("first") + 1 == F.col("n"), F.col("first")).otherwise(
        F.raise_error("the lines of a split aren't numbered in a row").cast("bigint"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - first).alias("_shift"))
    return lines.join(offsets, ["_file", "_start"]).select((F.col("_row") + F.col("_shift")).alias("line_no"), "value")


def align_lines(data: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered lines of a data file and of its tag file, row by row. Returns (line_no, text, tags), and
    the lines of either that have no partner as (line_no, side, value)."""
    both = data.select("line_no", F.col("value").alias("text"), F.lit(True).alias("_d")).join(
        tags.select("line_no", F.col("value").alias("tags"), F.lit(True).alias("_t")), "line_no", "full_outer")
    matched = both.where("_d AND _t").select("line_no", "text", "tags")
    alone = both.where("_d IS NULL OR _t IS NULL").select(
        "line_no", F.when(F.col("_d"), F.lit("data")).otherwise(F.lit("tags")).alias("side"), F.coalesce("text", "tags").alias("value"))
    return matched, alone


def align_parallel(data: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """S6 for tables that have a key: raises when the counts differ (the
    reference asserts equal lengths)."""
    joined = data.join(tags, key, "full_outer")
    unmatched = joined.where(F.col(key).isNull() | F.col("tags").isNull() | F.col("text").isNull()).count()
    if unmatched:
        raise ValueError(f"{unmatched} rows without a partner in the parallel file")
    return joined


def read_word_vectors(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S7: 'word f1 f2 ...' lines (latin-1 or UTF-8) -> (word, vec ARRAY<FLOAT>)."""
    raw = (spark.read.option("sep", "\u0001").option("quote", "\u0000").option("encoding", encoding)
           .schema("line STRING").csv(path))
    parts = F.split(F.col("line"), " ")
    return raw.select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts) - 1),
                                                          lambda x: x.cast("float")).alias("vec"))


def sts_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """TSV, fields 4, 5, 6 (0-based) = score, s1, s2. Returns the good rows and the raw lines of
    fewer fields or without a number for a score."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.split("value", "\t").alias("f"))
    score = F.expr("try_cast(get(f, 4) AS double)")
    fits = (F.size("f") >= 7) & score.isNotNull()
    good = rows.where(fits).select(score.alias("score"), F.col("f")[5].alias("s1"), F.col("f")[6].alias("s2"))
    return good, rows.where(~fits).select(F.col("value").alias("raw"))


def read_sts(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of :func:`sts_rows`."""
    return sts_rows(spark, path)[0]


def read_length_shards(spark: SparkSession, folder: str, kind: str = "candidates") -> DataFrame:
    """``{i}_{kind}.txt`` shards, files or folders of part files -> (len_bucket, sent, pos, parse)."""
    df = spark.read.option("lineSep", "\n").text(os.path.join(folder, f"*_{kind}.txt")).withColumn("_file", F.col("_metadata.file_path"))
    f = F.split(F.trim(F.col("value")), "\t")
    return df.select(F.regexp_extract("_file", r"/(\d+)_" + kind + r"\.txt(?:/[^/]*)?$", 1).cast("int").alias("len_bucket"),
                     F.trim(f[0]).alias("sent"), F.trim(F.get(f, F.lit(1))).alias("pos"), F.trim(F.get(f, F.lit(2))).alias("parse"))


def write_length_shards(df: DataFrame, folder: str, kind: str = "candidates") -> None:
    """S9 sink: (len_bucket, sent, pos, parse) as folders ``{i}_{kind}.txt`` of part files, one job for all lengths."""
    spark, aside = df.sparkSession, os.path.join(folder, f"_aside-{uuid.uuid4().hex}")
    df.select("len_bucket", F.concat_ws("\t", "sent", "pos", "parse").alias("value")).write.partitionBy("len_bucket").option("lineSep", "\n").text(aside)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(aside)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in fs.listStatus(root):  # as many as there are lengths
        name = shard.getPath().getName()
        if name.startswith("len_bucket="):
            fs.rename(shard.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{name.split('=')[1]}_{kind}.txt"))
    fs.delete(root, True)


def write_augmented(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Originals and augmented rows, partitioned by technique."""
    w = df.write.mode("overwrite").partitionBy("technique")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.parquet(path)


def write_generated_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """``text<TAB>label`` lines, no header; in the order of the columns ``order``, if given, over
    the files in the order of their names."""
    one_line = F.regexp_replace("text", r"[\t\r\n]+", " ")  # a separator inside a text would break its row
    rows = df.sort(*order) if order else df
    rows.select(F.concat(F.coalesce(one_line, F.lit("")), F.lit("\t"), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("value")) \
        .write.mode("overwrite").option("lineSep", "\n").text(path)


def read_generated_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text, label) of generated text, numbered in the order it was written in."""
    f = F.split("value", "\t")
    return numbered_lines(spark, path).select("line_no", f[0].alias("text"), F.get(f, F.lit(1)).alias("label"))


def materialize(spark: SparkSession, build, path: str, inputs: tuple[str, ...] = (), **params) -> DataFrame:
    """The table that ``build`` computes, kept under ``path`` for one state of its inputs.

    The key is a digest of the input files' names, lengths and times and of ``params``, so changed
    files or parameters build anew and an old result is never read for them. A build is written
    aside and published by a rename that fails if the key is there already: of several writers one
    wins, the others drop their copy and read the winner's."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def hadoop(p: str):
        place = jvm.org.apache.hadoop.fs.Path(p)
        return place, place.getFileSystem(conf)

    state = [json.dumps(params, sort_keys=True)]
    for source in inputs:
        place, fs = hadoop(source)
        found = fs.listFiles(place, True)
        files = []
        while found.hasNext():
            f = found.next()
            files.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        state += sorted(files)
    key = hashlib.sha256("\n".join(state).encode()).hexdigest()[:32]
    final, aside = os.path.join(path, key), os.path.join(path, f"_aside-{uuid.uuid4().hex}")
    place, fs = hadoop(final)
    if not fs.exists(place):
        build().write.parquet(aside)
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
            files.rename(hadoop(aside)[0], place, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(hadoop(aside)[0], True)
            if not fs.exists(place):
                raise e
    return spark.read.parquet(final)
