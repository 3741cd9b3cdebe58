"""Registered source/sink queries (S-rows): round trips through the shared
checkpoint folder, checked against the parquet tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators import corpus as C
from augmill.plans.corpus_plans import _VECS, _duck_l2, _tag
from augmill.plans.registry import register
from augmill.session import ensure_checkpoint_dir
from augmill.sources import files as FS
from augmill.sources import tables as TB


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "augmill-io", f"{name}-{uuid.uuid4().hex}")


@register("labelled_csv_roundtrip", f"SELECT text, CAST(label AS VARCHAR) AS label FROM {TB.DUCK_LABELLED}")
def q_labelled_csv_roundtrip(spark, sf_dir):
    """S10 writes the labelled table as header CSV (quotes, commas, newlines
    inside texts); S1 reads it back with an explicit text/label check."""
    path = _scratch(spark, "labelled-csv")
    lab = TB.labelled(spark, sf_dir).select("text", F.col("label").cast("string").alias("label"))
    lab.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return FS.read_labelled_csv(spark, path)


@register("augmented_parquet_roundtrip", f"""SELECT 'aeda' AS technique,
    (count(*) FILTER (WHERE {T.duck_not_blank('text')}) + 2 * count(*))::BIGINT AS n_rows,
    count(DISTINCT src_id)::BIGINT AS n_src FROM {TB.DUCK_LABELLED}""")
def q_augmented_parquet_roundtrip(spark, sf_dir):
    """S10 (parquet, partitioned by technique) then read back by partition."""
    from augmill.operators.aeda import aeda

    path = _scratch(spark, "augmented")
    FS.write_augmented(aeda(TB.labelled(spark, sf_dir), naug=2), path)
    back = spark.read.parquet(path)
    return back.groupBy("technique").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("src_id").alias("n_src"))


_1252 = FS.WINDOWS_1252


@register("positional_csv", f"""SELECT regexp_replace(text, '[^\\x00-\\x7F\\xA0-\\xFF{_1252}]', '?', 'g') AS text,
    CAST(label AS VARCHAR) AS label FROM {TB.DUCK_LABELLED}""")
def q_positional_csv(spark, sf_dir):
    """The labelled table as a Windows-1252 file and back."""
    path = _scratch(spark, "positional")
    FS.write_positional_csv(TB.labelled(spark, sf_dir), path, "windows-1252")
    return FS.read_positional_csv(spark, path, "windows-1252")


_ONE_LINE = "regexp_replace({x}, '[\\t\\r\\n]+', ' ', 'g')"


def _turns(spark, sf_dir):
    """User turns with the assistant's next turn, if there is one, each on one line."""
    conv = TB.load(spark, sf_dir, "conversations")
    one_line = F.regexp_replace("text", "[\\t\\r\\n]+", " ")
    u = conv.where("role = 'user'").select("conv_id", "turn", one_line.alias("s1"))
    a = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), one_line.alias("s2"))
    return u.join(a, ["conv_id", "turn"], "left")


_DUCK_TURNS = f"""(SELECT u.turn, {_ONE_LINE.format(x='u.text')} AS s1, {_ONE_LINE.format(x='a.text')} AS s2 FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@register("pair_tsv", f"""SELECT s2 IS NOT NULL AS good, CASE WHEN s2 IS NOT NULL THEN lower({T.duck_strip('s1')}) END AS f1,
    CASE WHEN s2 IS NOT NULL THEN lower({T.duck_strip('s2')}) END AS f2, concat_ws(chr(9), s1, s2) AS raw FROM {_DUCK_TURNS}""")
def q_pair_tsv(spark, sf_dir):
    """Pairs as lower-cased fields; turns without an answer are lines of one field, which go to the rejects."""
    path = _scratch(spark, "pairs")
    _turns(spark, sf_dir).select(F.concat_ws("\t", "s1", "s2").alias("value")).write.text(path)
    good, bad = FS.read_tsv_fields(spark, path, 2, lower=True)
    return good.select(F.lit(True).alias("good"), "f1", "f2", "raw").unionByName(
        bad.select(F.lit(False).alias("good"), F.lit(None).cast("string").alias("f1"), F.lit(None).cast("string").alias("f2"), "raw"))


@register("sts_tsv", f"""SELECT s2 IS NOT NULL AS good, CASE WHEN s2 IS NOT NULL THEN turn::DOUBLE END AS score,
    CASE WHEN s2 IS NOT NULL THEN s1 END AS s1, s2 FROM {_DUCK_TURNS}""")
def q_sts_tsv(spark, sf_dir):
    """Lines of seven fields, and of six, which go to the rejects."""
    path = _scratch(spark, "sts")
    _turns(spark, sf_dir).select(F.concat_ws("\t", F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.col("turn"), "s1", "s2").alias("value")).write.text(path)
    good, bad = FS.sts_rows(spark, path)
    none = F.lit(None)
    return good.select(F.lit(True).alias("good"), "score", "s1", "s2").unionByName(bad.select(
        F.lit(False).alias("good"), none.cast("double").alias("score"), none.cast("string").alias("s1"), none.cast("string").alias("s2")))


@register("word_vector_file", f"WITH {_VECS} SELECT word, len(vec)::INTEGER AS dim, round({_duck_l2('vec')}, 6) AS norm FROM wv")
def q_word_vector_file(spark, sf_dir):
    """The words' vectors as a text file and back."""
    path = _scratch(spark, "vectors")
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    vecs.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value")).write.text(path)
    return FS.read_word_vectors(spark, path).select("word", F.size("vec").alias("dim"), F.round(C.l2(F.col("vec")), 6).alias("norm"))


def _tagged(spark, sf_dir):
    """(src_id, sent_no, sent, pos): every sentence's words and tags, joined by single spaces."""
    words = TB.sentences(spark, sf_dir).select("src_id", "sent_no", T.split_ws(F.lower("text")).alias("w"))
    return words.select("src_id", "sent_no", F.size("w").alias("len_bucket"), F.array_join("w", " ").alias("sent"),
                        F.array_join(F.transform("w", C.suffix_tag), " ").alias("pos"))


_DUCK_TAGGED = f"""(SELECT src_id, sent_no, len(w)::INTEGER AS len_bucket, array_to_string(w, ' ') AS sent,
    array_to_string(list_transform(w, lambda x: {_tag('x')}), ' ') AS pos
    FROM (SELECT src_id, sent_no, {T.duck_split_ws('lower(text)')} AS w FROM {TB.DUCK_SENTENCES}))"""


@register("length_shards", f"SELECT len_bucket, sent, pos, concat('(S ', sent, ')') AS parse FROM {_DUCK_TAGGED}")
def q_length_shards(spark, sf_dir):
    """Sentences, tags and bracketed lines as one shard per length and back."""
    path = _scratch(spark, "shards")
    FS.write_length_shards(_tagged(spark, sf_dir).withColumn("parse", F.concat(F.lit("(S "), "sent", F.lit(")"))), path)
    return FS.read_length_shards(spark, path)


@register("aligned_tags", f"""SELECT row_number() OVER (ORDER BY src_id, sent_no) - 1 AS line_no, 'both' AS side, sent AS text, pos AS tags
    FROM {_DUCK_TAGGED}""")
def q_aligned_tags(spark, sf_dir):
    """A data file and a tag file without a key, met line by line; lines without a partner would be rows of their side."""
    rows = _tagged(spark, sf_dir)
    sides = []
    for column in ("sent", "pos"):  # the files of either are cut where Spark likes; only the order of lines is the same
        path = _scratch(spark, column)
        rows.sort("src_id", "sent_no").select(F.col(column).alias("value")).write.option("lineSep", "\n").text(path)
        sides.append(FS.numbered_lines(spark, path))
    met, alone = FS.align_lines(*sides)
    return met.select("line_no", F.lit("both").alias("side"), "text", "tags").unionByName(
        alone.select("line_no", "side", F.col("value").alias("text"), F.lit(None).cast("string").alias("tags")))


@register("generated_tsv", f"""SELECT row_number() OVER (ORDER BY src_id, sent_no) - 1 AS line_no,
    {_ONE_LINE.format(x='text')} AS text, label::VARCHAR AS label FROM {TB.DUCK_SENTENCES}""")
def q_generated_tsv(spark, sf_dir):
    """Generated rows, written in order and read back with their places."""
    path = _scratch(spark, "generated")
    FS.write_generated_tsv(TB.sentences(spark, sf_dir), path, ["src_id", "sent_no"])
    return FS.read_generated_tsv(spark, path)
