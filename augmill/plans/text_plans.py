"""Registered text scalar queries (T-rows): whole texts of the labelled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.plans.registry import register
from augmill.sources import tables as TB

L = TB.DUCK_LABELLED
S = TB.DUCK_SENTENCES


@register("clean_letters", f"SELECT src_id, {T.duck_clean_letters('text')} AS text FROM {L}")
def q_clean_letters(spark, sf_dir):
    return TB.labelled(spark, sf_dir).select("src_id", T.clean_letters(F.col("text")).alias("text"))


@register("clean_decoded", f"SELECT src_id, {T.duck_clean_decoded('text')} AS text FROM {L}")
def q_clean_decoded(spark, sf_dir):
    return TB.labelled(spark, sf_dir).select("src_id", T.clean_decoded(F.col("text")).alias("text"))


@register(
    "tokenize",
    f"""SELECT src_id, len(string_split(text, ' '))::BIGINT AS n_space,
        len({T.duck_split_nonempty('text')})::BIGINT AS n_nonempty,
        len({T.duck_split_ws('text')})::BIGINT AS n_ws,
        array_to_string({T.duck_split_ws('text')}, '|') AS ws_tokens FROM {L}""",
)
def q_tokenize(spark, sf_dir):
    t = F.col("text")
    return TB.labelled(spark, sf_dir).select(
        "src_id",
        F.size(T.split_keep_empty(t)).cast("bigint").alias("n_space"),
        F.size(T.split_nonempty(t)).cast("bigint").alias("n_nonempty"),
        F.size(T.split_ws(t)).cast("bigint").alias("n_ws"),
        F.array_join(T.split_ws(t), "|").alias("ws_tokens"),
    )


@register(
    "stop_word_counts",
    f"""SELECT word, count(*)::BIGINT AS cnt FROM (
          SELECT unnest(string_split({T.duck_clean_letters('text')}, ' ')) AS word FROM {L})
        WHERE list_contains({T.duck_str_list(T.STOP_WORDS)}, word) GROUP BY word""",
)
def q_stop_word_counts(spark, sf_dir):
    toks = TB.labelled(spark, sf_dir).select(F.explode(F.split(T.clean_letters(F.col("text")), " ")).alias("word"))
    return toks.where(T.is_stop(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


@register(
    "blank_filter",
    f"""SELECT src_id, count(*)::BIGINT AS n_lines,
        count(*) FILTER (WHERE {T.duck_not_blank('line')})::BIGINT AS n_nonblank FROM (
          SELECT src_id, unnest(string_split(text, chr(10))) AS line FROM {L}) GROUP BY src_id""",
)
def q_blank_filter(spark, sf_dir):
    lines = TB.labelled(spark, sf_dir).select("src_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("src_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(T.not_blank(F.col("line")), 1)).alias("n_nonblank"),
    )


@register(
    "min_length_filter",
    f"""SELECT src_id, sent_no, len({T.duck_split_ws('text')})::BIGINT AS n_words, label
        FROM {S} WHERE len({T.duck_split_ws('text')}) >= 3""",
)
def q_min_length_filter(spark, sf_dir):
    s = TB.sentences(spark, sf_dir).withColumn("n_words", F.size(T.split_ws(F.col("text"))).cast("bigint"))
    return s.where(F.col("n_words") >= 3).select("src_id", "sent_no", "n_words", "label")


@register(
    "truncate_words",
    f"""SELECT src_id, len({T.duck_split_ws('text')})::BIGINT AS n_words,
        len({T.duck_split_ws('text')}[1:510])::BIGINT AS n_kept,
        array_to_string({T.duck_split_ws('text')}[1:510], ' ') AS text FROM {L}""",
)
def q_truncate_words(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir).withColumn("w", T.split_ws(F.col("text")))
    return lab.select(
        "src_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.size(T.truncate(F.col("w"), 510)).cast("bigint").alias("n_kept"),
        F.array_join(T.truncate(F.col("w"), 510), " ").alias("text"),
    )


@register(
    "lower_strip",
    f"""SELECT src_id, sent_no,
        lower({T.duck_strip('text')}) AS text FROM {S}""",
)
def q_lower_strip(spark, sf_dir):
    return TB.sentences(spark, sf_dir).select("src_id", "sent_no", T.lower_strip(F.col("text")).alias("text"))


@register(
    "normalise_hypothesis",
    f"SELECT conv_id, turn, replace(replace(s2, '|||', ''), '  ', ' ') AS text FROM {TB.DUCK_PAIRS}",
)
def q_normalise_hypothesis(spark, sf_dir):
    return TB.pairs(spark, sf_dir).select("conv_id", "turn", T.normalise_hypothesis(F.col("s2")).alias("text"))
