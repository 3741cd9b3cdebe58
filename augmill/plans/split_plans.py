"""Registered sampling / split / label queries (P-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators import splits as SP
from augmill.operators.aeda import aeda, aeda_sql
from augmill.plans.registry import register
from augmill.session import cut_lineage
from augmill.sources import tables as TB

L = TB.DUCK_LABELLED
NAUG = 2


def _duck_key(purpose, seed, col):
    return f"md5(concat_ws('|', '{purpose}', '{seed}', {col}))"


@register("label_counts", f"SELECT label, count(*)::BIGINT AS cnt FROM {L} GROUP BY label")
def q_label_counts(spark, sf_dir):
    return SP.label_counts(TB.labelled(spark, sf_dir))


@register(
    "undersample",
    f"""WITH x AS (SELECT src_id, label,
          row_number() OVER (PARTITION BY label ORDER BY {_duck_key('undersample', 42, 'src_id')}, src_id) - 1 AS idx,
          count(*) OVER (PARTITION BY label) AS n FROM {L})
        SELECT src_id, label FROM x
        WHERE label NOT IN (1, 2, 3, 4, 5) OR idx < round_even(0.1::DOUBLE * n, 0)""",
)
def q_undersample(spark, sf_dir):
    return SP.undersample(TB.labelled(spark, sf_dir)).select("src_id", "label")


@register(
    "label_index",
    f"""WITH f AS (SELECT label, min(src_id) AS first FROM {L} GROUP BY label),
        i AS (SELECT label, row_number() OVER (ORDER BY first, label) - 1 AS label_idx FROM f)
        SELECT l.src_id, l.label, i.label_idx FROM {L} l JOIN i ON l.label = i.label""",
)
def q_label_index(spark, sf_dir):
    return SP.label_index(TB.labelled(spark, sf_dir)).select("src_id", "label", "label_idx")


def _duck_split2(rel, id_expr, frac=0.1):
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {_duck_key('split', 93, id_expr)}, {id_expr}) - 1
                < ceil({frac}::DOUBLE * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM {rel}"""


@register("split_two_way", f"SELECT src_id, label, split FROM ({_duck_split2(L, 'src_id')})")
def q_split_two_way(spark, sf_dir):
    return SP.split_two_way(TB.labelled(spark, sf_dir)).select("src_id", "label", "split")


@register(
    "split_three_way",
    f"""WITH x AS (SELECT src_id, label,
          row_number() OVER (ORDER BY {_duck_key('split', 93, 'src_id')}, src_id) - 1 AS idx,
          ceil(0.4::DOUBLE * count(*) OVER ()) AS n_hold FROM {L})
        SELECT src_id, label, CASE WHEN idx < ceil(0.5::DOUBLE * n_hold) THEN 'test'
                                   WHEN idx < n_hold THEN 'val' ELSE 'train' END AS split FROM x""",
)
def q_split_three_way(spark, sf_dir):
    return SP.split_three_way(TB.labelled(spark, sf_dir)).select("src_id", "label", "split")


_AEDA = f"({aeda_sql(L, naug=NAUG)})"
_GROUP_SPLIT = f"""(SELECT a.*, s.split FROM {_AEDA} a JOIN
    ({_duck_split2('(SELECT DISTINCT src_id FROM ' + _AEDA + ')', 'src_id')}) s ON a.src_id = s.src_id)"""
_ROW_SPLIT = f"""(SELECT * EXCLUDE (rid) FROM ({_duck_split2(
    "(SELECT *, concat_ws(':', src_id, copy_no) AS rid FROM " + _AEDA + ")", 'rid')}))"""


@register("group_split", f"SELECT src_id, copy_no, split FROM {_GROUP_SPLIT}")
def q_group_split(spark, sf_dir):
    aug = aeda(TB.labelled(spark, sf_dir), naug=NAUG)
    return SP.group_split(aug).select("src_id", "copy_no", "split")


def _duck_leak(rel, policy):
    key = f"md5({T.duck_clean_letters('text')})"
    return f"""(WITH s AS (SELECT *, {key} AS tkey FROM {rel}),
        tr AS (SELECT * FROM s WHERE split = 'train'), h AS (SELECT * FROM s WHERE split <> 'train')
        SELECT '{policy}' AS policy, count(*)::BIGINT AS n_heldout,
          count(*) FILTER (WHERE src_id IN (SELECT src_id FROM tr))::BIGINT AS n_src_leak,
          count(*) FILTER (WHERE tkey IN (SELECT tkey FROM tr))::BIGINT AS n_text_leak FROM h)"""


@register("leak_audit", f"{_duck_leak(_ROW_SPLIT, 'row')} UNION ALL {_duck_leak(_GROUP_SPLIT, 'group')}")
def q_leak_audit(spark, sf_dir):
    aug = aeda(TB.labelled(spark, sf_dir), naug=NAUG)
    # the audit reads the augmented keys six times: materialise the narrow key
    # table once in the shared checkpoint folder instead of re-running AEDA
    keys = cut_lineage(aug.select("src_id", "copy_no", F.md5(T.clean_letters(F.col("text"))).alias("tkey")))
    key = F.col("tkey")
    return SP.leak_audit(SP.row_split(keys), "row", key).unionByName(
        SP.leak_audit(SP.group_split(keys), "group", key)
    )
