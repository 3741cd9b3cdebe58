"""Registered generated-text evaluation queries (G-rows).

Hypotheses are random-deletion copies (A4) of the cleaned sentences, the
references are the cleaned sentences themselves. Trees for the bracket
metrics are built from all sentences: the gold tree groups words
in threes under suffix-rule tags, the predicted tree groups them in twos
under a stop-word tagger.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.functions.stem import duck_stems
from augmill.operators import corpus as C
from augmill.operators import eda as E
from augmill.operators import meteor as MT
from augmill.operators import textscore as G
from augmill.operators.common import barrier
from augmill.plans.lexicon_plans import corpus_lexicon
from augmill.plans.registry import register
from augmill.session import cut_lineage
from augmill.sources import tables as TB

D = E.D
_CL = T.duck_clean_letters("text")
_STOP = T.duck_str_list(T.STOP_WORDS)


def _refs(spark, sf_dir):
    # dealt out by sid while they are texts: what is worked out per sentence from here on stays where it is
    s = TB.sentences(spark, sf_dir).select(TB.sentence_key().alias("sid"), "text").repartition("sid")
    return barrier(s.select("sid", "text"), r=T.split_nonempty(T.clean_letters(F.col("text")))).select("sid", "r")


def _pairs(spark, sf_dir):
    ref = _refs(spark, sf_dir).withColumn("n", F.size("r").cast("bigint")).where("n > 0")
    h = E.random_deletion(ref.select(F.col("sid").alias("src_id"), F.lit(1).cast("bigint").alias("cand"),
                                     F.col("r").alias("words"), "n", "r"), 0.1, seed=1)
    return h.select(F.col("src_id").alias("sid"), F.col("new_words").alias("h"), "r")


_rd = dict(E.duck_tech("rd", 0.1, 1))
DUCK_BASE = f"""refs AS (SELECT {TB.DUCK_SENTENCE_KEY} AS sid,
      list_filter(string_split({_CL}, ' '), lambda x: x <> '') AS r FROM {TB.DUCK_SENTENCES}),
  rd0 AS (SELECT sid AS src_id, 1::BIGINT AS cand, r AS words, len(r)::BIGINT AS n, r FROM refs WHERE len(r) > 0),
  rd1 AS (SELECT *, {_rd['_kept']} AS _kept FROM rd0),
  pairs AS (SELECT src_id AS sid, {_rd['new_words']} AS h, r FROM rd1)"""


def _duck_ngrams(col, n):
    return (f"CASE WHEN len({col}) >= {n} THEN list_transform(range(1, len({col}) - {n - 1} + 1), "
            f"lambda i: array_to_string({col}[i:i + {n - 1}], ' ')) ELSE [] END")


def _duck_overlap(n_max, limit=None):
    hcol = f"h[1:{limit}]" if limit else "h"
    rcol = f"r[1:{limit}]" if limit else "r"

    def grams(col, out):
        parts = " UNION ALL ".join(f"SELECT sid, {n} AS n, unnest({_duck_ngrams(col, n)}) AS g FROM pairs"
                                   for n in range(1, n_max + 1))
        return f"(SELECT sid, n, g, count(*) AS {out} FROM ({parts}) GROUP BY ALL)"

    return f"""hg AS {grams(hcol, 'hc')}, rg AS {grams(rcol, 'rc')},
  mt AS (SELECT sid, n, sum(least(hc, rc)) AS match FROM hg JOIN rg USING (sid, n, g) GROUP BY ALL),
  ht AS (SELECT sid, n, sum(hc) AS h_total FROM hg GROUP BY ALL),
  rt AS (SELECT sid, n, sum(rc) AS r_total FROM rg GROUP BY ALL),
  ov AS (SELECT b.sid, b.n, coalesce(mt.match, 0) AS match, coalesce(ht.h_total, 0) AS h_total,
         coalesce(rt.r_total, 0) AS r_total FROM (SELECT sid, unnest(range(1, {n_max + 1})) AS n FROM pairs) b
         LEFT JOIN ht USING (sid, n) LEFT JOIN rt USING (sid, n) LEFT JOIN mt USING (sid, n))"""


@register("line_check", f"""WITH {DUCK_BASE}
  SELECT count(p.sid)::BIGINT AS n_hyp, count(r.sid)::BIGINT AS n_ref,
    count(*) FILTER (WHERE p.sid IS NULL)::BIGINT AS missing_hyp,
    count(*) FILTER (WHERE r.sid IS NULL)::BIGINT AS missing_ref
  FROM pairs p FULL OUTER JOIN refs r ON p.sid = r.sid""")
def q_line_check(spark, sf_dir):
    return G.line_check(_pairs(spark, sf_dir), _refs(spark, sf_dir))


_DUCK_BLEU = f"""{_duck_overlap(4)},
  o AS (SELECT n, sum(match) AS m, sum(h_total) AS t, sum(len(h)) AS c, sum(len(r)) AS rl
        FROM ov JOIN pairs USING (sid) GROUP BY n),
  s AS (SELECT min(CASE WHEN t > 0 THEN m / t ELSE 0.0 END) AS pmin,
        avg(ln(CASE WHEN m > 0 THEN m / t END)) AS logmean, max(c) AS c, max(rl) AS rl,
        max(CASE WHEN n = 1 THEN m / t END) AS p1, max(CASE WHEN n = 2 THEN m / t END) AS p2,
        max(CASE WHEN n = 3 THEN m / t END) AS p3, max(CASE WHEN n = 4 THEN m / t END) AS p4 FROM o),
  s2 AS (SELECT *, CASE WHEN c > rl THEN 1.0 ELSE exp(1.0 - rl / c) END AS bp FROM s),
  bleu AS (SELECT *, CASE WHEN pmin > 0 THEN bp * exp(logmean) * 100.0 ELSE 0.0 END AS bleu FROM s2)"""


@register("corpus_bleu", f"""WITH {DUCK_BASE}, {_DUCK_BLEU} SELECT round(bleu, 6) AS bleu, round(bp, 6) AS bp,
    round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4 FROM bleu""")
def q_corpus_bleu(spark, sf_dir):
    return G.corpus_bleu(_pairs(spark, sf_dir))


_ROUGE_N = f"""{_duck_overlap(2)},
  rf AS (SELECT sid, n, CASE WHEN match > 0 THEN 2 * (match / h_total) * (match / r_total) /
         ((match / h_total) + (match / r_total)) ELSE 0.0 END AS f FROM ov),
  rn AS (SELECT sid, max(CASE WHEN n = 1 THEN f END) AS rouge1, max(CASE WHEN n = 2 THEN f END) AS rouge2
         FROM rf GROUP BY sid)"""


@register("rouge_n", f"WITH {DUCK_BASE}, {_ROUGE_N} SELECT sid, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rn")
def q_rouge_n(spark, sf_dir):
    r = G.rouge_n(_pairs(spark, sf_dir))
    return r.select("sid", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


_STEMMED = f"""stems AS {duck_stems("(SELECT DISTINCT unnest(list_concat(h, r)) AS word FROM pairs0)")},
  side AS (SELECT sid, 0 AS s, generate_subscripts(h, 1) AS pos, unnest(h) AS word FROM pairs0
      UNION ALL SELECT sid, 1 AS s, generate_subscripts(r, 1) AS pos, unnest(r) AS word FROM pairs0),
  told AS (SELECT sid, coalesce(list(stem ORDER BY pos) FILTER (s = 0), []) AS h, coalesce(list(stem ORDER BY pos) FILTER (s = 1), []) AS r
      FROM side JOIN stems USING (word) GROUP BY sid),
  pairs AS (SELECT p.sid, coalesce(t.h, []) AS h, coalesce(t.r, []) AS r FROM pairs0 p LEFT JOIN told t USING (sid))"""


@register("rouge_stemmed", f"""WITH {DUCK_BASE.replace('  pairs AS', '  pairs0 AS')}, {_STEMMED}, {_ROUGE_N}
  SELECT sid, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rn""")
def q_rouge_stemmed(spark, sf_dir):
    """G3 over stems."""
    r = G.rouge_n(_pairs(spark, sf_dir), stem=True)
    return r.select("sid", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


# bit-parallel LCS with the state in limbs of 60 bits: [carry, limbs so far] runs over (state, mask, full) of each limb
_LCS = """rl0 AS (SELECT sid, h, r, list_transform(range(0, (len(r) + 59) // 60),
      lambda i: (1::BIGINT << least(60, len(r) - 60 * i)) - 1) AS full_ FROM pairs),
  rl1 AS (SELECT sid, h, r, full_, list_distinct(h) AS words, list_transform(list_distinct(h), lambda x: list_transform(range(1, len(full_) + 1),
      lambda i: list_reduce(list_transform(r[60 * i - 59:60 * i], lambda w, j: CASE WHEN w = x THEN 1::BIGINT << (j - 1) ELSE 0::BIGINT END),
                            lambda a, b: a | b, 0::BIGINT))) AS masks FROM rl0),
  rl2 AS (SELECT sid, len(h) AS nh, len(r) AS nr, list_reduce(list_transform(h, lambda x: masks[list_position(words, x)]), lambda v, m: list_reduce(list_transform(v, lambda x, i: [x, m[i], full_[i]]),
      lambda a, q: list_concat([(q[1] + (q[1] & q[2]) + a[1]) >> 60], list_append(a[2:],
          ((q[1] + (q[1] & q[2]) + a[1]) | (q[1] & ~q[2])) & q[3])), [0::BIGINT])[2:], full_) AS v FROM rl1),
  rl3 AS (SELECT sid, nh, nr, nr - coalesce(list_sum(list_transform(v, lambda x: bit_count(x))), 0) AS lcs FROM rl2),
  rl AS (SELECT sid, lcs, CASE WHEN lcs > 0 THEN 2 * (lcs / nh) * (lcs / nr) / ((lcs / nh) + (lcs / nr))
         ELSE 0.0 END AS rougel FROM rl3)"""


@register("rouge_l", f"WITH {DUCK_BASE}, {_LCS} SELECT sid, lcs::BIGINT AS lcs, round(rougel, 6) AS rougel FROM rl")
def q_rouge_l(spark, sf_dir):
    r = G.rouge_l(_pairs(spark, sf_dir))
    return r.select("sid", "lcs", F.round("rougel", 6).alias("rougel"))


_METEOR = """mt0 AS (SELECT sid, h, r, list_transform(h, lambda w, i: len(list_filter(h[1:i], lambda x: x = w))) AS _occ
         FROM pairs),
  mt1 AS (SELECT sid, h, r, list_transform(list_zip(h, _occ), lambda z: list_filter(range(1, greatest(len(r), 1) + 1),
         lambda j: r[j] = z[1])[z[2]]) AS _rp FROM mt0),
  mt2 AS (SELECT sid, len(h) AS nh, len(r) AS nr, len(list_filter(_rp, lambda x: x IS NOT NULL))::BIGINT AS matches,
         len(list_filter(list_transform(_rp, lambda j, i: CASE WHEN j IS NOT NULL AND NOT coalesce(CASE WHEN i > 1
         THEN _rp[i - 1] = j - 1 END, false) THEN 1 END), lambda x: x IS NOT NULL))::BIGINT AS chunks FROM mt1),
  me AS (SELECT sid, matches, chunks, CASE WHEN matches > 0 THEN (10 * (matches / nh) * (matches / nr) /
         ((matches / nr) + 9 * (matches / nh))) * (1 - 0.5 * pow(chunks / matches, 3)) ELSE 0.0 END AS meteor FROM mt2)"""


@register("meteor_exact", f"WITH {DUCK_BASE}, {_METEOR} SELECT sid, matches, chunks, round(meteor, 6) AS meteor FROM me")
def q_meteor(spark, sf_dir):
    m = G.meteor_exact(_pairs(spark, sf_dir))
    return m.select("sid", "matches", "chunks", F.round("meteor", 6).alias("meteor"))


def _turn_pairs(spark, sf_dir):
    """(sid, h, r): cleaned words of the user's turn and of the answer."""
    words = [T.split_nonempty(T.clean_letters(F.col(c))).alias(a) for c, a in (("s1", "h"), ("s2", "r"))]
    return TB.pairs(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("sid"), *words)


_TURN_PAIRS = f"""pairs0 AS (SELECT concat_ws(':', conv_id, turn) AS sid, {T.duck_split_nonempty(T.duck_clean_letters('s1'))} AS h,
    {T.duck_split_nonempty(T.duck_clean_letters('s2'))} AS r FROM {TB.DUCK_PAIRS})"""


@register("meteor_links", f"""WITH {_TURN_PAIRS}, {_STEMMED},
  wc AS (SELECT sid, word, stem, count(*) FILTER (s = 0) AS nh, count(*) FILTER (s = 1) AS nr FROM side JOIN stems USING (word) GROUP BY ALL),
  ex AS (SELECT sid, sum(least(nh, nr)) AS exact FROM wc GROUP BY sid),
  st AS (SELECT sid, sum(least(nh, nr)) AS stem FROM (SELECT sid, stem, sum(nh - least(nh, nr)) AS nh, sum(nr - least(nh, nr)) AS nr
      FROM wc GROUP BY ALL) GROUP BY sid)
  SELECT p.sid, coalesce(ex.exact, 0)::BIGINT AS exact, coalesce(st.stem, 0)::BIGINT AS stem FROM pairs0 p LEFT JOIN ex USING (sid) LEFT JOIN st USING (sid)""")
def q_meteor_links(spark, sf_dir):
    """Links of the exact and the stem stage, whose numbers SQL can tell."""
    return MT.meteor(_turn_pairs(spark, sf_dir)).select("sid", "exact", "stem")


@register("meteor_stages")
def q_meteor_stages(spark, sf_dir):
    """G5 with all stages, the corpus' lexicon being the last; the alignments are tested against all others (tests/test_meteor.py)."""
    m = MT.meteor(_turn_pairs(spark, sf_dir), corpus_lexicon(spark, sf_dir))
    return m.withColumn("meteor", F.round("meteor", 6))


# --- trees ----------------------------------------------------------------------

def _trees(spark, sf_dir):
    r = _refs(spark, sf_dir).withColumn("n", F.size("r")).where("n >= 1")
    plain_tag = lambda w: F.when(T.is_stop(w), "FUNC").otherwise("X")
    gold_tags, pred_tags = F.transform("r", C.suffix_tag), F.transform("r", plain_tag)
    return r.select("sid", F.col("n").cast("bigint").alias("len_bucket"), "r",
                    G.chunk_tree(F.col("r"), 3, tag=C.suffix_tag).alias("gold"),
                    G.chunk_tree(F.col("r"), 2, tag=plain_tag).alias("pred"),
                    gold_tags.alias("gold_tags"), pred_tags.alias("pred_tags"))


def _duck_tag(w):
    return (f"CASE WHEN list_contains({_STOP}, {w}) THEN 'FUNC' WHEN ends_with({w}, 'ing') THEN 'VBG' "
            f"WHEN ends_with({w}, 'ed') THEN 'VBD' WHEN ends_with({w}, 'tion') THEN 'NN' "
            f"WHEN ends_with({w}, 'ly') THEN 'RB' ELSE 'X' END")


def _duck_tree(size, tag_expr):
    leaves = f"list_transform(r, lambda x: '(' || {tag_expr} || ' ' || x || ')')"
    return (f"'(S ' || array_to_string(list_transform(range(0, CAST(ceil(len(r) / {size}) AS BIGINT)), lambda c: "
            f"'(P ' || array_to_string(({leaves})[c * {size} + 1:c * {size} + {size}], ' ') || ')'), ' ') || ')'")


DUCK_TREES = f"""trees AS (SELECT sid, len(r)::BIGINT AS len_bucket, r,
    {_duck_tree(3, _duck_tag('x'))} AS gold,
    {_duck_tree(2, f"CASE WHEN list_contains({_STOP}, x) THEN 'FUNC' ELSE 'X' END")} AS pred,
    list_transform(r, lambda x: {_duck_tag('x')}) AS gold_tags,
    list_transform(r, lambda x: CASE WHEN list_contains({_STOP}, x) THEN 'FUNC' ELSE 'X' END) AS pred_tags
    FROM refs WHERE len(r) >= 1)"""


def _duck_spans(col, name):
    return f"""{name}_t0 AS (SELECT sid, unnest(regexp_extract_all({col}, '\\(|\\)|[^()\\s]+')) AS tok,
      generate_subscripts(regexp_extract_all({col}, '\\(|\\)|[^()\\s]+'), 1) - 1 AS p FROM trees),
  {name}_t1 AS (SELECT *, lag(tok, 1) OVER w AS prev, lead(tok, 1) OVER w AS next1, lead(tok, 2) OVER w AS next2
      FROM {name}_t0 WINDOW w AS (PARTITION BY sid ORDER BY p)),
  {name}_t2 AS (SELECT *, coalesce(sum(CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END) OVER (PARTITION BY sid
      ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth,
      coalesce(sum(CASE WHEN tok <> '(' AND tok <> ')' AND coalesce(prev, '') <> '(' THEN 1 ELSE 0 END)
      OVER (PARTITION BY sid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS leaves
      FROM {name}_t1),
  {name}_op AS (SELECT sid, depth, next1 AS label, next2 = '(' AS counted, leaves AS start,
      row_number() OVER (PARTITION BY sid, depth ORDER BY p) AS k FROM {name}_t2 WHERE tok = '('),
  {name}_cl AS (SELECT sid, depth - 1 AS depth, leaves AS "end",
      row_number() OVER (PARTITION BY sid, depth ORDER BY p) AS k FROM {name}_t2 WHERE tok = ')'),
  {name} AS (SELECT o.sid, o.label, o.start, c."end" FROM {name}_op o JOIN {name}_cl c
      ON o.sid = c.sid AND o.depth = c.depth AND o.k = c.k WHERE o.counted)"""


@register("bracket_spans", f"""WITH {DUCK_BASE}, {DUCK_TREES}, {_duck_spans('gold', 'gs')}
  SELECT sid, label, start, "end" FROM gs""")
def q_bracket_spans(spark, sf_dir):
    return G.bracket_spans(_trees(spark, sf_dir), "gold")


_DUCK_BC = f"""{_duck_spans('gold', 'gs')}, {_duck_spans('pred', 'ps')},
  gc AS (SELECT sid, label, start, "end", count(*) AS gc FROM gs GROUP BY ALL),
  pc AS (SELECT sid, label, start, "end", count(*) AS pc FROM ps GROUP BY ALL),
  bj AS (SELECT coalesce(gc.sid, pc.sid) AS sid, coalesce(gc.gc, 0) AS gc, coalesce(pc.pc, 0) AS pc FROM gc
      FULL OUTER JOIN pc ON gc.sid = pc.sid AND gc.label = pc.label AND gc.start = pc.start AND gc."end" = pc."end")"""


@register("bracket_f1", f"""WITH {DUCK_BASE}, {DUCK_TREES}, {_DUCK_BC},
  per AS (SELECT sid, sum(least(gc, pc)) AS m_cnt, sum(gc) AS g_cnt, sum(pc) AS p_cnt FROM bj GROUP BY sid),
  r AS (SELECT t.len_bucket, sum(m_cnt)::BIGINT AS match, sum(g_cnt)::BIGINT AS gold, sum(p_cnt)::BIGINT AS parse
      FROM per JOIN trees t USING (sid) GROUP BY ROLLUP (t.len_bucket))
  SELECT *, round(CASE WHEN match > 0 THEN 2.0 * match / (gold + parse) ELSE 0.0 END, 6) AS f1 FROM r""")
def q_bracket_f1(spark, sf_dir):
    return G.bracket_f1(_trees(spark, sf_dir))


@register("tree_distance", f"""WITH {DUCK_BASE}, {DUCK_TREES}, {_DUCK_BC}
  SELECT sid, sum(abs(gc - pc))::BIGINT AS distance FROM bj GROUP BY sid""")
def q_tree_distance(spark, sf_dir):
    return G.tree_distance(_trees(spark, sf_dir))


@register("tag_accuracy", f"""WITH {DUCK_BASE}, {DUCK_TREES},
  ex AS (SELECT len_bucket, unnest(gold_tags) AS g, unnest(pred_tags) AS p FROM trees)
  SELECT len_bucket, count(*)::BIGINT AS n_tags, sum(CASE WHEN g = p THEN 1 ELSE 0 END)::BIGINT AS n_equal,
    round(sum(CASE WHEN g = p THEN 1 ELSE 0 END) / count(*), 6) AS acc FROM ex GROUP BY ROLLUP (len_bucket)""")
def q_tag_accuracy(spark, sf_dir):
    t = _trees(spark, sf_dir)
    return G.tag_accuracy(t.select("sid", "len_bucket", F.col("gold_tags").alias("gold"), F.col("pred_tags").alias("pred")))


_SUMMARY_BLEU = _DUCK_BLEU
for _name in ("hg", "rg", "mt", "ht", "rt", "ov"):  # beside the same tables of ROUGE's orders
    _SUMMARY_BLEU = re.sub(rf"\b{_name}\b", f"bleu_{_name}", _SUMMARY_BLEU)


@register("score_summary", f"""WITH {DUCK_BASE}, {_ROUGE_N}, {_LCS}, {_METEOR}, {_SUMMARY_BLEU}, {DUCK_TREES}, {_DUCK_BC},
  td AS (SELECT sid, sum(abs(gc - pc)) AS distance FROM bj GROUP BY sid)
  SELECT count(*)::BIGINT AS n_pairs, round(avg(rouge1) * 100, 6) AS rouge1, round(avg(rouge2) * 100, 6) AS rouge2,
    round(avg(rougel) * 100, 6) AS rougel, round(avg(meteor) * 100, 6) AS meteor, (SELECT round(bleu, 6) FROM bleu) AS bleu,
    (SELECT round(avg(distance), 6) FROM td) AS tree_distance
  FROM rn JOIN rl USING (sid) JOIN me USING (sid)""")
def q_score_summary(spark, sf_dir):
    """One row of all scores; the corpus' BLEU and the trees' mean distance beside the means of the pairs."""
    # four metrics read the same pairs: materialise them once (shared checkpoint folder)
    p = cut_lineage(_pairs(spark, sf_dir))
    j = G.rouge_n(p).join(G.rouge_l(p), "sid").join(G.meteor_exact(p), "sid")
    means = j.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("rouge1") * 100, 6).alias("rouge1"),
                  F.round(F.avg("rouge2") * 100, 6).alias("rouge2"), F.round(F.avg("rougel") * 100, 6).alias("rougel"),
                  F.round(F.avg("meteor") * 100, 6).alias("meteor"))
    distance = G.tree_distance(_trees(spark, sf_dir)).agg(F.round(F.avg("distance"), 6).alias("tree_distance"))
    rows = means.unionByName(G.corpus_bleu(p).select("bleu"), True).unionByName(distance, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
