"""Registered model-evaluation queries (M-rows) and the STS correlation.

Until a model scores the rows, predictions come from a fixed rule on the
whitespace token count: pred = 1 when n >= 100, p1 = 1 / (1 + exp(-(n - 100) / 50)).
Metric series come from ``events``: one epoch per day, score = daily mean
value per event type (rounded to 6 decimals), test metric = events that day.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from augmill.functions import text as T
from augmill.operators import corpus as C
from augmill.operators import metrics as M
from augmill.operators import splits as SP
from augmill.operators.textscore import jaccard
from augmill.plans.registry import register
from augmill.sources import tables as TB

L = TB.DUCK_LABELLED
D = C.D


def _scored(spark, sf_dir):
    lab = TB.labelled(spark, sf_dir).withColumn("n", F.size(T.split_ws(F.col("text"))))
    return lab.select("src_id", "label", F.when(F.col("n") >= 100, 1).otherwise(0).alias("pred"),
                      (1.0 / (1.0 + F.exp(-(F.col("n") - 100) / 50.0))).alias("p1"))


DUCK_SCORED = f"""scored AS (SELECT src_id, label, CASE WHEN n >= 100 THEN 1 ELSE 0 END AS pred,
    1.0 / (1.0 + exp(-(n - 100) / 50.0)) AS p1 FROM (SELECT *, len({T.duck_split_ws('text')}) AS n FROM {L})),
  conf AS (SELECT label, pred, count(*) AS cnt FROM scored GROUP BY ALL),
  pcl AS (SELECT cls, coalesce(sum(support), 0) AS support, coalesce(sum(tp), 0) AS tp,
          coalesce(sum(predicted), 0) AS predicted FROM (
      SELECT label AS cls, cnt AS support, CASE WHEN label = pred THEN cnt END AS tp, NULL AS predicted FROM conf
      UNION ALL SELECT pred AS cls, NULL, NULL, cnt FROM conf) GROUP BY cls),
  pc2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pcl),
  pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
          AS f1 FROM pc2)"""


@register("confusion", f"WITH {DUCK_SCORED} SELECT label, pred, cnt::BIGINT AS cnt FROM conf")
def q_confusion(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir))


@register("accuracy", f"WITH {DUCK_SCORED} SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) "
                      f"AS accuracy FROM scored")
def q_accuracy(spark, sf_dir):
    return M.accuracy(_scored(spark, sf_dir))


@register("macro_scores", f"""WITH {DUCK_SCORED} SELECT round(avg(precision), 6) AS macro_precision,
    round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM pc""")
def q_macro(spark, sf_dir):
    return M.macro_scores(M.confusion(_scored(spark, sf_dir)))


@register("class_report", f"""WITH {DUCK_SCORED}
  SELECT cls::VARCHAR AS cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    support::BIGINT AS support FROM pc
  UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
    sum(support)::BIGINT FROM pc
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
    round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
    sum(support)::BIGINT FROM pc""")
def q_class_report(spark, sf_dir):
    return M.class_report(M.confusion(_scored(spark, sf_dir)))


@register("average_loss", f"""WITH {DUCK_SCORED},
  l AS (SELECT *, -ln(least(greatest(CASE WHEN label = 1 THEN p1 ELSE 1 - p1 END, 1e-7), 1 - 1e-7)) AS loss,
        row_number() OVER (ORDER BY {D.sql_sort_key('loss_batch', 93, 'src_id')}, src_id) - 1 AS idx FROM scored),
  b AS (SELECT floor(idx / 16) AS batch, avg(loss) AS bm, count(*) AS c, sum(loss) AS s FROM l GROUP BY ALL)
  SELECT round(sum(s) / sum(c), 6) AS mean_loss, round(sum(bm) / sum(c), 6) AS batch_mean_loss FROM b""")
def q_average_loss(spark, sf_dir):
    return M.average_loss(_scored(spark, sf_dir))


@register("weighted_means", """SELECT event_type AS name, CAST(ts AS DATE) AS interval,
    round(sum(value * CAST(json_extract(props, '$.k') AS BIGINT)) / sum(CAST(json_extract(props, '$.k') AS BIGINT)), 6)
    AS mean, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS n FROM events GROUP BY ALL""")
def q_weighted_means(spark, sf_dir):
    ev = TB.load(spark, sf_dir, "events")
    m = ev.select(F.col("event_type").alias("name"), F.to_date("ts").alias("interval"), "value",
                  F.get_json_object("props", "$.k").cast("bigint").alias("n"))
    return M.weighted_means(m)


def _series(spark, sf_dir):
    ev = TB.load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = ev.groupBy("event_type", "day").agg(F.round(F.avg("value"), 6).alias("score"),
                                               F.count(F.lit(1)).alias("test"))
    # epoch = days since the series' first day; the window runs over the
    # daily aggregate, so it is bounded by the number of days, not events
    d0 = F.min("day").over(Window.partitionBy("event_type"))
    return daily.select(F.col("event_type").alias("series"), F.datediff("day", d0).cast("bigint").alias("epoch"),
                        "score", "test")


DUCK_SERIES = """daily AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS score, count(*) AS test
    FROM events GROUP BY ALL),
  series AS (SELECT event_type AS series, date_diff('day', min(day) OVER (PARTITION BY event_type), day)::BIGINT AS epoch,
    score, test FROM daily)"""


@register("early_stop", f"""WITH {DUCK_SERIES},
  s AS (SELECT *, score > greatest(coalesce(max(score) OVER (PARTITION BY series ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved FROM series),
  s2 AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY series ORDER BY epoch
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM s),
  s3 AS (SELECT *, CASE WHEN last_imp IS NULL THEN epoch + 1 ELSE epoch - last_imp END AS run FROM s2),
  st AS (SELECT series, min(CASE WHEN run >= 20 THEN epoch END) AS stop_at, max(epoch) AS last_epoch FROM s3 GROUP BY series),
  s4 AS (SELECT s3.*, coalesce(st.stop_at, st.last_epoch) AS "end", st.stop_at IS NOT NULL AS stopped FROM s3 JOIN st USING (series))
  SELECT series, first("end")::BIGINT AS stop_epoch, first(stopped) AS stopped,
    max(CASE WHEN improved THEN epoch END)::BIGINT AS best_epoch, max(CASE WHEN improved THEN score END) AS best_score
  FROM s4 WHERE epoch <= "end" GROUP BY series""")
def q_early_stop(spark, sf_dir):
    return M.early_stop(_series(spark, sf_dir))


@register("best_checkpoint", f"""WITH {DUCK_SERIES},
  b AS (SELECT series, min({{'ns': -score, 'e': epoch, 't': test}}) AS b FROM series GROUP BY series)
  SELECT series, b.e::BIGINT AS best_epoch, -b.ns AS best_score, b.t AS test_at_best FROM b""")
def q_best_checkpoint(spark, sf_dir):
    return M.best_checkpoint(_series(spark, sf_dir))


@register("classifier_report")
def q_classifier_report(spark, sf_dir):
    """M1 + M5: fit on the 90 % train side of the labelled split, report on the rest."""
    lab = SP.split_two_way(TB.labelled(spark, sf_dir))
    model = M.fit_classifier(lab.where("split = 'train'"))
    pred = model.transform(lab.where("split = 'val'")).withColumn("label", F.col("label").cast("string"))
    return M.class_report(M.confusion(pred))


from augmill.plans.corpus_plans import _AVG, _VECS, _duck_l2, BASE_CTES  # noqa: E402

_DUCK_STS = f"""WITH {BASE_CTES}, {_VECS}, {_AVG},
  sd AS (SELECT conv_id, turn, side, toks FROM sides),
  j AS (SELECT CASE WHEN {_duck_l2('a.avg_vec')} * {_duck_l2('b.avg_vec')} > 0 THEN
          list_sum(list_transform(list_zip(a.avg_vec, b.avg_vec), lambda p: p[1] * p[2]))
          / ({_duck_l2('a.avg_vec')} * {_duck_l2('b.avg_vec')}) END AS cos,
        CASE WHEN len(list_distinct(list_concat(s1.toks, s2.toks))) > 0 THEN
          len(list_distinct(list_intersect(s1.toks, s2.toks))) / len(list_distinct(list_concat(s1.toks, s2.toks)))
        END AS gold
      FROM av a JOIN av b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side = 1 AND b.side = 2
      JOIN sd s1 ON s1.conv_id = a.conv_id AND s1.turn = a.turn AND s1.side = 1
      JOIN sd s2 ON s2.conv_id = a.conv_id AND s2.turn = a.turn AND s2.side = 2)
  SELECT count(*)::BIGINT AS n_pairs, round(corr(cos, gold), 6) AS pearson FROM j"""


@register("sts_correlation", _DUCK_STS)
def q_sts_correlation(spark, sf_dir):
    """Pearson correlation of pair cosine (V9/V10) and token Jaccard gold."""
    sides = C.pair_sides(TB.pairs(spark, sf_dir))
    vecs = C.word_vectors(TB.documents(spark, sf_dir), TB.load(spark, sf_dir, "embeddings"))
    av = C.average_vectors(sides, vecs)
    a = av.where("side = 1").select("conv_id", "turn", F.col("avg_vec").alias("a"))
    b = av.where("side = 2").select("conv_id", "turn", F.col("avg_vec").alias("b"))
    s1 = sides.where("side = 1").select("conv_id", "turn", F.col("toks").alias("t1"))
    s2 = sides.where("side = 2").select("conv_id", "turn", F.col("toks").alias("t2"))
    j = a.join(b, ["conv_id", "turn"]).join(s1, ["conv_id", "turn"]).join(s2, ["conv_id", "turn"])
    j = j.select(C.cosine(F.col("a"), F.col("b")).alias("cos"), jaccard(F.col("t1"), F.col("t2")).alias("gold"))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.corr("cos", "gold"), 6).alias("pearson"))
