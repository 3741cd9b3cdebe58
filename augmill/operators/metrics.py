"""Model evaluation operators.

Classification metrics are aggregates over the confusion table (M2), so the
work is one shuffle of (label, pred) pairs however many rows are scored.
Metric series (M7-M9) are windows per series, bounded by the epoch count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augmill.functions import draws as D
from augmill.operators.indexing import global_index


def confusion(scored: DataFrame) -> DataFrame:
    """M2: (label, pred, cnt)."""
    return scored.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("cnt"))


def accuracy(scored: DataFrame) -> DataFrame:
    """M3."""
    return scored.agg(F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"))


def per_class(conf: DataFrame) -> DataFrame:
    """Per class over truth and prediction classes: tp, support, predicted, P, R, F1 (0 when undefined)."""
    t = conf.select(F.col("label").alias("cls"), F.col("cnt").alias("support"),
                    F.when(F.col("label") == F.col("pred"), F.col("cnt")).alias("tp"), F.lit(None).cast("bigint").alias("predicted"))
    p = conf.select(F.col("pred").alias("cls"), F.lit(None).cast("bigint").alias("support"),
                    F.lit(None).cast("bigint").alias("tp"), F.col("cnt").alias("predicted"))
    c = t.unionByName(p).groupBy("cls").agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k)
                                               for k in ("support", "tp", "predicted")])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    c = c.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return c.withColumn("f1", f1)


def macro_scores(conf: DataFrame) -> DataFrame:
    """M4: unweighted means over classes."""
    return per_class(conf).agg(*[F.round(F.avg(k), 6).alias(f"macro_{k}") for k in ("precision", "recall", "f1")])


def class_report(conf: DataFrame) -> DataFrame:
    """M5: per class rows plus 'macro avg' and 'weighted avg' (by support)."""
    pc = per_class(conf)
    rows = pc.select(F.col("cls").cast("string").alias("cls"), "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                   F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("cls"),
                      *[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in ("precision", "recall", "f1")],
                      F.sum("support").cast("bigint").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    return out.select("cls", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")], "support")


def average_loss(scored: DataFrame, batch_size: int = 16, seed: int = 93) -> DataFrame:
    """M6: mean of -ln p[label], p from ``p1`` (two classes) or a map ``probs``; ``batch_mean_loss`` reproduces the reference's
    sum of batch means divided by the number of samples."""
    if "probs" in scored.columns:  # label -> probability, for any number of classes; a label that it lacks has none
        p = F.coalesce(F.try_element_at("probs", F.col("label")), F.lit(0.0))
    else:
        p = F.when(F.col("label") == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    s = scored.withColumn("loss", -F.log(F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))))
    idx = global_index(s, [], D.sort_key("loss_batch", seed, F.col("src_id")), "src_id", size_out=None)
    b = idx.groupBy(F.floor(F.col("idx") / batch_size).alias("batch")).agg(F.avg("loss").alias("bm"),
                                                                          F.count(F.lit(1)).alias("c"),
                                                                          F.sum("loss").alias("s"))
    return b.agg(F.round(F.sum("s") / F.sum("c"), 6).alias("mean_loss"),
                 F.round(F.sum("bm") / F.sum("c"), 6).alias("batch_mean_loss"))


def weighted_means(metrics: DataFrame) -> DataFrame:
    """M7: (name, interval, value, n) -> sum(value*n)/sum(n) per name and interval."""
    return metrics.groupBy("name", "interval").agg(
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").cast("bigint").alias("n"))


def early_stop(series: DataFrame, patience: int = 20, max_epochs: int | None = None) -> DataFrame:
    """M8: (series, epoch, score). Best = strictly greater than all earlier
    scores (start 0.0); stop at the first epoch whose no-improvement run
    reaches ``patience``; the last epoch when it never does."""
    s = series if max_epochs is None else series.where(F.col("epoch") < max_epochs)
    w = Window.partitionBy("series").orderBy("epoch")
    prior = F.coalesce(F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("improved", F.col("score") > F.greatest(prior, F.lit(0.0)))
    last_imp = F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("run", F.when(last_imp.isNull(), F.col("epoch") + 1).otherwise(F.col("epoch") - last_imp))
    stop = s.groupBy("series").agg(
        F.min(F.when(F.col("run") >= patience, F.col("epoch"))).alias("stop_at"),
        F.max("epoch").alias("last_epoch"))
    s = s.join(stop, "series").withColumn("end", F.coalesce("stop_at", "last_epoch")).where(F.col("epoch") <= F.col("end"))
    return s.groupBy("series").agg(
        F.first("end").cast("bigint").alias("stop_epoch"),
        F.first(F.col("stop_at").isNotNull()).alias("stopped"),
        F.max(F.when(F.col("improved"), F.col("epoch"))).cast("bigint").alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col("score"))).alias("best_score"))


def best_checkpoint(series: DataFrame) -> DataFrame:
    """M9: per series the epoch with the highest dev score (earliest on ties)
    and the test metric recorded at that epoch."""
    best = F.min(F.struct((-F.col("score")).alias("ns"), F.col("epoch").alias("e"), F.col("test").alias("t")))
    return series.groupBy("series").agg(best.alias("b")).select(
        "series", F.col("b.e").cast("bigint").alias("best_epoch"), (-F.col("b.ns")).alias("best_score"),
        F.col("b.t").alias("test_at_best"))


def fit_classifier(train: DataFrame, num_features: int = 1 << 18, max_iter: int = 20):
    """M1 (re-aimed): Tokenizer -> HashingTF -> IDF -> LogisticRegression. Labels are of any type
    and number; the fitted model adds ``pred``, the predicted label as a string."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    train = train.where(F.col("label").isNotNull()).withColumn("label_s", F.col("label").cast("string"))
    names = StringIndexer(inputCol="label_s", outputCol="label_d", stringOrderType="alphabetAsc").fit(train)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tok", pattern="[^a-z]+", toLowercase=True),
        HashingTF(inputCol="tok", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter),
        IndexToString(inputCol="prediction", outputCol="pred", labels=names.labels),
    ])
    return pipe.fit(names.transform(train))
