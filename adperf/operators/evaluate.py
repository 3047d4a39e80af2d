"""Model evaluation E1-E13 as aggregations over a scored frame.

Input frames: ``scored`` = ``(model, label, prediction[, score])`` with any
number of rows; ``folds`` = ``(model, fold, score)``; ``importance`` =
``(feature, importance)``.  Row-level data is only ever grouped (partial
aggregation); the per-class / per-model tables that follow are tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround
from adperf.operators.quantile import running_before


def _counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class(scored: DataFrame) -> DataFrame:
    """Per (model, class): support, predicted, true positives, P, R, F1."""
    c = _counts(scored)
    sup = c.groupBy("model", F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"),
    )
    pred = c.groupBy("model", F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = sup.join(pred, ["model", "cls"], "left").fillna(0, ["predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(
        (F.col("precision") + F.col("recall")) > 0,
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(0.0)
    return j.withColumn("f1", f1)


def classification_metrics_raw(scored: DataFrame) -> DataFrame:
    """E1-E4 unrounded: accuracy, support-weighted precision / recall / F1."""
    pc = per_class(scored)
    return pc.groupBy("model").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_score"),
    )


def classification_metrics(scored: DataFrame) -> DataFrame:
    """E1-E4 (4 dp)."""
    m = classification_metrics_raw(scored)
    return m.select("model", *[npround(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


def roc_auc_raw(scored: DataFrame) -> DataFrame:
    """E5: ROC-AUC of ``score`` for label 1, average ranks on ties (the
    Mann-Whitney form); NULL when only one class is present.

    Rows are first reduced to distinct (model, score) with positive and
    negative counts; ``running_before`` counts the negatives below each score
    in pieces of about equal size, whatever the scores' distribution.
    """
    d = scored.groupBy("model", "score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"),
        F.sum((F.col("label") != 1).cast("long")).alias("neg"),
    )
    d = running_before(d, ["model"], "score", {"lower": "neg"})
    contrib = F.col("pos") * (F.col("lower") + 0.5 * F.col("neg"))
    return d.groupBy("model").agg(
        F.try_divide(F.sum(contrib), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc")
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    return roc_auc_raw(scored).select("model", npround("roc_auc", 4).alias("roc_auc"))


def regression_metrics_raw(scored: DataFrame) -> DataFrame:
    """E6-E8 unrounded: RMSE, MAE, R2 = 1 - SSres / (n var_pop(y))."""
    err = F.col("label") - F.col("prediction")
    return scored.groupBy("model").agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.sum(err * err), F.count(F.lit(1)) * F.var_pop("label"))).alias("r2_score"),
    )


def regression_metrics(scored: DataFrame) -> DataFrame:
    m = regression_metrics_raw(scored)
    return m.select("model", *[npround(c, 4).alias(c) for c in ("rmse", "mae", "r2_score")])


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std of the fold scores per model (4 dp)."""
    return folds.groupBy("model").agg(
        npround(F.avg("score"), 4).alias("cv_mean"), npround(F.stddev_pop("score"), 4).alias("cv_std")
    )


def model_comparison(
    scored: DataFrame, folds: DataFrame, times: DataFrame, task: str = "classification"
) -> DataFrame:
    """One row per model — test metrics, CV mean / std, training time."""
    if task == "classification":
        m = classification_metrics(scored).join(roc_auc(scored), "model", "left")
    else:
        m = regression_metrics(scored)
    return m.join(cv_summary(folds), "model", "left").join(times, "model", "left").orderBy("model")


def best_model(comparison: DataFrame, metric: str = "f1_score") -> DataFrame:
    """Argmax of the (rounded) metric; first model name on ties."""
    return comparison.orderBy(F.desc(metric), F.asc("model")).limit(1).select(
        F.col("model").alias("best_model"), F.col(metric).alias("score")
    )


def confusion(scored: DataFrame, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Counts per (model, label, prediction), zero-filled."""
    c = _counts(scored)
    models = scored.select("model").distinct()
    grid = (
        models.crossJoin(F.broadcast(scored.sparkSession.range(len(classes)).select(F.col("id").cast("int").alias("label"))))
        .crossJoin(F.broadcast(scored.sparkSession.range(len(classes)).select(F.col("id").cast("int").alias("prediction"))))
    )
    return (
        grid.join(c, ["model", "label", "prediction"], "left")
        .select("model", "label", "prediction", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
        .orderBy("model", "label", "prediction")
    )


def cv_box(folds: DataFrame) -> DataFrame:
    """Box statistics of the fold scores per model (k folds per group, so
    the exact ``percentile`` map holds at most k values)."""
    q = F.percentile(F.col("score"), [0.0, 0.25, 0.5, 0.75, 1.0])
    g = folds.groupBy("model").agg(q.alias("q"), F.avg("score").alias("mean"))
    names = ["min", "q1", "median", "q3", "max"]
    return g.select(
        "model", *[npround(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)], npround("mean", 6).alias("mean")
    )


def importance_share(importance: DataFrame) -> DataFrame:
    """Importance with its share of the total (2 dp), descending.
    The total is a one-row aggregate (broadcast)."""
    tot = importance.agg(F.sum("importance").alias("_tot"))
    return (
        importance.crossJoin(F.broadcast(tot))
        .select(
            "feature",
            npround("importance", 6).alias("importance"),
            F.when(F.col("_tot") > 0, npround(F.col("importance") / F.col("_tot") * 100, 2)).alias("importance_pct"),
        )
        .orderBy(F.desc("importance"), "feature")
    )


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """Top-k features by importance; empty when the total is 0."""
    s = importance_share(importance).filter(F.col("importance_pct").isNotNull())
    return s.orderBy(F.desc("importance"), F.asc("feature")).limit(k)
