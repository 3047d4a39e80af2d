"""Diagnostic tables D1-D7 over scored frames (``model, label, prediction``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround
from adperf.operators.evaluate import classification_metrics_raw, regression_metrics_raw


def best_unrounded(scored: DataFrame, task: str = "classification") -> DataFrame:
    """Best model by unrounded weighted F1 (classification) or R2."""
    if task == "classification":
        m = classification_metrics_raw(scored).select("model", F.col("f1_score").alias("score"))
    else:
        m = regression_metrics_raw(scored).select("model", F.col("r2_score").alias("score"))
    return m.orderBy(F.desc("score"), "model").limit(1).select(
        F.col("model").alias("best_model"), npround("score", 6).alias("score")
    )


def _best_rows(scored: DataFrame, task: str) -> DataFrame:
    best = best_unrounded(scored, task).select(F.col("best_model").alias("model"))
    return scored.join(F.broadcast(best), "model", "left_semi")


def pred_vs_actual(scored: DataFrame) -> DataFrame:
    """Points of the best regressor, common axis limits, R2 and RMSE."""
    rows = _best_rows(scored, "regression")
    err = F.col("label") - F.col("prediction")
    st = rows.agg(
        F.least(F.min("label"), F.min("prediction")).alias("lim_lo"),
        F.greatest(F.max("label"), F.max("prediction")).alias("lim_hi"),
        (1 - F.try_divide(F.sum(err * err), F.count(F.lit(1)) * F.var_pop("label"))).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )
    return rows.crossJoin(F.broadcast(st)).select(
        "model",
        F.col("label").alias("actual"),
        F.col("prediction").alias("predicted"),
        "lim_lo",
        "lim_hi",
        npround("r2", 6).alias("r2"),
        npround("rmse", 6).alias("rmse"),
    )


def residual_band(scored: DataFrame) -> DataFrame:
    """D3: residual std (population), +-2 sigma band, outlier count / total."""
    rows = _best_rows(scored, "regression").withColumn("r", F.col("label") - F.col("prediction"))
    sd = rows.agg(F.stddev_pop("r").alias("sd"))
    j = rows.crossJoin(F.broadcast(sd))
    return j.agg(
        F.first("model").alias("model"),
        npround(F.first("sd"), 6).alias("residual_std"),
        npround(-2 * F.first("sd"), 6).alias("band_lo"),
        npround(2 * F.first("sd"), 6).alias("band_hi"),
        F.count_if(F.abs("r") > 2 * F.col("sd")).cast("bigint").alias("outliers"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )


def residual_hist(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of residuals, ``bins`` equal bins over [min, max] (last
    bin closed; zero width puts everything in bin 0), with mean and std."""
    rows = _best_rows(scored, "regression").withColumn("r", F.col("label") - F.col("prediction"))
    st = rows.agg(
        F.min("r").alias("rmin"), F.max("r").alias("rmax"), F.avg("r").alias("rmean"), F.stddev_pop("r").alias("rstd")
    ).withColumn("w", (F.col("rmax") - F.col("rmin")) / bins)
    b = F.when(F.col("w") > 0, F.least(F.floor((F.col("r") - F.col("rmin")) / F.col("w")), F.lit(bins - 1))).otherwise(0)
    counts = rows.crossJoin(F.broadcast(st)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(st))
    return (
        grid.join(counts, "bin", "left")
        .select(
            "bin",
            npround(F.col("rmin") + F.col("bin") * F.col("w"), 6).alias("edge_lo"),
            npround(F.col("rmin") + (F.col("bin") + 1) * F.col("w"), 6).alias("edge_hi"),
            F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
            npround("rmean", 6).alias("mean"),
            npround("rstd", 6).alias("std"),
        )
        .orderBy("bin")
    )


def correct_split(scored: DataFrame) -> DataFrame:
    """Correct / incorrect counts of the best classifier and their share (%)."""
    rows = _best_rows(scored, "classification")
    g = rows.groupBy(
        F.when(F.col("label") == F.col("prediction"), "correct").otherwise("incorrect").alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"))
    tot = rows.agg(F.count(F.lit(1)).alias("_tot"))
    return g.crossJoin(F.broadcast(tot)).select(
        "outcome", F.col("n").cast("bigint").alias("n"), npround(F.col("n") * 100.0 / F.col("_tot"), 4).alias("pct")
    )


def accuracy_by_model(scored: DataFrame) -> DataFrame:
    """Accuracy per model."""
    return scored.groupBy("model").agg(
        npround(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy")
    ).orderBy("model")


def score_order(scored: DataFrame, times: DataFrame, task: str = "classification") -> DataFrame:
    """Test score (F1 or R2) with training time, ascending by score."""
    if task == "classification":
        m = classification_metrics_raw(scored).select("model", F.col("f1_score").alias("score"))
    else:
        m = regression_metrics_raw(scored).select("model", F.col("r2_score").alias("score"))
    return m.join(times, "model", "left").select(
        "model", npround("score", 6).alias("score"), "train_time_s"
    ).orderBy("score", "model")
