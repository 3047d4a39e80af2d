"""Attribution reports X1, X4-X10 over a long attribution table
``(row_id, feature, shap, feature_value)``.

Per-feature statistics are grouped aggregates (one row per feature); the
per-feature totals / bounds they need are broadcast as small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround


def linear_attribution(rows: DataFrame, background: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear model on independent features,
    ``w_j * (x_j - mean_j)`` with means over the background rows."""
    feats = list(weights)
    means = background.agg(*[F.avg(F.col(c).cast("double")).alias(f"mu_{c}") for c in feats])
    j = rows.crossJoin(F.broadcast(means))
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.lit(w) * (F.col(c).cast("double") - F.col(f"mu_{c}"))).alias("shap"),
                F.col(c).cast("double").alias("feature_value"),
            )
            for c, w in weights.items()
        ]
    )
    return j.select("row_id", F.explode(parts).alias("a")).select("row_id", "a.feature", "a.shap", "a.feature_value")


def feature_stats(attr: DataFrame) -> DataFrame:
    """Per feature: mean |shap|, mean shap (unrounded)."""
    return attr.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.avg("shap").alias("mean_shap")
    )


def importance(attr: DataFrame) -> DataFrame:
    """X4 + X9: mean |shap| per feature, share of total (2 dp; 0 when the total
    is 0), importance band (>= 10 % high, >= 5 % medium, else low)."""
    fs = feature_stats(attr)
    tot = fs.agg(F.sum("mean_abs_shap").alias("_tot"))
    pct = F.when(F.col("_tot") > 0, npround(F.col("mean_abs_shap") / F.col("_tot") * 100, 2)).otherwise(0.0)
    return (
        fs.crossJoin(F.broadcast(tot))
        .withColumn("importance_pct", pct)
        .select(
            "feature",
            npround("mean_abs_shap", 6).alias("mean_abs_shap"),
            "importance_pct",
            F.when(F.col("importance_pct") >= 10, "high")
            .when(F.col("importance_pct") >= 5, "medium")
            .otherwise("low")
            .alias("band"),
        )
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def direction(attr: DataFrame) -> DataFrame:
    """Mean signed shap per feature; Positive if > 0 else Negative."""
    fs = feature_stats(attr)
    return fs.select(
        "feature",
        npround("mean_shap", 6).alias("mean_shap"),
        F.when(F.col("mean_shap") > 0, "Positive").otherwise("Negative").alias("direction"),
    ).orderBy(F.desc("mean_shap"), "feature")


def extremes(attr: DataFrame, k: int = 5) -> DataFrame:
    """Top-k positive (largest first) and top-k negative (most negative
    first) features by mean shap."""
    fs = feature_stats(attr)
    pos = fs.filter(F.col("mean_shap") > 0).orderBy(F.desc("mean_shap"), "feature").limit(k)
    neg = fs.filter(F.col("mean_shap") < 0).orderBy(F.asc("mean_shap"), "feature").limit(k)
    return pos.select(F.lit("positive").alias("side"), "feature", npround("mean_shap", 6).alias("mean_shap")).unionByName(
        neg.select(F.lit("negative").alias("side"), "feature", npround("mean_shap", 6).alias("mean_shap"))
    )


def top_features(attr: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features (mean |shap|)."""
    return importance(attr).orderBy(F.desc("mean_abs_shap"), "feature").limit(k)


def summary_points(attr: DataFrame, k: int = 15) -> DataFrame:
    """Points of the top-k features with per-feature min-max normalised
    value (0.5 when the feature is constant)."""
    top = top_features(attr, k).select("feature")
    pts = attr.join(F.broadcast(top), "feature", "left_semi")
    bounds = pts.groupBy("feature").agg(F.min("feature_value").alias("vmin"), F.max("feature_value").alias("vmax"))
    norm = F.when(
        F.col("vmax") > F.col("vmin"), (F.col("feature_value") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))
    ).otherwise(0.5)
    return pts.join(F.broadcast(bounds), "feature").select(
        "row_id", "feature", npround("shap", 6).alias("shap"), npround(norm, 6).alias("norm_value")
    )


def waterfall(attr: DataFrame, k: int = 12) -> DataFrame:
    """The row with the largest total |shap| (smallest row_id on ties) and
    its k largest contributions, with an up / down label."""
    tot = attr.groupBy("row_id").agg(F.sum(F.abs("shap")).alias("t"))
    row = tot.orderBy(F.desc("t"), "row_id").limit(1).select("row_id")
    r = attr.join(F.broadcast(row), "row_id", "left_semi")
    return (
        r.orderBy(F.desc(F.abs("shap")), "feature")
        .limit(k)
        .select(
            "row_id",
            "feature",
            npround("shap", 6).alias("shap"),
            F.when(F.col("shap") > 0, "up").otherwise("down").alias("effect"),
        )
    )
