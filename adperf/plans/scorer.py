"""Deterministic scorer frames (FIXTURES F3).

Stand-ins for trained models so the evaluation, attribution and diagnostic
reports have SQL oracles.  All frames derive from the KPI table: the test
set is the hash split (``is_test``), folds come from another hex digit of
the same row hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.operators.features import hash_split, row_key
from adperf.session import materialize

# The deterministic classifiers / regressors and their
# "training seconds" (label, score, prediction per FIXTURES F3), as SQL, so
# that importing this module needs no session.
CLASSIFIERS = [
    ("m1", "ctr", "ctr > 0.03D", 1.0),
    ("m2", "-cpc", "cpc < 0.5D", 2.0),
    ("m3", "conversion_rate", "conversion_rate > 0.02D", 3.0),
]
REGRESSORS = [
    ("r1", "spend * 1.2D", 1.0),
    ("r2", "conversions * 30.0D", 2.0),
    ("r3", "25.0D", 3.0),
]
# Linear attribution weights.
LINEAR_WEIGHTS = {"ctr": 2.0, "cpc": -0.5, "conversion_rate": 1.0, "bounce_rate": -0.25, "spend": 0.01}
N_FOLDS = 5


def _split(kpi: DataFrame) -> DataFrame:
    return hash_split(kpi).withColumn("row_id", row_key(kpi))


def test_rows(kpi: DataFrame) -> DataFrame:
    return _split(kpi).filter(F.col("is_test") == 1).drop("is_test")


def train_rows(kpi: DataFrame) -> DataFrame:
    return _split(kpi).filter(F.col("is_test") == 0).drop("is_test")


def stored_split(kpi: DataFrame, cols: list[str]) -> DataFrame:
    """``(row_id, is_test, *cols)`` of all rows, written once; training rows without ``row_id``.

    Reports pass over their rows several times; the row hash is computed for the first of them only.
    """
    return materialize(_split(kpi).select(F.when(F.col("is_test") == 1, F.col("row_id")).alias("row_id"), "is_test", *cols))


def scored_classification(kpi: DataFrame) -> DataFrame:
    """``(row_id, model, label INT, prediction INT, score DOUBLE)`` on test rows, whose columns are written once."""
    t = stored_split(kpi, ["roi", "ctr", "cpc", "conversion_rate"]).filter(F.col("is_test") == 1)
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.expr(pred).cast("int").alias("prediction"), F.expr(score).cast("double").alias("score"))
            for m, score, pred, _ in CLASSIFIERS
        ]
    )
    return t.select("row_id", (F.col("roi") > 0).cast("int").alias("label"), F.explode(models).alias("m")).select(
        "row_id", "m.model", "label", "m.prediction", "m.score"
    )


def scored_regression(kpi: DataFrame) -> DataFrame:
    """``(row_id, model, label DOUBLE, prediction DOUBLE)`` on test rows, whose columns are written once."""
    t = stored_split(kpi, ["revenue", "spend", "conversions"]).filter(F.col("is_test") == 1)
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.expr(pred).cast("double").alias("prediction")) for m, pred, _ in REGRESSORS]
    )
    return t.select("row_id", F.col("revenue").cast("double").alias("label"), F.explode(models).alias("m")).select(
        "row_id", "m.model", "label", "m.prediction"
    )


def train_times(task: str = "classification") -> list[tuple[str, float]]:
    models = CLASSIFIERS if task == "classification" else REGRESSORS
    return [(m[0], m[-1]) for m in models]


def fold_scores(kpi: DataFrame) -> DataFrame:
    """``(model, fold, score)``: accuracy of each classifier in each of the 5
    folds of the training rows (fold = 9th hex digit of the row hash mod 5)."""
    tr = train_rows(kpi)
    fold = (F.instr(F.lit("0123456789abcdef"), F.substring("row_id", 9, 1)) % N_FOLDS).cast("int")
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.expr(pred).cast("int").alias("prediction")) for m, _, pred, _ in CLASSIFIERS]
    )
    s = tr.select(fold.alias("fold"), (F.col("roi") > 0).cast("int").alias("label"), F.explode(models).alias("m"))
    return s.groupBy(F.col("m.model").alias("model"), "fold").agg(
        F.avg((F.col("label") == F.col("m.prediction")).cast("double")).alias("score")
    )
