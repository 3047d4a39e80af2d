"""Evaluation / diagnostics on hand-made scored frames."""

import math

from adperf.operators import diagnostics as D
from adperf.operators import evaluate as E
from adperf.operators.aggregate import correlation


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, label int, prediction int, score double")


def test_auc_with_ties_matches_rank_formula(spark):
    rows = [("m", 1, 1, 0.9), ("m", 0, 1, 0.9), ("m", 1, 0, 0.3), ("m", 0, 0, 0.1)]
    auc = E.roc_auc_raw(scored(spark, rows)).collect()[0]["roc_auc"]
    # positives 0.9, 0.3 vs negatives 0.9, 0.1: pairs (>, =, >, <)... = (0.5 + 1 + 0 + 1) / 4
    assert math.isclose(auc, 0.625)


def test_auc_single_class_is_null(spark):
    rows = [("m", 1, 1, 0.9), ("m", 1, 0, 0.2)]
    assert E.roc_auc_raw(scored(spark, rows)).collect()[0]["roc_auc"] is None


def test_weighted_metrics(spark):
    rows = [("m", 1, 1, 0.0), ("m", 1, 0, 0.0), ("m", 0, 0, 0.0), ("m", 0, 0, 0.0)]
    r = E.classification_metrics_raw(scored(spark, rows)).collect()[0]
    assert r["accuracy"] == 0.75
    # class 0: P=2/3 R=1; class 1: P=1 R=0.5; support 2/2
    assert math.isclose(r["precision"], (2 / 3 + 1) / 2)
    assert math.isclose(r["recall"], 0.75)
    assert math.isclose(r["f1_score"], (0.8 + 2 / 3) / 2)


def test_confusion_zero_filled(spark):
    c = E.confusion(scored(spark, [("m", 1, 1, 0.0)])).collect()
    assert len(c) == 4 and sum(r["n"] for r in c) == 1


def test_histogram_last_bin_closed_and_zero_width(spark):
    reg = spark.createDataFrame([("r", 0.0, 0.0), ("r", 3.0, 0.0), ("r", 1.5, 0.0)],
                                "model string, label double, prediction double")
    h = {r["bin"]: r["n"] for r in D.residual_hist(reg, bins=3).collect()}
    assert h == {0: 1, 1: 1, 2: 1}
    flat = spark.createDataFrame([("r", 2.0, 0.0), ("r", 2.0, 0.0)], "model string, label double, prediction double")
    h2 = {r["bin"]: r["n"] for r in D.residual_hist(flat, bins=3).collect()}
    assert h2[0] == 2 and sum(h2.values()) == 2


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "spend double, revenue double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation(df).collect()}
    assert got[("spend", "spend")] == 1.0 and got[("revenue", "spend")] is None


def test_cv_box(spark):
    folds = spark.createDataFrame([("m", i, float(i)) for i in range(5)], "model string, fold int, score double")
    r = E.cv_box(folds).collect()[0]
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"]) == (0.0, 1.0, 2.0, 3.0, 4.0, 2.0)
