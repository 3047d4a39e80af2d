"""Reports over the split: the row hash is computed for one written table, not again by each pass."""

import datetime

import pytest
from pyspark.sql import functions as F

from adperf.operators.kpi import compute_kpis
from adperf.plans import queries, scorer

NAMES = ["date", "campaign", "channel", "device", "impressions", "clicks", "spend", "conversions", "revenue", "bounce_rate", "avg_session_duration"]
TYPES = "date date, campaign string, channel string, device string, impressions long, clicks long, spend double, conversions long, revenue double, bounce_rate double, avg_session_duration double"


def kpis(spark):
    """60 rows, some with nulls, the last ten a second time."""
    day = datetime.date(2025, 7, 1)
    rows = [(day, f"c{i}", None if i % 9 == 0 else "x", "Mobile", 1000 + i, i, None if i % 13 == 0 else i * 1.5, i % 7, None if i % 11 == 0 else i * 2.25, 0.5, 12.0) for i in range(60)]
    return compute_kpis(spark.createDataFrame(rows + rows[50:], TYPES).select(*NAMES))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["residual_hist", "attr_summary", "attr_bar", "classification_metrics", "model_comparison"])
def test_reports_hash_rows_once(spark, monkeypatch, name):
    stored = []
    keep = scorer.materialize
    monkeypatch.setattr(scorer, "materialize", lambda d: (stored.append(plan(d)), keep(d))[1])
    monkeypatch.setattr(queries, "kpi_frame", lambda *_: kpis(spark))
    out = queries.REGISTRY[name](spark, "")
    assert len(stored) == 1 and "md5(" in stored[0]
    # folds take training rows: one pass of their own
    assert plan(out).count("md5(") == 0 or name == "model_comparison"
    assert out.count() > 0


def test_stored_split_is_the_split(spark):
    d = kpis(spark)
    got = scorer.stored_split(d, ["spend", "ctr"])
    want = scorer.test_rows(d).select("row_id", F.lit(1).alias("is_test"), "spend", "ctr").unionByName(
        scorer.train_rows(d).select(F.lit(None).cast("string").alias("row_id"), F.lit(0).alias("is_test"), "spend", "ctr"))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.count() == 70 and 0 < got.where("is_test = 1").count() < 70


def test_scored_rows_are_those_of_the_test_rows(spark):
    d = kpis(spark)
    ids = sorted(r.row_id for r in scorer.test_rows(d).select("row_id").collect())
    for scored, models in ((scorer.scored_regression(d), "r1 r2 r3"), (scorer.scored_classification(d), "m1 m2 m3")):
        for m in models.split():
            assert sorted(r.row_id for r in scored.where(F.col("model") == m).collect()) == ids
