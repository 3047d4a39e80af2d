"""Distributed exact quantiles / modes, feature engineering, split invariants."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from adperf.operators import features as FE
from adperf.operators.quantile import exact_quantiles, exact_quantiles_multi, modes, quantile_values, running_before
from adperf.plans.frames import kpi_frame
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("n,accuracy", [(7, 1000), (4000, 1000), (20001, 500)])
def test_exact_quantiles_match_numpy(spark, n, accuracy):
    rng = np.random.default_rng(n)
    vals = np.round(rng.lognormal(3, 1.2, n), 2)
    vals[rng.integers(0, n, n // 10)] = 17.0           # heavy ties
    df = spark.createDataFrame([(float(v), float(-v)) for v in vals], "a double, b double")
    got = {(r["col"], r["p"]): r["value"] for r in
           exact_quantiles_multi(df, ["a", "b"], [0.25, 0.5, 0.75], accuracy=accuracy).collect()}
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(got[("a", p)], float(np.quantile(vals, p)), rel_tol=1e-12)
        assert math.isclose(got[("b", p)], float(np.quantile(-vals, p)), rel_tol=1e-12)


@pytest.mark.parametrize("kind", ["even", "two values", "one tie in the middle", "infinite"])
def test_brackets_are_narrowed_until_few_values_are_left(spark, kind):
    """With few values allowed at the driver, several rounds give the same quantiles."""
    rng = np.random.default_rng(1)
    vals = {
        "even": rng.normal(size=6000), "two values": rng.integers(0, 2, 6000).astype(float),
        "one tie in the middle": np.where(rng.random(6000) < 0.7, 3.0, rng.normal(size=6000) + 3),
        "infinite": np.where(rng.random(6000) < 0.2, math.inf, rng.normal(size=6000)),
    }[kind]
    df = spark.createDataFrame([(float(v), None if k % 3 else float(v)) for k, v in enumerate(vals)] + [(math.nan, None)], "a double, b double")
    ps = [0.0, 0.25, 0.5, 0.503, 1.0]
    got, row = quantile_values(df, ["a", "b"], ps, accuracy=1000, most=3, extra=[F.count("*").alias("rows")])
    for p in ps:
        for c, of in (("a", vals), ("b", vals[::3])):
            want = np.sort(of)[int((len(of) - 1) * p)] if kind == "infinite" else np.quantile(of, p)
            assert got[c, p] == pytest.approx(want, rel=1e-12 if kind != "infinite" else 0.05, abs=0.01 * (kind == "infinite"))
    assert row.rows == 6001


def test_running_before_in_pieces(spark):
    rng = np.random.default_rng(0)
    data = {(k, int(v)): int(n) for k, v, n in zip(rng.integers(0, 3, 900), rng.integers(0, 400, 900), rng.integers(0, 9, 900))}
    df = spark.createDataFrame([(f"m{k}", float(v), n) for (k, v), n in data.items()], "model string, score double, neg int")
    for rows in (50, 10_000):
        for r in running_before(df, ["model"], "score", {"lower": "neg"}, rows).collect():
            assert r.lower == sum(n for (k, v), n in data.items() if f"m{k}" == r.model and v < r.score)


@pytest.mark.parametrize("few,prefix", [(1000, 4), (3, 1), (0, 2)])
def test_exact_split_equals_ranking(spark, few, prefix, monkeypatch):
    """Radix selection against ranking all rows, with rows that share a hash across the cut and a null class."""
    monkeypatch.setattr(FE, "row_key", lambda df: F.md5(F.col("k").cast("string")))
    rng = np.random.default_rng(3)
    rows = [(int(k), None if c == 3 else int(c), int(n)) for n, (k, c) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 4, 400)))]
    df = spark.createDataFrame(rows, "k int, target int, n int")
    got = FE.exact_split(df, "target", 0.2, prefix, few).collect()
    assert len(got) == 400
    for c in {c for _, c, _ in rows}:
        mine = sorted((hashlib.md5(str(k).encode()).hexdigest(), k, n) for k, d, n in rows if d == c)
        assert {r.n for r in got if r.target == c and r.is_test} == {n for _, _, n in mine[: -(-len(mine) // 5)]}


def test_quantile_of_empty_column_is_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    got = {r["col"]: r["value"] for r in exact_quantiles(df, ["a", "b"]).collect()}
    assert got == {"a": None, "b": 1.5}


def test_modes_smallest_on_tie(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "c string, d string")
    got = {r["col"]: r["value"] for r in modes(df, ["c", "d"]).collect()}
    assert got == {"c": "a", "d": "x"}


def test_time_features_sunday(spark):
    df = spark.createDataFrame([(dt.date(2025, 7, 6),)], "date date")
    r = FE.add_time(df).collect()[0]
    assert (r["weekday"], r["is_weekend"], r["week_of_year"], r["day"], r["month"], r["day_of_year"]) == (6, 1, 27, 6, 7, 187)
    from adperf.operators.aggregate import week_start

    assert df.select(week_start()).collect()[0][0] == dt.date(2025, 6, 30)


def test_unknown_target_raises(spark):
    df = spark.createDataFrame([(1.0,)], "roi double")
    with pytest.raises(ValueError, match="no such target"):
        FE.add_target(df, "nope")


@pytest.fixture(scope="module")
def kpi(spark):
    return kpi_frame(spark, SF_SMALL)


@pytest.mark.parametrize("target,n_num,n_cat", [("high_roi", 20, 6), ("revenue", 21, 6), ("high_conversion", 17, 6)])
def test_feature_counts(spark, kpi, target, n_num, n_cat):
    prep = FE.prepare_features(kpi, target, exact=False)
    assert len(prep.features) == n_num + n_cat
    assert (len(prep.numeric), len(prep.categorical)) == (n_num, n_cat)


def test_strict_mode_drops_label_for_revenue(kpi):
    names = FE.feature_names(FE.full_features(kpi, "revenue"), "revenue", "strict")
    assert "revenue" not in names and "revenue_per_click" not in names


def test_exact_split_invariants(spark, kpi):
    prep = FE.prepare_features(kpi, "high_roi", exact=True)
    fr = prep.frame
    counts = {(r["target"], r["is_test"]): r["n"] for r in fr.groupBy("target", "is_test").agg(F.count("*").alias("n")).collect()}
    total = kpi.count()
    assert sum(counts.values()) == total
    for cls in (0, 1):
        n_c = counts.get((cls, 0), 0) + counts.get((cls, 1), 0)
        assert counts.get((cls, 1), 0) == math.ceil(0.2 * n_c - 1e-9)
    assert fr.select("row_id").distinct().count() == total
