"""Searches and attributions that must not store or score a row per draw, fold or hybrid."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from adperf.ml import linear, shapley, train
from adperf.ml.encode import encoder, scaled_slots, slot_names
from adperf.operators.features import Prepared


def frame(spark, n=300):
    rng = np.random.default_rng(8)
    x, k = rng.normal(size=(n, 2)) * [1, 20], rng.integers(0, 4, n)
    y = (x[:, 0] + (k == 1) + 0.3 * rng.normal(size=n) > 0.3).astype(int)
    data = [(f"{i:08x}", float(x[i, 0]), float(x[i, 1]), f"l{k[i]}", int(y[i]), int(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(data, "row_id string, a double, b double, k string, target int, is_test int")


@pytest.mark.parametrize("task,name,draws", [
    ("classification", "Logistic Regression", [{"c": 0.5, "balanced": False}, {"c": 5.0, "balanced": True}]),
    ("regression", "Ridge Regression", [{"alpha": 1.0}, {"alpha": 50.0}]),
])
def test_linear_search_stores_no_row_per_draw(spark, monkeypatch, task, name, draws):
    df = frame(spark)
    stored, keep = [], train.materialize
    for module in (train, linear):
        monkeypatch.setattr(module, "materialize", lambda d, *a, **k: (stored.append(tuple(d.columns)), keep(d, *a, **k))[1])
    prep = Prepared(df, df.where("is_test = 0").drop("is_test"), df.where("is_test = 1").drop("is_test"), ["a", "b", "k"], ["a", "b"], ["k"], task, "t")
    t = train.train_all_models(prep, cv_folds=3, models=[name], params={name: draws})[name]
    assert not any("draw" in c and "row_id" in c for c in stored) and not any("at" in c for c in stored)
    oof = t.out_of_fold.toPandas()
    assert len(oof) == 2 * 240 and (oof.groupby(["draw", "row_id"]).size() == 1).all() and oof.prediction.notna().all()
    assert set(map(tuple, oof[["draw", "fold"]].drop_duplicates().values)) == {(d, f) for d in range(2) for f in range(3)}


def test_search_from_near_start_ends_at_the_same_fits(spark):
    """Starting from the fits of fewer rows, the end is decided by all rows and reached in fewer passes over them."""
    df = frame(spark, 6000).withColumn("_fold", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    enc = encoder(["a", "b"], ["k"]).fit(df)
    rows, args = linear.design(enc.transform(df)), (len(slot_names(enc)), scaled_slots(enc), 3)
    draws = [linear.Draw(0.02, True), linear.Draw(10.0, False)]
    far, passes = linear.logistic(rows, draws, *args, tolerance=1e-8)
    near, fewer = linear.logistic(rows, draws, *args, tolerance=1e-8, few=500)
    assert np.allclose(far.coef, near.coef, atol=1e-5) and np.allclose(far.intercept, near.intercept, atol=1e-5)
    assert fewer < passes


@pytest.mark.parametrize("holes", [False, True])
def test_shares_equal_scored_hybrid_rows(spark, monkeypatch, holes):
    """The same draws give the same values as scoring every hybrid row; levels unseen, repeated and null values included."""
    df = frame(spark)
    enc = encoder(["a", "b"], ["k"]).fit(df)
    model = PipelineModel([*enc.stages, LogisticRegression(labelCol="target", regParam=0.01).fit(enc.transform(df))])
    rows = df.where("is_test = 1").withColumn("k", F.when(F.col("row_id").endswith("5"), "new").otherwise(F.col("k")))
    if holes:
        rows = rows.withColumn("a", F.when(F.col("row_id").endswith("a"), None).otherwise(F.col("a")))
    rows = rows.unionByName(rows.where("b > 5"))
    args = (model, rows, df.where("is_test = 0"), ["a", "k", "b"])
    assert shapley.additive_slots(model, args[3], "classification") and not shapley.additive_slots(model, ["a"], "classification")
    got = {(r.row_id, r.feature): r for r in shapley.sampled_shapley(*args, n_samples=5, background_size=9).collect()}
    monkeypatch.setattr(shapley, "additive_slots", lambda *a: None)
    want = {(r.row_id, r.feature): r for r in shapley.sampled_shapley(*args, n_samples=5, background_size=9).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * rows.count()
    for key, w in want.items():
        g = got[key]
        assert g.feature_value == w.feature_value and (math.isnan(g.shap) if math.isnan(w.shap) else math.isclose(g.shap, w.shap, abs_tol=1e-12)), key


def test_curvature_serves_every_penalty():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(40, 13))
    rows[:, 3] = rows[:, 4]
    matrix, v = rows.T @ rows, rng.normal(size=13)
    found = linear.Curvature(matrix)
    for penalty in (0.01, 5.0, 100.0):
        whole = matrix + np.diag([penalty] * 12 + [0.0])
        assert np.allclose(found.solve(penalty, v), np.linalg.solve(whole + 1e-9 * np.trace(whole) / 13 * np.eye(13), v), rtol=1e-6)
    assert np.isnan(linear.Curvature(np.full((3, 3), np.nan)).solve(1.0, np.ones(3))).all()


def test_search_holds_no_matrix_per_draw(spark):
    """What the driver holds beside the coefficients does not grow with the draws, and each sum reaches it as one array."""
    import tracemalloc

    df = frame(spark, 400).withColumn("k", F.concat(F.lit("l"), F.pmod(F.xxhash64("row_id"), F.lit(60)))).withColumn("_fold", F.pmod(F.xxhash64("row_id"), F.lit(3)).cast("int"))
    enc = encoder(["a", "b"], ["k"]).fit(df)
    rows, width = linear.design(enc.transform(df)), len(slot_names(enc))
    tracemalloc.start()
    try:
        peaks = []
        for n in (1, 60):
            tracemalloc.reset_peak()
            linear.logistic(rows, [linear.Draw(0.01 * (k + 1), k % 2 == 0) for k in range(n)], width, scaled_slots(enc), 3, most_passes=6)
            peaks.append(tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    per_draw = (peaks[1] - peaks[0]) / 59
    assert per_draw < 4 * (width + 1) ** 2 * 8 / 2, (peaks, width)


def test_tasks_of_a_pass_do_not_grow_with_the_parts(spark, monkeypatch):
    monkeypatch.setattr(linear, "MOST_TASKS", 5)
    most = max(5, 3 * spark.sparkContext.defaultParallelism)
    rows = spark.range(300, numPartitions=60).select(F.lit(1.0).alias("x"))

    def partial(batches):
        return np.array([1.0, sum(b.num_rows for b in batches)])

    seen = linear.added(rows, ["x"], 2, partial)
    assert seen[0] <= most and seen[1] == 300


def test_shuffle_files_go_before_the_fits(spark, monkeypatch):
    """What a step shuffled is not kept beside the tables of the next; the search asks for that before each table it stores."""
    import time
    from pathlib import Path

    from adperf import session

    dirs = [Path(str(p)) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def held():
        return sum(p.stat().st_size for d in dirs for p in d.glob("*/shuffle_*.data"))

    df = frame(spark, 3000)
    pad = F.expr("concat_ws('', transform(sequence(1, 40), i -> md5(concat(row_id, i))))")
    session.materialize(df.withColumn("pad", pad).repartition(3, "pad").withColumn("a", F.col("a") + 0 * F.length("pad")).drop("pad"))
    session.release(spark)
    end = time.time() + 15
    while held() > 500_000 and time.time() < end:
        time.sleep(0.2)
    assert held() <= 500_000  # 3.7 MB were shuffled
    made = []
    for name in ("materialize", "release"):
        original = getattr(train, name)
        monkeypatch.setattr(train, name, lambda *a, name=name, original=original: (made.append(name), original(*a))[1])
    prep = Prepared(df, df.where("is_test = 0").drop("is_test"), df.where("is_test = 1").drop("is_test"), ["a", "b", "k"], ["a", "b"], ["k"], "regression", "t")
    train.train_all_models(prep, cv_folds=2, models=["Ridge Regression"], params={"Ridge Regression": [{"alpha": 1.0}]})
    assert made[:4] == ["release", "materialize", "materialize", "release"]
