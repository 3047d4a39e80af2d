"""Model training, encoding, persistence and attribution (sf0.001 and small frames)."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from adperf.ml import linear
from adperf.ml.encode import INFREQUENT, PopulationScaler, RareLevels, encoder, scaled_slots, slot_names
from adperf.ml.shapley import model_score, sampled_shapley
from adperf.ml.train import feature_importance, load_model, save_model, scored_draws, stratified_folds, train_all_models
from adperf.ml.trees import base_value, cut_small, min_split, node_table, tree_shap, trees_of, unique_ids
from adperf.operators import evaluate as E
from adperf.operators import features as FE
from adperf.plans.frames import kpi_frame
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    prep = FE.prepare_features(kpi_frame(spark, SF_SMALL), "high_roi", mode="strict")
    draws = {"Logistic Regression": [{"c": 0.05, "balanced": True}, {"c": 5.0, "balanced": False}]}
    t = train_all_models(prep, cv_folds=2, models=["Logistic Regression"], params=draws)
    return prep, t["Logistic Regression"]


def test_training_outputs(trained):
    prep, lr = trained
    assert 0.5 < lr.cv_mean <= 1.0 and lr.cv_std >= 0
    preds = lr.predictions.collect()
    assert len(preds) == prep.test.count()
    assert all(0.0 <= r["score"] <= 1.0 for r in preds)
    assert {r["prediction"] for r in preds} <= {0.0, 1.0}


def test_out_of_fold_table_gives_means_and_choice(trained):
    """Every training row once a draw; mean, deviation and best draw follow from the table alone."""
    prep, lr = trained
    oof = lr.out_of_fold.toPandas()
    assert len(oof) == 2 * prep.train.count() and set(oof.draw) == {0, 1} and set(oof.fold) == {0, 1}
    assert (oof.groupby("row_id").fold.nunique() == 1).all()
    scores = {(r.draw, r.fold): r.score for r in scored_draws(lr.out_of_fold, "classification").collect()}
    for (draw, fold), got in scores.items():
        part = oof[(oof.draw == draw) & (oof.fold == fold)]
        f1 = 0.0
        for c in (0, 1):
            tp = ((part.label == c) & (part.prediction == c)).sum()
            f1 += 2 * tp / ((part.label == c).sum() + (part.prediction == c).sum()) * (part.label == c).mean()
        assert math.isclose(got, f1, rel_tol=1e-12)
    means = [np.mean([scores[d, f] for f in range(2)]) for d in range(2)]
    assert lr.best_draw == int(np.argmax(means)) and lr.cv_mean == round(max(means), 4)
    assert lr.cv_std == round(np.std([scores[lr.best_draw, f] for f in range(2)]), 4)
    row = E.cv_summary(lr.folds()).collect()[0]
    assert (row.cv_mean, row.cv_std) == (lr.cv_mean, lr.cv_std) and E.cv_box(lr.folds()).count() == 1


# ----------------------------------------------------------- linear models
def linear_rows(spark, n=400, classes=True):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1, 30, 0.2] + [0, 100, 5]
    level = rng.integers(0, 4, n)
    z = 0.8 * x[:, 0] + 0.02 * (x[:, 1] - 100) + (level == 2) + rng.normal(size=n) * 0.7
    y = (z > 0.4).astype(float) if classes else z
    data = [(f"{k:05x}", *map(float, x[k]), f"l{level[k]}", float(y[k]), k % 3) for k in range(n)]
    df = spark.createDataFrame(data, "row_id string, a double, b double, c double, k string, target double, _fold int")
    enc = encoder(["a", "b", "c"], ["k"]).fit(df)
    return enc, enc.transform(df).cache()


def test_batched_logistic_equals_single_fits(spark):
    """All draws and folds together against one Spark fit each, scaled on its own fold's rows; the same draw wins."""
    enc, df = linear_rows(spark)
    width, numeric = len(slot_names(enc)), scaled_slots(enc)
    draws = [linear.Draw(0.003, False), linear.Draw(0.5, True), linear.Draw(30.0, False)]
    rows = linear.design(df)
    fits, passes = linear.logistic(rows, draws, width, numeric, 3, tolerance=1e-7)
    assert 4 < passes < 60
    single = {}
    for f in (0, 3):
        train = df.where(F.col("_fold") != f).drop("features", *[f"_{p}_{c}" for p in "z" for c in "abc"], "_lvl_k", "_idx_k", "_hot_k")
        fold_enc = encoder(["a", "b", "c"], ["k"]).fit(train)
        n, counts = train.count(), {r.target: r["count"] for r in train.groupBy("target").count().collect()}
        train = fold_enc.transform(train).withColumn("w", F.when(F.col("target") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0])))
        for k, d in enumerate(draws):
            est = LogisticRegression(labelCol="target", standardization=False, regParam=1 / (d.c * n), elasticNetParam=0.0, maxIter=500, tol=1e-10)
            model = (est.setWeightCol("w") if d.balanced else est).fit(train)
            scored = PipelineModel([*fold_enc.stages, model]).transform(df.select("row_id", "a", "b", "c", "k", "target", "_fold"))
            single[f, k] = {r.row_id: (r.p[1], r.target, r.prediction, r._fold) for r in scored.select("row_id", F.col("probability").alias("p"), "target", "prediction", "_fold").collect()}
    x = df.select("row_id", F.col("features")).collect()
    for (f, k), want in single.items():
        for r in x:
            p = 1 / (1 + math.exp(-(r.features.toArray() @ fits.coef[f, k] + fits.intercept[f, k])))
            assert math.isclose(p, want[r.row_id][0], abs_tol=2e-4), (f, k)
    oof = linear.out_of_fold(rows, fits, True)
    for r in oof.where("fold = 0").collect():
        assert math.isclose(r.score, single[r.fold, r.draw][r.row_id][0], abs_tol=2e-4) and r.prediction == (r.score > 0.5)


def test_jobs_do_not_grow_with_draws(spark):
    enc, df = linear_rows(spark, 120)
    rows = linear.design(df)
    made = [0]
    original = linear.added

    def counted(*a):
        made[0] += 1
        return original(*a)

    linear.added = counted
    try:
        passes = []
        for n in (1, 12):
            made[0] = 0
            got = linear.logistic(rows, [linear.Draw(0.5, False)] * n, len(slot_names(enc)), 3, 3)[1]
            assert made[0] == got
            passes.append(got)
    finally:
        linear.added = original
    assert passes[0] == passes[1]


def test_ridge_equals_spark_and_closed_form(spark):
    enc, df = linear_rows(spark, classes=False)
    rows = linear.design(df)
    width, numeric = len(slot_names(enc)), scaled_slots(enc)
    shift = 0.7
    alphas = [0.01, 5.0, 800.0]
    fits = linear.ridge(linear.gram(rows, width, 3, shift=shift), alphas, numeric, shift)
    n, deviation = df.agg(F.count("*"), F.stddev_pop("target")).collect()[0]
    x = {r.row_id: (r.features.toArray(), r.target, r._fold) for r in df.select("row_id", "features", "target", "_fold").collect()}
    for k, a in enumerate(alphas):
        model = LinearRegression(labelCol="target", standardization=False, solver="normal", regParam=a * deviation / n, elasticNetParam=0.0).fit(df)
        assert np.allclose(model.coefficients.toArray(), fits.coef[3, k], atol=1e-6) and math.isclose(model.intercept, fits.intercept[3, k], abs_tol=1e-6)
        for f in range(4):
            m = np.array([v for v, _, g in x.values() if g != f])
            y = np.array([t for _, t, g in x.values() if g != f])
            s = np.ones(width)
            s[:numeric] = m[:, :numeric].std(axis=0)
            c = (m - m.mean(axis=0)) / s
            w = np.linalg.solve(c.T @ c + a * np.eye(width), c.T @ (y - y.mean())) / s
            assert np.allclose(w, fits.coef[f, k], atol=1e-8) and math.isclose(y.mean() - w @ m.mean(axis=0), fits.intercept[f, k], abs_tol=1e-8)


# ------------------------------------------------------- encoding, saving
def test_encoder_stages(spark):
    df = spark.createDataFrame([(float(k % 4), 7.0, "ab"[k % 2] if k else "rare", None if k == 3 else "z") for k in range(9)], "x double, one double, c string, d string")
    z = PopulationScaler(inputCols=["x", "one"], outputCols=["zx", "zo"]).fit(df).transform(df).collect()
    x = np.array([k % 4 for k in range(9)], float)
    assert np.allclose([r.zx for r in z], (x - x.mean()) / x.std()) and all(r.zo == 0 for r in z)
    model = RareLevels(inputCols=["c", "d"], outputCols=["lc", "ld"]).fit(df)
    new = spark.createDataFrame([("a", "z"), ("rare", "w"), ("unseen", None), (None, "z")], "c string, d string")
    assert [(r.lc, r.ld) for r in model.transform(new).collect()] == [("a", "z"), (INFREQUENT, "w"), (INFREQUENT, None), (INFREQUENT, "z")]
    one = RareLevels(inputCols=["c"], outputCols=["lc"], minFrequency=1).fit(df)
    assert [r.lc for r in one.transform(new).collect()] == ["a", "rare", "unseen", None]


def test_one_saved_object_scores_raw_rows(spark, trained, tmpdir_path):
    """Reloaded predictions are the same; rare and unseen levels go where training put them."""
    _, lr = trained
    save_model(lr.model, f"{tmpdir_path}/model")
    again = load_model(f"{tmpdir_path}/model")
    a, b = ({r.row_id: r._f for r in model_score(m, lr.test_rows, "classification").select("row_id", "_f").collect()} for m in (lr.model, again))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)
    rows = [(f"r{i}", float(i % 5), "ab"[i % 2] if i else "rare", float(i % 2)) for i in range(41)]
    df = spark.createDataFrame(rows, "row_id string, x double, c string, target double")
    model = Pipeline(stages=[encoder(["x"], ["c"]), LinearRegression(labelCol="target", regParam=0.1)]).fit(df)
    save_model(model, f"{tmpdir_path}/m")
    new = spark.createDataFrame([("r0", 0.0, "unseen", 0.0), ("null", 0.0, None, 0.0)], df.schema)
    got = {(r.row_id, r.c): r.prediction for r in load_model(f"{tmpdir_path}/m").transform(df.unionByName(new)).collect()}
    assert len(got) == 43 and got["r0", "rare"] == got["r0", "unseen"] == got["null", None]
    assert slot_names(PipelineModel(model.stages[0].stages))[0] == ("x", "x")


def test_importance_names(spark, trained):
    _, lr = trained
    imp = feature_importance(lr.model, spark).collect()
    names = {r["feature"] for r in imp}
    assert "ctr" in names and any(n.startswith("channel=") for n in names)


@pytest.mark.parametrize("label", ["target", None])
def test_folds_are_even(spark, label):
    df = spark.range(1003).selectExpr("md5(cast(id % 900 AS string)) AS row_id", "cast(id % 7 = 0 AS int) AS target")
    rows = stratified_folds(df, 5, label).withColumn("c", F.col(label) if label else F.lit(0))
    n = {(r.c, r._fold): r["count"] for r in rows.groupBy("c", "_fold").count().collect()}
    for cls in {c for c, _ in n}:
        sizes = [n[cls, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert sum(n.values()) == 1003


# ------------------------------------------------------------------- trees
def tree_rows(spark):
    rng = np.random.default_rng(9)
    data = []
    for k in range(300):
        a, b, c = rng.integers(0, 6), rng.normal(), "pqr"[rng.integers(0, 3)]
        y = a * 0.5 + (b > 0.2) * (2 if c == "p" else 0.3) + (c == "q") * b + rng.normal() * 0.1
        data.append((f"r{k:03d}", float(a), float(b), c, float(y), float(y > 1.6)))
    return spark.createDataFrame(data, "row_id string, a double, b double, c string, y double, target double")


ENSEMBLES = {
    "forest classifier": lambda: RandomForestClassifier(labelCol="target", numTrees=3, maxDepth=4, seed=3),
    "boosted classifier": lambda: GBTClassifier(labelCol="target", maxIter=3, maxDepth=3, seed=3),
    "forest regressor": lambda: RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=5, seed=3),
    "boosted regressor": lambda: GBTRegressor(labelCol="y", maxIter=2, maxDepth=3, seed=3),
}


def expectation(tree, x, known, node=0):
    """The tree's mean where only the slots ``known`` are told, the others averaged by training shares."""
    if tree.left[node] < 0:
        return tree.value[node]
    f, children = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        values = tree.left_values[node]
        goes = x[f] <= tree.threshold[node] if values is None else x[f] in values
        return expectation(tree, x, known, children[0] if goes else children[1])
    return sum(tree.cover[c] / tree.cover[node] * expectation(tree, x, known, c) for c in children)


@pytest.mark.parametrize("kind", ENSEMBLES)
def test_tree_attribution_equals_all_subsets(spark, kind):
    df, est = tree_rows(spark), ENSEMBLES[kind]()
    model = Pipeline(stages=[encoder(["a", "b"], ["c"]), est]).fit(df)
    model = PipelineModel([*model.stages[0].stages, model.stages[1]])
    names = slot_names(model)
    trees = trees_of(model.stages[-1], spark)
    assert any(v is not None for t in trees for v in t.left_values), "no split by a category in this test"
    ask = df.limit(12)
    slots = {(r.row_id, r.feature): r.shap for r in tree_shap(model, ask, slots=True, most_nodes=5).collect()}
    whole = {(r.row_id, r.feature): (r.shap, r.feature_value) for r in tree_shap(model, ask).collect()}
    scored = model.transform(ask).collect()
    base, d = base_value(trees), len(names)
    for r in scored:
        x = r.features.toArray()
        value = {s: sum(expectation(t, x, s) for t in trees) for n in range(d + 1) for s in itertools.combinations(range(d), n)}
        for i in range(d):
            want = sum(
                math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (value[tuple(sorted((*s, i)))] - v)
                for s, v in value.items() if i not in s
            )
            assert math.isclose(slots[r.row_id, names[i][0]], want, abs_tol=1e-10)
        fx = r.prediction
        if "target" == est.getLabelCol():
            p = r.probability[1]
            fx = math.log(p / (1 - p)) if isinstance(est, GBTClassifier) else p
        assert math.isclose(sum(v for (i, _), (v, _) in whole.items() if i == r.row_id), fx - base, abs_tol=1e-9)
        assert whole[r.row_id, "a"][1] == r.a and whole[r.row_id, "c"][1] is None


def test_tree_attribution_of_repeated_rows(spark):
    df = tree_rows(spark)
    model = Pipeline(stages=[encoder(["a", "b"], ["c"]), ENSEMBLES["forest regressor"]()]).fit(df)
    model = PipelineModel([*model.stages[0].stages, model.stages[1]])
    two = df.limit(2).unionByName(df.limit(2)).unionByName(df.limit(1))
    rows = tree_shap(model, two).collect()
    assert len(rows) == 5 * 3 and len({(r.row_id, r.feature) for r in rows}) == 15
    assert len({r.row_id for r in rows if "#" in r.row_id}) == 3
    assert unique_ids(df).exceptAll(df).isEmpty()


@pytest.mark.parametrize("kind", ["forest classifier", "forest regressor"])
def test_min_split_cuts_small_nodes(spark, kind):
    """No inner node under the limit is left, nothing else changes, and the result saves and loads."""
    df, est = tree_rows(spark), ENSEMBLES[kind]()
    enc = encoder(["a", "b"], ["c"]).fit(df)
    rows = enc.transform(df)
    model = est.fit(rows)
    cut = min_split(model, 60, spark)
    before, after = ({(r.treeID, r.nodeData.id): r.nodeData for r in node_table(m, spark).collect()} for m in (model, cut))
    small = [n for n in before.values() if n.leftChild >= 0 and n.rawCount < 60]
    assert small and len(after) < len(before) and type(cut) is type(model)
    assert all(n.rawCount >= 60 for n in after.values() if n.leftChild >= 0)

    def walk(nodes, tree, at, least):
        n = nodes[tree, at]
        if n.leftChild < 0 or n.rawCount < least:
            return (n.rawCount, n.prediction)
        return (n.rawCount, n.split, walk(nodes, tree, n.leftChild, least), walk(nodes, tree, n.rightChild, least))

    for t in {t for t, _ in before}:
        assert walk(before, t, 0, 60) == walk(after, t, 0, 0)
        assert sorted(i for u, i in after if u == t) == list(range(sum(u == t for u, _ in after)))
    assert cut.transform(rows).where("prediction IS NULL").isEmpty() and cut.featureImportances.size == model.featureImportances.size
    assert min_split(model, 2, spark) is model
    assert [n["id"] for n in cut_small({0: {"id": 0, "leftChild": -1, "rightChild": -1, "rawCount": 1}}, 5)] == [0]


def test_shapley_of_repeated_rows_and_of_a_tree(spark):
    """A repetition has the values of its first row; a tree model's values add up too."""
    rows = [(f"r{i}", float(i % 4), float(i % 3), float((i % 4) * (i % 3))) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v"), DecisionTreeRegressor(featuresCol="v", labelCol="y")]).fit(df)
    z = df.filter("row_id = 'r0'")
    ask = df.filter("row_id IN ('r7', 'r11')")
    shap = sampled_shapley(model, ask.unionByName(ask).unionByName(ask.limit(1)), z, ["a", "b"], task="regression", n_samples=4, background_size=1)
    sums = {r.row_id: r.s for r in shap.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    fx = {r.row_id: r.prediction for r in model.transform(df).collect()}
    assert len(sums) == 5 and shap.count() == 10
    for k, s in sums.items():
        assert math.isclose(s, fx[k.split("#")[0]] - fx["r0"], abs_tol=1e-12)


def test_shapley_additivity(spark, trained):
    """With one background row, sum(shap) = f(x) - f(z) exactly per row."""
    prep, lr = trained
    feats = prep.numeric + prep.categorical
    rows = lr.test_rows.orderBy("row_id").limit(20)
    bg = lr.train_rows.orderBy("row_id").limit(1)
    shap = sampled_shapley(lr.model, rows, bg, feats, n_samples=3, background_size=1)
    sums = {r["row_id"]: r["s"] for r in shap.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    fx = {r["row_id"]: r["_f"] for r in model_score(lr.model, rows, "classification").select("row_id", "_f").collect()}
    fz = model_score(lr.model, bg, "classification").select("_f").collect()[0][0]
    assert len(sums) == 20
    for k, s in sums.items():
        assert math.isclose(s, fx[k] - fz, abs_tol=1e-9)
    assert shap.select("feature").distinct().count() == len(feats)


def test_run_ml_regression_end_to_end(spark, tmpdir_path):
    """Revenue target: three regressors, comparison, boxes, saved model, attribution and residuals all build and run."""
    from adperf.plans.pipeline import run_ml

    draws = {"Random Forest": [{"numTrees": 4, "maxDepth": 4, "minSamplesSplit": 30}], "Gradient Boosting": [{"maxIter": 3, "maxDepth": 3}]}
    out = run_ml(kpi_frame(spark, SF_SMALL), "revenue", cv_folds=2, model_path=tmpdir_path, params=draws)
    comp = {r["model"]: r for r in out["comparison"].collect()}
    assert set(comp) == {"Ridge Regression", "Random Forest", "Gradient Boosting"}
    assert all(r["rmse"] >= 0 and r["cv_std"] >= 0 for r in comp.values())
    assert out["best_model"] in comp and out["cv_box"].count() == 3
    assert len(out["residual_hist"].collect()) == 30
    assert 0 < out["attr_bar"].count() <= 15
    raw = FE.prepare_features(kpi_frame(spark, SF_SMALL), "revenue", mode="strict").test
    assert load_model(f"{tmpdir_path}/best_model_revenue").transform(raw).filter("prediction IS NULL").count() == 0
    assert set(out) == {
        "comparison", "best_model", "out_of_fold", "cv_summary", "cv_box", "importance", "top_importance", "attr_importance", "attr_bar",
        "attr_direction", "attr_extremes", "attr_top10", "attr_summary", "attr_waterfall", "score_order", "target_range", "residual_band",
        "pred_vs_actual", "residual_hist",
    }
