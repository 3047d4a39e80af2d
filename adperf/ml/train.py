"""Model training M4-M14.

* Encoding: one Pipeline of stages fitted on the training rows (``encode.py``), saved with the model.
* Search: seeded random draws of parameters, scored by weighted F1 (classification) or R2
  (regression) of every fold's own predictions.  Each model leaves an out-of-fold table (draw,
  fold, row, label, prediction, score), and means, deviations, boxes and the choice of a draw
  are grouped from it.
* The linear models advance all draws and folds together (``linear.py``).  The trees of a draw grow in all folds
  at once (``grow.py``); deep forests are fitted one by one, a few at a time, and ``minSamplesSplit`` cuts
  their small nodes (``trees.py``).  A draw's predictions are stored before the next draw is fitted, so that
  the models of one draw are held.
* The best draw is fitted on all training rows.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adperf.ml import grow, linear
from adperf.ml.encode import encoder, scaled_slots, slot_names
from adperf.ml.trees import min_split
from adperf.operators import evaluate as E
from adperf.operators.features import Prepared
from adperf.session import materialize, release


# --------------------------------------------------------------- search space
def _loguniform(rng, lo, hi):
    return float(math.exp(rng.uniform(math.log(lo), math.log(hi))))


# Reference search sizes per model.
N_ITER = {"Logistic Regression": 20, "Random Forest": 30, "Gradient Boosting": 30, "Ridge Regression": 20}


@dataclass
class Space:
    """Ranges of the random search.  ``reference`` mirrors the original
    ranges; ``quick`` keeps every knob but with few, shallow trees (for CI)."""

    trees: tuple[int, int] = (100, 500)
    gbt_trees: tuple[int, int] = (100, 400)
    depths: tuple = (5, 8, 12, 15, None)
    gbt_depth: tuple[int, int] = (3, 10)


SPACES = {
    "reference": Space(),
    "quick": Space(trees=(10, 30), gbt_trees=(10, 20), depths=(3, 5, 8), gbt_depth=(2, 5)),
}


def draw_params(name: str, n_iter: int, space: Space, task: str, seed: int = 42) -> list[dict]:
    """Seeded random draws, by the names of Spark's parameters (and c, alpha, balanced, minSamplesSplit)."""
    rng = np.random.default_rng(seed)
    draws = []
    for _ in range(n_iter):
        if name == "Logistic Regression":
            draws.append({"c": _loguniform(rng, 0.01, 100), "balanced": bool(rng.integers(2))})
        elif name == "Ridge Regression":
            draws.append({"alpha": _loguniform(rng, 0.001, 1000)})
        elif name == "Random Forest":
            depth = space.depths[int(rng.integers(len(space.depths)))]
            d = {
                "numTrees": int(rng.integers(*space.trees)), "maxDepth": 30 if depth is None else int(depth),
                "minSamplesSplit": int(rng.integers(2, 20)), "minInstancesPerNode": int(rng.integers(1, 10)),
                "featureSubsetStrategy": str(rng.choice(["sqrt", "log2", "all"])),
            }
            if task == "classification":
                d["balanced"] = bool(rng.integers(2))
            draws.append(d)
        else:  # Gradient Boosting
            draws.append({
                "maxIter": int(rng.integers(*space.gbt_trees)), "maxDepth": int(rng.integers(*space.gbt_depth)),
                "stepSize": _loguniform(rng, 0.01, 0.3), "subsamplingRate": float(rng.uniform(0.6, 1.0)),
                "minSamplesSplit": int(rng.integers(2, 20)), "minInstancesPerNode": int(rng.integers(1, 10)),
            })
    return draws


TREES = {
    ("classification", "Random Forest"): RandomForestClassifier, ("classification", "Gradient Boosting"): GBTClassifier,
    ("regression", "Random Forest"): RandomForestRegressor, ("regression", "Gradient Boosting"): GBTRegressor,
}
MODELS = {
    "classification": ["Logistic Regression", "Random Forest", "Gradient Boosting"],
    "regression": ["Ridge Regression", "Random Forest", "Gradient Boosting"],
}


def add_class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """``_w_balanced`` = n / (k * n_class) and ``_w_none`` = 1; the class
    count table has one row per class (broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("_w_balanced"))
    return df.join(F.broadcast(w), label, "left").withColumn("_w_none", F.lit(1.0))


def stratified_folds(df: DataFrame, folds: int, label: str | None = "target") -> DataFrame:
    """``_fold`` in 0..folds-1, of which every class has equally many rows (+-1); without a label all rows do.

    A row's place in its class by row_id, modulo ``folds``.  The place is the rows of
    lower row_id prefixes (from a table of classes x 65,536 counts, joined by
    measured size) plus the rank within the prefix, so no task ranks a whole class.
    """
    keys = ["_class", "_prefix"]
    df = df.withColumns({"_class": F.col(label) if label else F.lit(0), "_prefix": F.substring("row_id", 1, 4)})
    w = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_lower"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("row_id"))
    placed = df.withColumn("_rank", rank).join(counts, keys)
    return placed.withColumn("_fold", F.pmod(F.col("_lower") + F.col("_rank"), F.lit(folds)).cast("int")).drop("_class", "_prefix", "_rank", "_lower")


# ------------------------------------------------------------------ training
@dataclass
class Trained:
    name: str
    model: PipelineModel            # raw rows in, predictions out
    best_params: dict
    cv_mean: float
    cv_std: float
    train_time: float
    predictions: DataFrame          # test rows: row_id, target, prediction (+ score)
    test_rows: DataFrame            # raw rows
    train_rows: DataFrame
    out_of_fold: DataFrame          # every draw: row_id, fold, draw, label, prediction, score
    draw_scores: DataFrame          # draw, fold, score
    best_draw: int

    def folds(self) -> DataFrame:
        """(model, fold, score) of the best draw, for E12 and M13."""
        return self.draw_scores.where(F.col("draw") == self.best_draw).select(F.lit(self.name).alias("model"), "fold", "score")


def scored_draws(out_of_fold: DataFrame, task: str) -> DataFrame:
    """(draw, fold, score) from an out-of-fold table: weighted F1, or R2."""
    rows = out_of_fold.withColumn("model", F.concat_ws("#", "draw", "fold"))
    if task == "classification":
        rows = rows.withColumns({"label": F.col("label").cast("int"), "prediction": F.col("prediction").cast("int")})
        scores = E.classification_metrics_raw(rows).select("model", F.col("f1_score").alias("score"))
    else:
        scores = E.regression_metrics_raw(rows).select("model", F.col("r2_score").alias("score"))
    key = F.split("model", "#")
    return scores.select(key[0].cast("int").alias("draw"), key[1].cast("int").alias("fold"), "score")


def _score(df: DataFrame, task: str):
    return vector_to_array("probability")[1] if task == "classification" else F.col("prediction")


class _Search:
    """The encoded training rows of one target, and the fits of one model's draws over them."""

    def __init__(self, prepared: Prepared, train: DataFrame, folds: int, parallelism: int):
        self.task, self.folds, self.parallelism = prepared.task_type, folds, parallelism
        self.encoder = encoder(prepared.numeric, prepared.categorical).fit(train)
        label = "target" if self.task == "classification" else None
        train = stratified_folds(train, folds, label)
        if label:
            train = add_class_weights(train)
        names = ["row_id", "target", "_fold", "features"] + (["_w_none", "_w_balanced"] if label else [])
        self.encoded = materialize(self.encoder.transform(train).select(*names))
        del train
        release(self.encoded.sparkSession)
        self.spark, self.width, self.scaled = self.encoded.sparkSession, len(slot_names(self.encoder)), scaled_slots(self.encoder)
        self.marks = len(prepared.categorical)
        self._design: DataFrame | None = None
        self._coded: tuple[DataFrame, grow.Bins] | None = None

    def design(self) -> DataFrame:
        if self._design is None:
            self._design = linear.design(self.encoded, store=False)
        return self._design

    def linear_fits(self, draws: list[dict]) -> linear.Linear:
        if self.task == "classification":
            return linear.logistic(self.design(), [linear.Draw(**d) for d in draws], self.width, self.scaled, self.folds)[0]
        shift = self.design().agg(F.avg("y")).collect()[0][0] or 0.0
        return linear.ridge(linear.gram(self.design(), self.width, self.folds, shift=shift), [d["alpha"] for d in draws], self.scaled, shift)

    def linear_model(self, fits: linear.Linear, draw: int, params: dict):
        """The fit on all rows as Spark's own model."""
        if self.task == "classification":
            # Bounds that meet leave the optimiser no choice: Spark's model with these coefficients.
            w, b = Matrices.dense(1, self.width, fits.coef[-1, draw].tolist()), Vectors.dense([float(fits.intercept[-1, draw])])
            est = LogisticRegression(labelCol="target", standardization=False, maxIter=1, lowerBoundsOnCoefficients=w,
                                     upperBoundsOnCoefficients=w, lowerBoundsOnIntercepts=b, upperBoundsOnIntercepts=b)
            return est.fit(self.encoded)
        row = self.encoded.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("target").alias("s")).collect()[0]
        # Spark divides the penalty by the label's deviation
        penalty = params["alpha"] * (row.s or 1.0) / row.n
        return LinearRegression(labelCol="target", standardization=False, solver="normal", regParam=penalty, elasticNetParam=0.0).fit(self.encoded)

    def tree_estimator(self, name: str, params: dict):
        """The estimator and its ``minSamplesSplit``."""
        params = dict(params)
        least, balanced = params.pop("minSamplesSplit", 2), params.pop("balanced", None)
        est = TREES[self.task, name](labelCol="target", seed=42, **params)
        if balanced is not None:
            est = est.setWeightCol("_w_balanced" if balanced else "_w_none")
        return est, least

    def class_weights(self, column: str) -> tuple[float, float]:
        """Weight of a row of class 0 and 1."""
        of = {int(r.target): r.w for r in self.encoded.groupBy("target").agg(F.max(column).alias("w")).collect()}
        return of.get(0, 1.0), of.get(1, 1.0)

    def tree_models(self, name: str, params: dict, folds: list[int]) -> list:
        """The model without each of ``folds`` (-1: of all rows), by shared passes or, where trees are deep, one by one."""
        est, least = self.tree_estimator(name, params)
        if est.getMaxDepth() <= grow.MOST_DEPTH or name == "Gradient Boosting":  # small nodes of boosted trees cannot be cut afterwards
            if self._coded is None:
                self._coded = grow.coded(self.encoded, self.width, self.scaled, self.marks)
            rows, bins = self._coded
            weights = self.class_weights(est.getWeightCol()) if est.isSet("weightCol") else (1.0, 1.0)
            return grow.fits(est.copy() if not est.isSet("weightCol") else self._unweighted(est), rows, bins, self.width, folds, least, weights)
        with ThreadPoolExecutor(self.parallelism) as pool:
            return list(pool.map(lambda fold: min_split(est.fit(self.encoded.where(F.col("_fold") != fold)), least, self.spark), folds))

    @staticmethod
    def _unweighted(est):
        est = est.copy()
        est.clear(est.weightCol)
        return est

    def tree_out_of_fold(self, models: dict[tuple[int, int], object]) -> DataFrame:
        """The out-of-fold table of the models by (draw, fold)."""
        out = None
        for (draw, fold), model in models.items():
            rows = model.transform(self.encoded.where(F.col("_fold") == fold))
            part = rows.select("row_id", F.col("_fold").alias("fold"), F.lit(draw).alias("draw"), F.col("target").cast("double").alias("label"), "prediction", _score(rows, self.task).alias("score"))
            out = part if out is None else out.unionByName(part)
        return out


def train_all_models(
    prepared: Prepared,
    cv_folds: int = 5,
    n_iter: int | None = None,
    space: str = "reference",
    parallelism: int = 2,
    seed: int = 42,
    models: list[str] | None = None,
    params: dict[str, list[dict]] | None = None,
) -> dict[str, Trained]:
    """M4-M13 for every model of the task.

    ``n_iter=None`` uses the reference draw counts (20 / 30 / 30).  ``params`` gives a model's draws
    instead of random ones.
    """
    task = prepared.task_type
    # what cleaning, the split and the folds shuffled is not kept beside the next step's
    release(prepared.frame.sparkSession)
    frame = materialize(prepared.frame)
    train = frame.filter(F.col("is_test") == 0).drop("is_test")
    test = frame.filter(F.col("is_test") == 1).drop("is_test")
    search = _Search(prepared, train, cv_folds, parallelism)
    results: dict[str, Trained] = {}
    for name in MODELS[task]:
        if models and name not in models:
            continue
        draws = (params or {}).get(name) or draw_params(name, n_iter or N_ITER[name], SPACES[space], task, seed)
        t0 = time.time()
        if (task, name) in TREES:
            # one draw: the fit on all rows shares the passes of the folds
            asked = [*range(cv_folds), -1] if len(draws) == 1 else list(range(cv_folds))
            whole, oof = None, None
            for d, params_of in enumerate(draws):
                made = {(d, f): m for f, m in zip(asked, search.tree_models(name, params_of, asked), strict=True)}
                whole = made.pop((d, -1), None)
                part = materialize(search.tree_out_of_fold(made))
                oof = part if oof is None else oof.unionByName(part)
            del made
        else:
            fits = search.linear_fits(draws)
            # not stored: a row per draw is many times the training rows, and is only grouped
            oof = linear.out_of_fold(search.design(), fits, task == "classification")
        scores = materialize(scored_draws(oof, task))
        # a row per draw
        means = scores.groupBy("draw").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()
        best = min(means, key=lambda r: (-(r.m if r.m is not None else -math.inf), r.draw))
        if (task, name) in TREES:
            fitted = whole or search.tree_models(name, draws[best.draw], [-1])[0]
        else:
            fitted = search.linear_model(fits, best.draw, draws[best.draw])
        model = PipelineModel([*search.encoder.stages, fitted])
        preds = model.transform(test)
        preds = preds.select("row_id", "target", "prediction", *([_score(preds, task).alias("score")] if task == "classification" else []))
        results[name] = Trained(
            name=name, model=model, best_params=draws[best.draw], cv_mean=round(best.m, 4), cv_std=round(best.s, 4),
            train_time=round(time.time() - t0, 2), predictions=preds, test_rows=test, train_rows=train, out_of_fold=oof,
            draw_scores=scores, best_draw=best.draw,
        )
    return results


def out_of_fold_frame(trained: dict[str, Trained]) -> DataFrame:
    """(model, draw, fold, row_id, label, prediction, score) of all models."""
    out = None
    for name, t in trained.items():
        p = t.out_of_fold.select(F.lit(name).alias("model"), "draw", "fold", "row_id", "label", "prediction", "score")
        out = p if out is None else out.unionByName(p)
    return out


def folds_frame(trained: dict[str, Trained]) -> DataFrame:
    """(model, fold, score) of every model's best draw."""
    out = None
    for t in trained.values():
        out = t.folds() if out is None else out.unionByName(t.folds())
    return out


def scored_frame(trained: dict[str, Trained]) -> DataFrame:
    """Union of all models' test predictions as ``(row_id, model, label, prediction[, score])``."""
    out = None
    for name, t in trained.items():
        p = t.predictions.withColumn("model", F.lit(name)).withColumnRenamed("target", "label")
        out = p if out is None else out.unionByName(p)
    return out


def times_frame(spark, trained: dict[str, Trained]) -> DataFrame:
    return spark.createDataFrame([(n, t.train_time) for n, t in trained.items()], "model string, train_time_s double")


# ------------------------------------------------------------ importances
def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """Tree importances or |coefficients| by the name of each slot (one-hot slots are ``column=level``)."""
    est = model.stages[-1]
    names = [slot for slot, _ in slot_names(model)]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray()
    elif hasattr(est, "coefficients"):
        vals = np.abs(est.coefficients.toArray())
    else:
        vals = np.zeros(len(names))
    if len(names) != len(vals):
        raise ValueError(f"{len(names)} feature names for {len(vals)} values")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")


# ------------------------------------------------------------------ persist
def save_model(model: PipelineModel, path: str) -> None:
    """The best fitted pipeline, encoding included."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A saved pipeline; it scores raw rows, rare and unseen levels as training did."""
    return PipelineModel.load(path)
