"""Linear models for a whole search at once: every draw and fold from shared passes.

* Ridge (M7): one pass gives a Gram matrix per fold.  The rows outside a fold have the sum
  of the other folds' matrices, so every penalty and every leave-one-fold-out fit is
  a small solve.
* Logistic regression (M4): all draws x folds (and the fits on all rows) are one block of coefficient
  rows.  A pass gives the loss and the gradient of every one of them; L-BFGS then
  moves each on its own, from a curvature bound that the Gram matrices give.  The number of
  jobs is the number of passes, whatever the number of draws.

Both penalise coefficients of features that are scaled on the fold's own training
rows, as a pipeline fitted per fold would; the passes read the rows once encoded
and the scaling is done on the sums.

Tasks give partial sums, which are added in groups and then to one array before they
reach the driver.  What it receives and holds has a size set by features, draws and folds,
not by rows; matrices of features x features are held per fold and class weight, not per draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf.session import materialize

#: Rows made dense at a time.
BLOCK = 4096
#: Steps that L-BFGS remembers.
MEMORY = 8
#: Tasks of a pass whose every task sends sums.
MOST_TASKS = 48
#: Rows above which the logistic search starts from the fits of fewer rows.
FEW = 200_000


def non_zeros(features: str = "features") -> tuple[Column, Column]:
    """(places, values) of a vector's stored numbers."""
    v = F.unwrap_udt(features)
    return F.when(v["type"] == 1, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(v["indices"]), v["values"]


def design(encoded: DataFrame, label: str = "target", fold: str = "_fold", store: bool = True) -> DataFrame:
    """(row_id, y, fold, at, x): the encoded rows with their non-zero features, stored once for all passes.

    ``store=False`` where ``encoded`` is a stored table: the passes read that.
    """
    at, x = non_zeros()
    rows = encoded.select("row_id", F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), at.alias("at"), x.alias("x"))
    return materialize(rows) if store else rows


def dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, matrix) of blocks of a batch."""
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.slice(lo, BLOCK)
        at, x = part.column("at"), part.column("x")
        n = np.diff(at.offsets.to_numpy())
        m = np.zeros((part.num_rows, width))
        m[np.repeat(np.arange(part.num_rows), n), at.flatten().to_numpy()] = x.flatten().to_numpy()
        yield slice(lo, lo + part.num_rows), m


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in at most ``MOST_TASKS`` parts (more where there are many cores): what tasks send in a pass does not grow with the rows."""
    return rows.coalesce(max(MOST_TASKS, 3 * rows.sparkSession.sparkContext.defaultParallelism))


def added(rows: DataFrame, columns: list[str], size: int, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of ``partial``, an array of ``size`` numbers a task.

    Tasks are summed in groups and the groups' sums in one more, always in the same order, so the driver receives one array.
    """
    data = dealt(rows.select(*columns))
    groups = max(1, round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))

    def run(batches):
        total = partial(batches)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"grp": pa.array([task % groups], pa.int32()), "task": pa.array([task], pa.int32()), "v": [total.astype("<f8").tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        v, total = table.column("v").combine_chunks(), np.zeros(size)
        for k in np.argsort(table.column("task").to_numpy()):
            total += np.frombuffer(v[k].as_buffer(), "<f8")
        # a group's sum counts as a task of the one group that is left
        return pa.table({"grp": pa.array([0], pa.int32()), "task": table.column("grp").slice(0, 1), "v": [total.tobytes()]})

    kind = "grp int, task int, v binary"
    parts = data.mapInArrow(run, kind).groupBy("grp").applyInArrow(add, kind).groupBy("grp").applyInArrow(add, kind).select("v").collect()
    return np.frombuffer(parts[0].v, "<f8").copy() if parts else np.zeros(size)


def gram(rows: DataFrame, width: int, folds: int, classes: int = 1, shift: float = 0.0) -> np.ndarray:
    """[fold, class] -> sum over its rows of z z' with z = (features, 1, y - shift); one pass."""
    side = width + 2
    shape = (folds, classes, side, side)

    def partial(batches):
        total = np.zeros(shape)
        for b in batches:
            y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
            for at, x in dense(b, width):
                z = np.concatenate([x, np.ones((len(x), 1)), y[at, None] - shift], axis=1)
                group = fold[at] * classes + (y[at].astype(int) if classes > 1 else 0)
                for g in np.unique(group):
                    part = z[group == g]
                    total[g // classes, g % classes] += part.T @ part
        return total.reshape(-1)

    return added(rows, ["y", "fold", "at", "x"], int(np.prod(shape)), partial).reshape(shape)


def held_out(total: np.ndarray) -> np.ndarray:
    """[fold] sums -> [fold or all] sums of the rows outside a fold; the last one has all rows."""
    whole = total.sum(axis=0)
    return np.stack([*(whole - t for t in total), whole])


def _scaling(s: np.ndarray, numeric: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) by which the first ``numeric`` features are scaled, from a Gram matrix; the others stay as they are."""
    width = len(s) - 2
    n = s[width, width]
    mean, scale = np.zeros(width), np.ones(width)
    mean[:numeric] = s[:numeric, width] / n
    var = np.diag(s)[:numeric] / n - mean[:numeric] ** 2
    scale[:numeric] = np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-300)), 1.0)
    return mean, scale


@dataclass
class Linear:
    """Coefficients of ``features`` and the intercept of each [fold or all, draw]."""

    coef: np.ndarray
    intercept: np.ndarray


def ridge(sums: np.ndarray, alphas: list[float], numeric: int, shift: float = 0.0) -> Linear:
    """M7: minimises the squared error plus alpha |w|^2, the intercept free, for all [fold or all, alpha]."""
    width = sums.shape[-1] - 2
    fits = held_out(sums.sum(axis=1))
    coef, intercept = np.zeros((len(fits), len(alphas), width)), np.zeros((len(fits), len(alphas)))
    for f, s in enumerate(fits):
        n = s[width, width]
        mean, scale = s[:width, width] / n, _scaling(s, numeric)[1]
        centred = (s[:width, :width] - n * np.outer(mean, mean)) / np.outer(scale, scale)
        cross = (s[:width, width + 1] - mean * s[width, width + 1]) / scale
        values, vectors = np.linalg.eigh(centred)
        turned = vectors.T @ cross
        for k, alpha in enumerate(alphas):
            w = vectors @ (turned / (np.maximum(values, 0) + alpha)) / scale
            coef[f, k] = w
            intercept[f, k] = s[width, width + 1] / n + shift - w @ mean
    return Linear(coef, intercept)


class Curvature:
    """A symmetric matrix that is not negative, whose inverse is applied with any penalty on all but its last row.

    One eigendecomposition serves all penalties: the last row and column are eliminated.
    """

    def __init__(self, matrix: np.ndarray):
        inner = matrix[:-1, :-1]
        # features that are not numbers give fits that are none, and no error
        values, self.vectors = np.linalg.eigh(inner) if np.isfinite(inner).all() else (np.full(len(inner), np.nan), inner)
        self.values = np.maximum(values, 0)
        self.cross, self.corner, self.trace = self.vectors.T @ matrix[:-1, -1], matrix[-1, -1], np.trace(matrix)

    def solve(self, penalty: float, v: np.ndarray) -> np.ndarray:
        """x with (matrix + penalty on all but the last + a little on the whole diagonal) x = v."""
        side = len(v)
        little = 1e-9 * (self.trace + penalty * (side - 1)) / side
        values = self.values + penalty + little
        turned = (self.vectors.T @ v[:-1]) / values
        last = (v[-1] - self.cross @ turned) / max(self.corner + little - self.cross @ (self.cross / values), little)
        return np.append(self.vectors @ (turned - last * self.cross / values), last)


@dataclass
class Draw:
    """One logistic candidate: inverse penalty and whether classes weigh the same."""

    c: float
    balanced: bool


def logistic(
    rows: DataFrame, draws: list[Draw], width: int, numeric: int, folds: int, tolerance: float = 1e-5, most_passes: int = 100, few: int = FEW,
) -> tuple[Linear, int]:
    """M4: (fits of all [fold or all, draw], passes over the rows).

    Above ``few`` rows the search starts from the fits of a sixteenth of the rows (which start likewise) instead of
    from zero.  That saves passes only: when a fit is done is decided by its gradient over all rows.

    Minimises the weighted log loss summed over the rows outside the fold plus
    |w|^2 / (2 c), the intercept free.  A fit is done when no component of its mean gradient
    passes ``tolerance``; after ``most_passes`` passes the fits are those reached.
    """
    fits = held_out(gram(rows, width, folds, classes=2))  # [fold or all, class]
    tasks = [(f, k) for f in range(folds + 1) for k in range(len(draws))]
    side = width + 1
    near = None
    if fits[:, :, width, width].sum(axis=1).max() > few:  # before this search holds more than its sums
        near, _ = logistic(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(16)) == 0), draws, width, numeric, folds, tolerance, most_passes, few)
    weight = np.ones((len(tasks), 2))  # of a row by class
    penalty = np.zeros((len(tasks), side))
    n_rows = np.zeros(len(tasks))
    mean, scale = np.zeros((folds + 1, width)), np.ones((folds + 1, width))  # of the features of the rows outside a fold
    curvature: dict[tuple[int, bool], Curvature] = {}
    for f in range(folds + 1):
        mean[f], scale[f] = _scaling(fits[f].sum(axis=0), numeric)
    for t, (f, k) in enumerate(tasks):
        per_class = np.array([s[width, width] for s in fits[f]])
        n_rows[t] = per_class.sum()
        if draws[k].balanced:
            weight[t] = n_rows[t] / (2 * np.maximum(per_class, 1))
        penalty[t, :width] = 1 / draws[k].c
        if (f, draws[k].balanced) not in curvature:
            to_raw = np.diag(np.append(1 / scale[f], 1.0))  # scaled coefficients -> coefficients of the encoded features
            to_raw[width, :width] = -mean[f] / scale[f]
            bound = sum(w * s[:side, :side] for w, s in zip(weight[t], fits[f], strict=True)) / 4
            curvature[f, draws[k].balanced] = Curvature(to_raw.T @ bound @ to_raw)
    del fits

    def raw_of(w: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Coefficients of the encoded features from scaled ones, a row each."""
        out = np.empty_like(w)
        out[:, :width] = w[:, :width] / scale[fold]
        out[:, width] = w[:, width] - (mean[fold] * out[:, :width]).sum(axis=1)
        return out

    def evaluate(w: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss and gradient of the tasks ``which`` at scaled coefficients w; one pass."""
        fold_of = np.array([tasks[t][0] for t in which])
        raw = raw_of(w, fold_of)
        by_fold = np.where(np.arange(folds)[:, None, None] != fold_of[None, None, :], weight[which].T[None], 0.0)  # fold, class, task
        m, size = len(which), len(which) * (side + 1)

        def partial(batches):
            total = np.zeros((m, side + 1))
            for b in batches:
                y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
                for at, x in dense(b, width):
                    yy = y[at, None]
                    margin = x @ raw[:, :width].T + raw[:, width]
                    small = np.exp(-np.abs(margin))
                    of_row = by_fold[fold[at], y[at].astype(int)]
                    loss = np.log1p(small) + np.maximum(margin, 0) - margin * yy
                    p = np.where(margin >= 0, 1, small) / (1 + small)
                    r = of_row * (p - yy)
                    total[:, :width] += r.T @ x
                    total[:, width] += r.sum(axis=0)
                    total[:, side] += (of_row * loss).sum(axis=0)
            return total.reshape(-1)

        total = added(rows, ["y", "fold", "at", "x"], size, partial).reshape(m, side + 1)
        g = total[:, :side] + penalty[which] * w
        g[:, :width] += (total[:, :width] - mean[fold_of] * total[:, width:side]) / scale[fold_of] - total[:, :width]
        return total[:, side] + (penalty[which] * w * w).sum(axis=1) / 2, g

    w = np.zeros((len(tasks), side))
    if near is not None:
        for t, (f, k) in enumerate(tasks):
            w[t] = np.append(near.coef[f, k] * scale[f], near.intercept[f, k] + mean[f] @ near.coef[f, k])
        # a start that is not a number is none
        w = np.where(np.isfinite(w).all(axis=1, keepdims=True), w, 0.0)
    loss, g = evaluate(w, np.arange(len(tasks)))
    passes = 2  # with the Gram matrices
    history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in tasks]
    step, way = np.ones(len(tasks)), np.zeros_like(w)
    fresh = np.ones(len(tasks), bool)
    live = np.abs(g).max(axis=1) > tolerance * n_rows
    while live.any() and passes < most_passes:
        which = np.flatnonzero(live)
        for t in which[fresh[which]]:
            f, k = tasks[t]
            of, least = curvature[f, draws[k].balanced], 1 / draws[k].c
            way[t], step[t] = -_two_loop(g[t], history[t], lambda v, of=of, least=least: of.solve(least, v)), 1.0
        trial = w[which] + step[which, None] * way[which]
        new_loss, new_g = evaluate(trial, which)
        passes += 1
        slope = (g[which] * way[which]).sum(axis=1)
        good = new_loss <= loss[which] + 1e-4 * step[which] * slope + 1e-12 * np.abs(loss[which])
        for j, t in enumerate(which):
            fresh[t] = good[j]
            if not good[j]:
                step[t] /= 2
                live[t] = step[t] > 1e-8
                continue
            s, v = trial[j] - w[t], new_g[j] - g[t]
            if s @ v > 1e-10 * np.sqrt((s @ s) * (v @ v)):
                history[t] = [*history[t], (s, v)][-MEMORY:]
            w[t], loss[t], g[t] = trial[j], new_loss[j], new_g[j]
            live[t] = np.abs(g[t]).max() > tolerance * n_rows[t]
    raw = raw_of(w, np.array([f for f, _ in tasks])).reshape(folds + 1, len(draws), side)
    return Linear(raw[:, :, :width], raw[:, :, width]), passes


def _two_loop(g: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]], inverse: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The L-BFGS direction; ``inverse`` applies that of the curvature bound."""
    q, factors = g.copy(), []
    for s, v in reversed(history):
        a = (s @ q) / (s @ v)
        factors.append(a)
        q -= a * v
    q = inverse(q)
    if history:
        s, v = history[-1]
        q *= (s @ v) / (v @ inverse(v))
    for (s, v), a in zip(history, reversed(factors), strict=True):
        q += s * (a - (v @ q) / (s @ v))
    return q


def out_of_fold(rows: DataFrame, fits: Linear, classify: bool) -> DataFrame:
    """(row_id, fold, draw, label, prediction, score): every row scored by the fits that did not see its fold.

    Lazy: tasks give a row's scores as one array, so a reader that groups them stores and moves no row per draw.
    """
    width = fits.coef.shape[-1]
    n = fits.coef.shape[1]

    def run(batches):
        for b in batches:
            fold = b.column("fold").to_numpy()
            for at, x in dense(b, width):
                score = np.zeros((len(x), n))
                for f in np.unique(fold[at]):
                    mine = fold[at] == f
                    score[mine] = x[mine] @ fits.coef[f].T + fits.intercept[f]
                guess = (score > 0).astype(float) if classify else score
                if classify:
                    score = np.where(score >= 0, 1.0, np.exp(-np.abs(score))) / (1 + np.exp(-np.abs(score)))
                part = b.slice(at.start, at.stop - at.start)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * n)
                arrays = [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (guess, score)]
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("fold"), part.column("y"), *arrays], names=["row_id", "fold", "label", "guess", "scores"])

    by_row = rows.select("row_id", "fold", "y", "at", "x").mapInArrow(run, "row_id string, fold int, label double, guess array<double>, scores array<double>")
    each = by_row.select("row_id", "fold", "label", "guess", F.posexplode("scores").alias("draw", "score"))
    return each.select("row_id", "fold", "draw", "label", F.get("guess", F.col("draw")).alias("prediction"), "score")
