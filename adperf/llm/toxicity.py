"""Severity of toxic language by cumulative-link ordinal regression.

The labels say toxic or not; a toxic text is of grade 1 or, where it has more
different marker words (words that toxic texts have far more often) than half of
the toxic texts, of grade 2.  The model is P(grade <= k) = sigmoid(t_k - w . x) with
one weight vector w for both thresholds t_0 < t_1.  x has a 1 for each hashed word
of the text.  The fit minimises the negative log-likelihood with an L1 penalty by
accelerated proximal gradient steps on a bounded sample of labelled documents;
all documents are scored.  Words enter the fit if their share of toxic texts
differs from the common share by more than chance allows for that many words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import binary_values, slices

#: Labelled rows that the fit may use, chosen by hash of the id; bounds what the driver holds.
TRAIN_ROWS = 8000
BITS = 18
GRADES = 3
PENALTY = 1e-5
STEPS = 300
#: Words that may enter the fit by chance alone, at most, as expected number.
BY_CHANCE = 0.2
EDGES = b".,;:!?\"'()[]{}<>*#-_"


class Features(dict):
    """token -> hashed feature; case of A-Z and punctuation around the token do not count."""

    def __missing__(self, token: bytes) -> int:
        self[token] = at = xxhash.xxh64_intdigest(token.strip(EDGES)) >> (64 - BITS)
        return at

    def of(self, text: bytes) -> np.ndarray:
        """The distinct features of a text."""
        if len(self) > 400_000:
            self.clear()
        return np.unique(np.fromiter(map(self.__getitem__, set(text.lower().split())), np.int64))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -500, 500)))


class OrdinalModel:
    """Weights of the hashed features and the ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def probabilities(self, score):
        """P(grade = 0 .. GRADES - 1) for scores w . x, one row each."""
        score = np.atleast_1d(np.asarray(score, float))
        below = sigmoid(self.cuts[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1), axis=1)


def grades(toxic: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Grade of each labelled text: 0, or 1 and 2 by its number of different marker words."""
    n = 1 << BITS
    have = [np.zeros(n), np.zeros(n)]
    for t, f in zip(toxic.tolist(), texts, strict=True):
        have[t][f] += 1
    rate = [(h + 0.5) / (1 + k) for h, k in zip(have, (np.sum(toxic == 0), np.sum(toxic == 1)), strict=True)]
    marker = (have[1] >= 3) & (rate[1] > 8 * rate[0])
    kinds = np.array([marker[f].sum() for f in texts])
    middle = np.median(kinds[toxic == 1]) if (toxic == 1).any() else 0.0
    return np.where(toxic == 1, 1 + (kinds > middle), 0)


def telling(grade: np.ndarray, rows: list[np.ndarray], by_chance: float = BY_CHANCE) -> np.ndarray:
    """Features that occur in three texts at least and in toxic ones more or less often than chance allows.

    The chance is Chernoff's bound of the binomial tail.
    """
    n = 1 << BITS
    seen, toxic = np.zeros(n), np.zeros(n)
    for g, f in zip(grade.tolist(), rows, strict=True):
        seen[f] += 1
        toxic[f] += g > 0
    at = np.flatnonzero(seen >= 3)
    p = min(max(float(np.mean(grade > 0)), 1e-9), 1 - 1e-9)
    share = toxic[at] / seen[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = np.where(share > 0, share * np.log(share / p), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - p)), 0)
    return at[np.exp(-seen[at] * apart) * len(at) < by_chance]


def fit(grade: np.ndarray, rows: list[np.ndarray], penalty: float = PENALTY, steps: int = STEPS) -> OrdinalModel:
    """Weights and thresholds for texts given by their features; without rows, everything is grade 0."""
    n, classes = 1 << BITS, GRADES
    if not len(grade):
        return OrdinalModel(np.zeros(n), np.arange(classes - 1) + 5.0)
    kept = telling(grade, rows)
    rows = [f[np.isin(f, kept)] for f in rows]
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    total = len(grade)
    freq = np.cumsum(np.bincount(grade, minlength=classes))[:-1]
    cuts = np.log((freq + 1) / (total - freq + 1))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(classes - 1))
    w, b = np.zeros(len(used)), np.array([cuts[0], *np.log(np.maximum(np.diff(cuts), 1e-3))])

    def thresholds(b):
        return np.cumsum([b[0], *np.exp(b[1:])])

    def gradient(w, b):
        t = thresholds(b)
        score = np.bincount(of, w[flat], minlength=total)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = sigmoid(edge[grade + 1] - score), sigmoid(edge[grade] - score)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / total  # of the negative log-likelihood by the score
        gw = np.bincount(flat, ds[of], minlength=len(used))
        gt = np.array([-(dhi[grade == k].sum() - dlo[grade == k + 1].sum()) / total for k in range(classes - 1)])
        gb = np.array([gt.sum(), *[gt[k:].sum() * np.exp(b[k]) for k in range(1, classes - 1)]])
        return gw, gb

    # a feature's step is the inverse of a bound on its curvature, so rare words move as fast as common ones
    rate = 4.0 * total / np.maximum(np.bincount(flat, sizes[of], minlength=len(used)), 1)
    wy, by, k = w, b, 1.0
    for _ in range(steps):
        gw, gb = gradient(wy, by)
        w_new = wy - rate * gw
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - rate * penalty, 0)
        b_new = by - gb
        k_new = (1 + np.sqrt(1 + 4 * k * k)) / 2
        move = (k - 1) / k_new
        if np.dot((wy - w_new) / rate, w_new - w) > 0:  # start over when the momentum points uphill
            k_new, move = 1.0, 0.0
        wy, by = w_new + move * (w_new - w), b_new + move * (b_new - b)
        w, b, k = w_new, b_new, k_new
    weights = np.zeros(n)
    weights[used] = w
    return OrdinalModel(weights, thresholds(b))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS
) -> OrdinalModel:
    """Fit on at most ``most`` labels of documents that have a text.

    Labels without such a document or without a value are not used and take no
    place.  Repeated labels count once, and of rows that share an id the least
    text counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("id is not null and toxic in (0, 1)").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    known = known.join(texts.select("id"), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id", "toxic").limit(most)  # bounded by `most`, so it may be broadcast

    def run(batches):
        features = Features()
        for b in slices(batches, "text"):
            found = pa.array([features.of(t) for t in binary_values(b.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), found], names=["id", "toxic", "features"])

    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    table = rows.mapInArrow(run, "id long, toxic int, features array<long>").toArrow().sort_by([("id", "ascending"), ("toxic", "ascending")])
    toxic = np.array(table.column("toxic").to_pylist(), int)
    found = [np.array(f, np.int64) for f in table.column("features").to_pylist()]
    return fit(grades(toxic, found) if len(toxic) else toxic, found)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic) of every row.

    ``grade`` is the likeliest one, ``toxic`` is P(grade > 0) >= 0.5.  A null or
    empty text has no feature; repeated rows give repeated results; an empty
    table gives none; other columns are not read.
    """
    weights, cuts = model.weights.astype(np.float32), model.cuts

    def run(batches):
        features, judge = Features(), OrdinalModel(weights, cuts)
        for b in slices(batches, "text"):
            s = [float(weights[features.of(t)].sum(dtype=np.float64)) for t in binary_values(b.column("text"))]
            p = judge.probabilities(s)
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= 0.5)],
                names=["id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, expected_severity double, grade int, p_toxic double, toxic boolean")
