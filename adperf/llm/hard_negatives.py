"""Hard negatives of anchor rows by threshold joins over vectors (L2AP style).

Components are integers, ``floor(scale * x)``, and a score is their inner product,
so scores are exact.  An anchor's windows are score intervals with a number of rows
to find: one for its positives (rows of its label), then one below each
positive for its negatives (rows of other labels).

1. Anchors and rows are dealt into blocks of bounded size; a task has one block of
   each, so no task grows with a label and no pair is a row.
2. Dimensions are taken by decreasing energy, in segments.  A row's index entries end
   at the segment from which on its norm times the largest such norm of an anchor
   stays under the least threshold: a pair that meets only there cannot reach it.
3. Partial scores are accumulated over the indexed segments.  After each, pairs whose partial
   score plus the product of the remaining norms stays under the anchor's
   threshold are dropped.  Once few pairs are left they are finished one by one.
4. A task gives each window's best rows of its block, and the best of all blocks
   count.  A window that stays unfilled searches again with a lower threshold; the
   last one is the window's own lower end, so nothing is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import stored

SCALE = 256
#: Rows of a block: anchors and rows searched.  They bound a task's memory.
ANCHORS, ROWS = 512, 8192
#: Dimensions of a segment.
SEGMENT = 8
#: Share of pairs at or under which pairs are finished one by one.
FEW = 0.1
#: Part of a window, from its upper end, that each round searches.
POSITIVE_SHARES, NEGATIVE_SHARES = (0.25, 0.375, 0.5, 1.0), (0.125, 0.5, 1.0)
#: Norm products from here up do not fit the integers used.
TOO_LARGE = 2.0**56
FOUND = "anchor long, w int, row long, id long, score long"


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int = SCALE) -> DataFrame:
    """(row, id, label, anchor, v): the rows that take part, numbered and stored, with integer components."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))))
    rows = vectors.where(label.isNotNull() & x.isNotNull() & whole)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of floats; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), max(size, default=0)))
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def energy(rows: DataFrame) -> list[int]:
    """Dimensions by decreasing sum of squares; as many numbers as a vector has components."""

    def run(batches):
        for b in batches:
            e = np.square(matrix(b.column("v"))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(e)), pa.int32()), pa.array(e)], names=["d", "e"])

    sums = rows.select("v").mapInArrow(run, "d int, e double").groupBy("d").agg(F.sum("e").alias("e"))
    return [r.d for r in sorted(sums.collect(), key=lambda r: (-r.e, r.d))]


def threshold_pairs(q: np.ndarray, x: np.ndarray, least: np.ndarray, segment: int = SEGMENT, few: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose inner product is at least the query's threshold.

    Vectors are rows of whole numbers held as floats, thresholds are integers.
    """
    m, d = q.shape
    borders = [*range(0, d, segment), d]
    parts = [slice(a, b) for a, b in zip(borders, borders[1:], strict=False)]
    rest = lambda v: np.stack([np.sqrt(np.square(v[:, b:]).sum(axis=1)) for b in borders]) * (1 + 1e-9)
    qs, xs = rest(q), rest(x)
    top = qs[0].max(initial=0) * xs[0].max(initial=0)
    if top >= TOO_LARGE:
        raise ValueError("vectors too long for exact scores")
    if top >= 2.0**52:
        q, x = q.astype(np.int64), x.astype(np.int64)
    least = least.astype(q.dtype)
    slack = 1e-14 * top  # never drops a pair for rounding
    # the inverted index: rows by decreasing number of indexed segments, so the postings of a segment are the first of them
    if least.min() > 0:
        indexed = (xs[:-1] * qs.max(axis=1)[:-1, None] + slack >= least.min()).sum(axis=0)
    else:
        indexed = np.full(len(x), len(parts))
    order = np.argsort(-indexed, kind="stable")
    x, xs, indexed = x[order], xs[:, order], indexed[order]
    entries = [int((indexed > s).sum()) for s in range(len(parts))]
    n = entries[0] if parts else len(x)
    score, alive = np.zeros((m, n), q.dtype), np.ones((m, n), bool)
    qi = xi = None
    for s, part in enumerate(parts):
        stop, after = entries[s], s + 1
        if qi is None:
            score[:, :stop] += q[:, part] @ x[:stop, part].T
            alive[:, :stop] = score[:, :stop] + (qs[after][:, None] * xs[after, None, :stop] + slack) >= least[:, None]
            if alive.sum() <= few * alive.size:
                qi, xi = np.nonzero(alive)
                score = score[qi, xi]
        else:
            has = np.flatnonzero(xi < stop)
            score[has] += np.einsum("ij,ij->i", q[qi[has], part], x[xi[has], part])
            keep = np.ones(len(qi), bool)
            keep[has] = score[has] + (qs[after][qi[has]] * xs[after][xi[has]] + slack) >= least[qi[has]]
            qi, xi, score = qi[keep], xi[keep], score[keep]
    if qi is None:
        qi, xi = np.nonzero(alive)
        score = score[qi, xi]
    # the dimensions that the index leaves out
    for s, part in enumerate(parts):
        late = np.flatnonzero(indexed[xi] <= s)
        score[late] += np.einsum("ij,ij->i", q[qi[late], part], x[xi[late], part])
    hit = score >= least[qi]
    return qi[hit], order[xi[hit]], score[hit].astype(np.int64)


def best_of_block(anchors: pa.Table, rows: pa.Table, order: list[int], k: int, same: bool) -> pa.Table:
    """The best k rows of a block for every window of the anchors (FOUND)."""
    if not anchors.num_rows or not rows.num_rows:  # a block that no row was dealt to
        return pa.table({c: pa.array([], t) for c, t in (("anchor", pa.int64()), ("w", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64()))})
    q, x = matrix(anchors.column("v")), matrix(rows.column("v"))
    d = len(order)
    q, x = (np.pad(v, ((0, 0), (0, d - v.shape[1])))[:, order] for v in (q, x))
    windows = anchors.column("windows").combine_chunks()
    size = np.diff(windows.offsets.to_numpy())
    flat = windows.flatten()
    w, at, hi = (flat.field(c).to_numpy() for c in ("w", "at", "hi"))
    first = np.cumsum(size) - size
    least = np.minimum.reduceat(at, first)
    qi, xi, score = threshold_pairs(q, x, least)
    row, label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
    of, mine = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    fits = (label[xi] == mine[qi]) & (row[xi] != of[qi]) if same else label[xi] != mine[qi]
    qi, xi, score = qi[fits], xi[fits], score[fits]
    ids = rows.column("id").combine_chunks()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    key = ids.fill_null(0).to_numpy()
    by = np.lexsort((row[xi], key[xi], none[xi], -score, qi))
    qi, xi, score = qi[by], xi[by], score[by]
    begin, end = np.searchsorted(qi, np.arange(len(of))), np.searchsorted(qi, np.arange(len(of)), "right")
    out = []
    for i in range(len(of)):
        falling = -score[begin[i] : end[i]]
        for j in range(first[i], first[i] + size[i]):
            a, b = np.searchsorted(falling, -hi[j]), np.searchsorted(falling, -at[j], "right")
            out.append((i, j, begin[i] + np.arange(a, min(a + k, b))))
    pick = np.concatenate([p for _, _, p in out]) if out else np.empty(0, np.int64)
    times = [len(p) for _, _, p in out]
    which = lambda values: pa.array(np.repeat(values, times))
    return pa.table({
        "anchor": which(of[[i for i, _, _ in out]]), "w": which(w[[j for _, j, _ in out]].astype(np.int32)),
        "row": pa.array(row[xi[pick]]), "id": ids.take(pa.array(xi[pick])), "score": pa.array(score[pick]),
    })


def _blocks(spaces: DataFrame, df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
    """Rows with their block by row number, once for each block of the other side of their space."""
    mine = F.pmod(F.xxhash64("row"), F.col(own)).cast("int").alias(own_block)
    return df.join(spaces, "space").select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_block))


def best_in_windows(rows: DataFrame, windows: DataFrame, order: list[int], k: int, same: bool, shares: tuple[float, ...]) -> DataFrame:
    """(anchor, w, row, id, score, rank) of the k best rows in each window (anchor, w, lo, hi); stored.

    Higher scores come first, of equal scores smaller ids, null ids last.
    """
    # positives are sought among rows of the label, negatives among all
    space = F.col("label") if same else F.lit(0)
    all_rows = rows.select(space.alias("space"), "row", "id", "label", "v")
    sizes = all_rows.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("rb"))
    rank = F.row_number().over(_by_window())
    left, done = stored(windows), []
    for share in shares:
        at = F.when(F.lit(share == 1.0), F.col("lo")).otherwise(F.greatest("lo", F.col("hi") - F.floor((F.col("hi") - F.col("lo")) * share)))
        asked = left.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("w", at.alias("at"), "hi"))).alias("windows"))
        asked = asked.join(rows.where("anchor").select(F.col("row").alias("anchor"), "label", "v"), "anchor")
        asked = stored(asked.select(space.alias("space"), F.col("anchor").alias("row"), "label", "v", "windows"))
        counts = asked.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("qb"))
        spaces = sizes.join(counts, "space")
        q = _blocks(spaces, asked, "qb", "rb", "q", "r").groupBy("space", "q", "r")
        x = _blocks(spaces, all_rows, "rb", "qb", "r", "q").groupBy("space", "q", "r")

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            return best_of_block(a, b, order, k, same)

        found = q.cogroup(x).applyInArrow(search, FOUND)
        found = stored(found.withColumn("rank", rank).where(F.col("rank") <= k))
        if share == shares[-1]:
            done.append(found)
            break
        full = found.where(F.col("rank") == k).select("anchor", "w")
        done.append(found.join(full, ["anchor", "w"], "left_semi"))
        left = stored(left.join(full, ["anchor", "w"], "left_anti"))
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _by_window():
    from pyspark.sql import Window

    return Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    ``anchor`` says which rows are anchors, ``label`` gives their class.  Rows with a null label,
    a null vector or a null or non-finite component take no part; a null
    ``anchor`` is false.  An anchor's positives are the best other rows of its label, its
    negatives for a positive of score p the best rows of other labels with a
    score from ``least`` to ``most`` percent of p.  Higher scores come first, of
    equal scores smaller ids, null ids last; repeated rows count each.  Shorter
    vectors end in zeros; an empty table gives no rows; other columns are not
    read.  Vectors whose scores may pass 2^56 are refused.
    """
    rows = prepared(vectors, id_col, vector_col, label, anchor, scale)
    order = energy(rows)
    # no score passes the product of the norms
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    widest = rows.agg(F.max(norm).alias("widest"))
    bound = (F.ceil(norm * F.col("widest")) + 1).cast("long")
    whole = rows.where("anchor").crossJoin(F.broadcast(widest)).select(F.col("row").alias("anchor"), F.lit(0).alias("w"), (-bound).alias("lo"), bound.alias("hi"))
    near = stored(best_in_windows(rows, whole, order, positives, True, POSITIVE_SHARES))
    part = lambda percent: F.expr(f"({percent} * score - pmod({percent} * score, 100L)) div 100")  # noqa: E731  (floor)
    below = near.select("anchor", F.col("rank").alias("w"), (-part(-least)).alias("lo"), part(most).alias("hi")).where("lo <= hi")
    found = best_in_windows(rows, below, order, negatives, False, NEGATIVE_SHARES)
    pairs = near.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor", "w"])
    named = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return out.join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
