"""Exact global quantiles and modes that never funnel all values into one task.

Spark's exact ``percentile`` / ``mode`` aggregates keep a value -> count map
per group and merge all of them in a single final task, so a global median
over a large table materialises every distinct value in one place.  Here:

* **quantile** — one scan builds a bounded ``percentile_approx`` sketch and the row count of
  every column.  Two of its values bracket the target ranks; ``m`` is the smallest
  step of a fixed ladder that leaves ``SLACK`` ranks on either side beyond the sketch's own error.  Strictly
  inside a bracket lie about ``12 / accuracy`` of the rows.  Where that may be more than ``MOST``
  values, another scan sketches the inside of the bracket alone, and so on: each scan narrows it by
  that factor, so the steps grow with the logarithm of the table.  At last one scan counts the rows
  below the brackets and one groups the few values in them.
* **mode** — ``groupBy(column, value).count()`` with map-side partial
  aggregation (hot values collapse before the shuffle), then a ``min_by`` per
  column over ``(-count, value)``: the most frequent value, smallest on ties.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from adperf.session import materialize

# Sketch accuracy: its rank error is at most rows / accuracy.  A finer sketch costs more per value, and one task
# merges those of all tasks; a coarser one leaves wider brackets, which another scan narrows.
DEFAULT_ACCURACY = 5_000
# Ranks left between a target rank and its bracket's ends, beyond the sketch's error.
SLACK = 4
# Values strictly inside a bracket that are brought together.
MOST = 20_000
# Rows ranked together by ``running_before``.
PIECE_ROWS = 200_000


def _long_values(df: DataFrame, cols: list[str], dtype: str) -> DataFrame:
    """Unpivot ``cols`` to ``(col, v)`` rows, dropping NULLs."""
    casted = df.select(*[F.col(c).cast(dtype).alias(c) for c in cols])
    return casted.unpivot(
        ids=[], values=cols, variableColumnName="col", valueColumnName="v"
    ).filter(F.col("v").isNotNull())


def exact_quantiles(
    df: DataFrame, cols: list[str], p: float = 0.5, accuracy: int = DEFAULT_ACCURACY
) -> DataFrame:
    """Long frame ``(col STRING, value DOUBLE)``: the exact ``p``-quantile of each
    column (linear interpolation; NULL for an all-NULL column)."""
    return exact_quantiles_multi(df, cols, [p], accuracy).select("col", "value")


def running_before(d: DataFrame, keys: list[str], value: str, sums: dict[str, str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds, for each ``name: column`` of ``sums``, the sum of ``column`` over the
    rows of the same ``keys`` with a smaller ``value`` (0 for the smallest).

    ``d`` has one row per (keys, value).  It is stored in range partitions of about ``piece_rows``
    rows, so no task ranks more whatever the size or the distribution; the totals of the
    partitions before are added.  That table has a row per (partition, key).
    """
    d = materialize(d)
    pieces = max(1, -(-d.count() // piece_rows))
    d = materialize(d.repartitionByRange(pieces, *keys, value).withColumn("_piece", F.spark_partition_id()))
    totals = d.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    over = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_piece", *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()})
    d = d.join(totals, [*keys, "_piece"])
    return d.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop("_piece", *[f"_b_{n}" for n in sums])


@dataclass
class _Target:
    """One quantile: its ranks, and the bracket that holds them once it is known."""

    i: int
    low: int
    high: int
    position: float
    share: float | None   # before any bracket: the quantile's own
    below: int = 0        # values up to the bracket's lower end
    inside: int = 0       # values strictly inside
    ends: tuple[float, float] | None = None
    found: dict[int, float] | None = None

    def wanted(self) -> list[int]:
        return [k for k in (self.low, self.high) if k not in self.found]

    def narrow(self, sketch: list[float], cuts: list[float], ladder: list[float], accuracy: int) -> float:
        """Take new ends from a sketch of the values inside; how many may lie strictly between them."""
        step = next((m for m in ladder if self.inside * (m - 1 / accuracy) >= SLACK), None)
        wanted = [(k - self.below) / max(1, self.inside - 1) for k in self.wanted()] if self.share is None else [self.share]
        self.share = None

        def at(share: float, down: bool) -> float:
            if step is None or not 0 < share < 1:
                share = 0.0 if down else 1.0
            place = max(k for k, c in enumerate(cuts) if c <= share) if down else min(k for k, c in enumerate(cuts) if c >= share)
            return sketch[place]

        m = step or 1.0
        self.ends = (at(min(wanted) - m, True), at(max(wanted) + m, False))
        return self.inside * min(1.0, max(wanted) - min(wanted) + 4 * m + 2 / accuracy)


def quantile_values(
    df: DataFrame, cols: list[str], ps: list[float], accuracy: int = DEFAULT_ACCURACY, extra: list[Column] | None = None, most: int = MOST,
) -> tuple[dict[tuple[str, float], float | None], Row]:
    """Exact quantiles by (column, p), None for a column without values, and the row of ``extra`` aggregates.

    NULL and NaN are no values.  The aggregates are part of the first scan.
    """
    nums = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)], *([F.col(c) for c in df.columns] if extra else []))
    ladder, m = [], 5.0 / accuracy
    while m < 1.0:
        ladder.append(m)
        m *= 4
    clip = lambda x: min(1.0, max(0.0, x))
    cuts = sorted({0.0, 1.0, *(clip(x) for p in ps for m in ladder for x in (p - m, p + m))})
    first = nums.agg(
        *[F.percentile_approx(f"v{i}", cuts, accuracy).alias(f"_b{i}") for i in range(len(cols))],
        *[F.count(f"v{i}").alias(f"_n{i}") for i in range(len(cols))], *(extra or []),
    ).collect()[0]
    nums = nums.select(*[f"v{i}" for i in range(len(cols))])
    targets: dict[tuple[str, float], _Target] = {}
    for i, c in enumerate(cols):
        for p in ps:
            n = first[f"_n{i}"]
            if n:
                pos = (n - 1) * float(p)
                targets[c, p] = _Target(i, math.floor(pos), math.ceil(pos), pos, float(p), inside=n, found={})
    todo = list(targets.values())
    wide = [t for t in todo if t.narrow(list(first[f"_b{t.i}"]), cuts, ladder, accuracy) > most]
    while wide:
        # inside a bracket: its rows, those up to its lower end, and a sketch around the ranks
        shares = sorted({0.0, 1.0, *(x / 256 for x in range(257))})
        v = {k: (F.col(f"v{t.i}"), *map(F.lit, t.ends)) for k, t in enumerate(wide)}
        row = nums.agg(*[f for k, (x, lo, hi) in v.items() for f in (
            F.count_if(x < lo).alias(f"l{k}"), F.count_if(x <= lo).alias(f"e{k}"), F.count_if(x <= hi).alias(f"h{k}"), F.count_if((x > lo) & (x < hi)).alias(f"n{k}"),
            F.percentile_approx(F.when((x > lo) & (x < hi), x), shares, accuracy).alias(f"b{k}"))]).collect()[0]
        still = []
        for k, t in enumerate(wide):
            lo, hi = t.ends
            for r in t.wanted():
                if not row[f"l{k}"] <= r < row[f"h{k}"]:
                    raise RuntimeError("a quantile's rank lies outside its bracket")
                if r < row[f"e{k}"]:
                    t.found[r] = lo
                elif r >= row[f"e{k}"] + row[f"n{k}"]:
                    t.found[r] = hi
            t.below, t.inside = row[f"e{k}"], row[f"n{k}"]
            if t.wanted():
                fine = [1.0 / 256 * 4**x for x in range(4)]
                if t.narrow(list(row[f"b{k}"]), shares, fine, accuracy) > most:
                    still.append(t)
        wide = still
    todo = [t for t in todo if t.wanted()]
    if todo:
        ends = [(F.col(f"v{t.i}"), *map(F.lit, t.ends)) for t in todo]
        below = nums.agg(*[F.count_if(x < lo).alias(f"b{k}") for k, (x, lo, _) in enumerate(ends)]).collect()[0]
        inside = [F.coalesce(x.between(lo, hi), F.lit(False)) for x, lo, hi in ends]
        some = inside[0]
        for x in inside[1:]:
            some = some | x
        hits = F.array(*[F.when(h, F.struct(F.lit(k).alias("k"), x.alias("v"))) for k, (h, (x, _, _)) in enumerate(zip(inside, ends, strict=True))])
        counted = nums.where(some).select(F.inline(F.array_compact(hits))).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list] = {}
        for r in counted:
            by.setdefault(r.k, []).append((r.v, r.n))
        for k, t in enumerate(todo):
            upto = below[f"b{k}"]
            for value, n in sorted(by.get(k, [])):
                for r in t.wanted():
                    if upto <= r < upto + n:
                        t.found[r] = value
                upto += n
            if t.wanted():
                raise RuntimeError("a quantile's rank lies outside its bracket")
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in cols for p in ps}
    for key, t in targets.items():
        lo, hi = t.found[t.low], t.found[t.high]
        out[key] = lo if t.low == t.high else (t.high - t.position) * lo + (t.position - t.low) * hi
    return out, first


def exact_quantiles_multi(
    df: DataFrame, cols: list[str], ps: list[float], accuracy: int = DEFAULT_ACCURACY
) -> DataFrame:
    """Long frame ``(col, p, value)`` for every column and probability."""
    values, _ = quantile_values(df, cols, ps, accuracy)
    return df.sparkSession.createDataFrame([(c, float(p), v) for (c, p), v in values.items()], "col string, p double, value double")


def approx_quantiles(
    df: DataFrame, cols: list[str], p: float = 0.5, accuracy: int = 10_000
) -> DataFrame:
    """Same shape as :func:`exact_quantiles`, one sketch pass only."""
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(f"q_{i}")
          for i, c in enumerate(cols)]
    )
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"q_{i}").cast("double").alias("value"))
                      for i, c in enumerate(cols)])
        ).alias("s")
    ).select("s.*")


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long frame ``(col STRING, value STRING)``: most frequent non-NULL value,
    smallest value on ties; NULL when the column has no value."""
    counts = _long_values(df, cols, "string").groupBy("col", "v").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    best = counts.groupBy("col").agg(
        F.min_by("v", F.struct((-F.col("cnt")).alias("neg"), F.col("v").alias("v"))).alias("value")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "col string")
    return names.join(best, "col", "left")


def long_to_row(long_df: DataFrame, cols: list[str], prefix: str = "") -> DataFrame:
    """Pivot a small ``(col, value)`` frame into one row ``prefix + col``."""
    return long_df.agg(
        *[F.max(F.when(F.col("col") == c, F.col("value"))).alias(prefix + c) for c in cols]
    )
