"""Grouped summaries A1-A14.

Every grouped report over one key is a projection of a single
``key_rollup`` (one shuffle per key, partial aggregation map-side), so a
pipeline that needs campaign / channel / device tables computes each rollup
once.  Whole-table totals are one-row aggregates that are broadcast and
cross-joined — never a global window over the data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround, safe_ratio
from adperf.operators.rollup import MEANS, SUMS, Rollups, grouped, month_start, week_start  # noqa: F401


def _sum(c: str):
    # pandas sums skip NaN and give 0 for an all-NaN group; Spark gives NULL.
    return F.coalesce(F.sum(c), F.lit(0))


def key_rollup(df: DataFrame | Rollups, key: str) -> DataFrame:
    """All per-key sums / means / counts of the A* reports (unrounded)."""
    zero = lambda c: F.coalesce(f"sum_{c}", F.lit(0)).alias(f"total_{c}")
    rows = grouped(df, key).filter(F.col(key).isNotNull())
    return rows.select(key, *[zero(c) for c in SUMS], *[f"avg_{c}" for c in MEANS], F.col("n_impressions").alias("record_count"))


def summarize_by(df: DataFrame | Rollups, key: str) -> DataFrame:
    """A1: 5 sums, 6 means, record count per key; 4 dp; total_spend desc."""
    r = key_rollup(df, key)
    return r.select(
        F.col(key),
        F.col("total_impressions").cast("bigint").alias("total_impressions"),
        F.col("total_clicks").cast("bigint").alias("total_clicks"),
        npround("total_spend", 4).alias("total_spend"),
        F.col("total_conversions").cast("bigint").alias("total_conversions"),
        npround("total_revenue", 4).alias("total_revenue"),
        *[npround(c, 4).alias(c) for c in
          ["avg_ctr", "avg_cpc", "avg_conversion_rate", "avg_roas", "avg_roi", "avg_bounce_rate"]],
        F.col("record_count").cast("bigint").alias("record_count"),
    ).orderBy(F.desc("total_spend"), F.asc(key))


def overall_summary(df: DataFrame | Rollups) -> DataFrame:
    """A2 + A12: one row of 13 headline values; the distinct counts are those of the rollups' rows."""
    zero = lambda c, to: F.coalesce(f"sum_{c}", F.lit(0)).alias(to)
    t = grouped(df).select(
        F.col("n_rows").alias("total_records"), F.col("first_date").alias("dmin"), F.col("last_date").alias("dmax"),
        *[zero(c, to) for c, to in (("impressions", "imp"), ("clicks", "clk"), ("spend", "spd"), ("conversions", "conv"), ("revenue", "rev"))],
    )
    for key in ("campaign", "channel"):
        t = t.crossJoin(F.broadcast(grouped(df, key).agg(F.count(key).alias(f"unique_{key}s"))))
    return t.select(
        F.col("total_records").cast("bigint").alias("total_records"),
        F.concat_ws(" to ", F.col("dmin").cast("string"), F.col("dmax").cast("string")).alias("date_range"),
        F.col("imp").cast("bigint").alias("total_impressions"),
        F.col("clk").cast("bigint").alias("total_clicks"),
        npround("spd", 2).alias("total_spend"),
        F.col("conv").cast("bigint").alias("total_conversions"),
        npround("rev", 2).alias("total_revenue"),
        npround(safe_ratio("clk", "imp"), 6).alias("overall_ctr"),
        npround(safe_ratio("spd", "clk"), 4).alias("overall_cpc"),
        npround(safe_ratio("rev", "spd"), 4).alias("overall_roas"),
        npround(safe_ratio(F.col("rev") - F.col("spd"), "spd"), 4).alias("overall_roi"),
        F.col("unique_campaigns").cast("bigint").alias("unique_campaigns"),
        F.col("unique_channels").cast("bigint").alias("unique_channels"),
    )


def campaign_spend_revenue(df: DataFrame | Rollups) -> DataFrame:
    """A3: spend and revenue per campaign, revenue ascending."""
    r = key_rollup(df, "campaign")
    return r.select(
        "campaign",
        npround("total_spend", 4).alias("total_spend"),
        npround("total_revenue", 4).alias("total_revenue"),
    ).orderBy("total_revenue", "campaign")


def channel_share(df: DataFrame | Rollups) -> DataFrame:
    """A4: spend and revenue per channel with their share of the total (%).

    The totals are a one-row global aggregate (broadcast cross join)."""
    g = grouped(df, "channel")
    # the totals of all groups, the one without a channel included
    totals = g.agg(_sum("sum_spend").alias("all_spend"), _sum("sum_revenue").alias("all_revenue"))
    r = g.where("channel IS NOT NULL").select("channel", *[F.coalesce(f"sum_{c}", F.lit(0)).alias(f"total_{c}") for c in ("spend", "revenue")])
    return (
        r.crossJoin(F.broadcast(totals))
        .select(
            "channel",
            npround("total_spend", 4).alias("total_spend"),
            npround(safe_ratio(F.col("total_spend") * 100, "all_spend"), 4).alias("spend_share_pct"),
            npround("total_revenue", 4).alias("total_revenue"),
            npround(safe_ratio(F.col("total_revenue") * 100, "all_revenue"), 4).alias("revenue_share_pct"),
        )
        .orderBy(F.desc("total_spend"), "channel")
    )


def device_means(df: DataFrame | Rollups) -> DataFrame:
    """A5: mean ctr, conversion rate and ROAS per device."""
    return grouped(df, "device").select("device", *[npround(c, 6).alias(c) for c in ("avg_ctr", "avg_conversion_rate", "avg_roas")]).orderBy("device")


def roi_by_key(df: DataFrame | Rollups, keys: tuple[str, ...] = ("campaign", "channel")) -> DataFrame:
    """Mean ROI per campaign and per channel, ascending, with a sign flag."""
    parts = [
        grouped(df, k).select(
            F.lit(k).alias("dimension"), F.col(k).alias("key"), npround("avg_roi", 6).alias("avg_roi"), (F.col("avg_roi") >= 0).cast("bigint").alias("is_non_negative")
        )
        for k in keys
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("dimension", "avg_roi", "key")


def weekly_ctr(df: DataFrame | Rollups) -> DataFrame:
    """Weekly mean CTR per channel, in percent."""
    return grouped(df, "channel", "week").select("channel", "week", npround(F.col("avg_ctr") * 100, 10).alias("ctr_pct")).orderBy("channel", "week")


def monthly_trend(df: DataFrame | Rollups) -> DataFrame:
    """Monthly spend, revenue and conversions."""
    zero = lambda c: F.coalesce(f"sum_{c}", F.lit(0))
    return grouped(df, "month").select(
        "month", npround(zero("spend"), 4).alias("total_spend"), npround(zero("revenue"), 4).alias("total_revenue"),
        zero("conversions").cast("bigint").alias("total_conversions"),
    ).orderBy("month")


# The columns of the correlation matrix, in display order.
CORRELATION_COLUMNS = [
    "impressions", "clicks", "spend", "conversions",
    "revenue", "bounce_rate", "ctr", "cpc", "roas", "roi",
]


def correlation(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix, lower triangle with diagonal, long form
    ``(col_a, col_b, corr)``; absent columns skipped; NULL for a constant column.

    Each pair uses the rows where both columns are present.  One pass: a task keeps counts,
    means and co-moments of all pairs in arrays of columns x columns, batch by batch, and tasks
    are merged in groups by the rule of Chan, which is stable whatever the columns' size.
    """
    cols = [c for c in (cols or CORRELATION_COLUMNS) if c in df.columns]
    k = len(cols)
    groups = max(1, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))

    def merged(a, b):
        """n, mean, squares of the row's column, and products, of each (row, column) pair present together."""
        import numpy as np

        n = a[0] + b[0]
        part = a[0] * b[0] / np.maximum(n, 1)
        d = b[1] - a[1]
        return np.stack([n, a[1] + d * (b[0] / np.maximum(n, 1)), a[2] + b[2] + d * d * part, a[3] + b[3] + d * d.T * part])

    def partial(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, k))
            has = ~np.isnan(x)
            centre = np.where(has, x, 0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)
            z, there = np.where(has, x - centre, 0), has.astype(float)
            n = there.T @ there
            off = z.T @ there / np.maximum(n, 1)
            total = merged(total, np.stack([n, np.where(n > 0, centre[:, None] + off, 0), (z * z).T @ there - n * off * off, z.T @ z - n * off * off.T]))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"grp": pa.array([task % groups], pa.int32()), "task": pa.array([task], pa.int32()), "v": [total.tobytes()]})

    def merge(table):
        import numpy as np
        import pyarrow as pa

        raw = table.column("v").to_pylist()
        total = np.zeros((4, k, k))
        for at in np.argsort(table.column("task").to_numpy()):
            total = merged(total, np.frombuffer(raw[at]).reshape(4, k, k))
        return pa.table({"grp": table.column("grp").slice(0, 1), "v": [total.tobytes()]})

    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    parts = x.mapInArrow(partial, "grp int, task int, v binary").groupBy("grp").applyInArrow(merge, "grp int, v binary").collect()
    total = np.zeros((4, k, k))
    for r in sorted(parts, key=lambda r: r.grp):
        total = merged(total, np.frombuffer(r.v).reshape(4, k, k))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[: i + 1]):
            spread = math.sqrt(max(total[2, i, j], 0.0)) * math.sqrt(max(total[2, j, i], 0.0))
            rows.append((a, b, float(total[3, i, j]) / spread if spread > 0 else None))  # NULL for a constant column
    made = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")
    return made.select("col_a", "col_b", npround("corr", 6).alias("corr"))


def spend_revenue_points(df: DataFrame) -> DataFrame:
    """A10: per-row spend / revenue points by campaign and the break-even bound
    ``max(max spend, max revenue)``; flag rows above break-even."""
    bound = df.agg(F.greatest(F.max("spend"), F.max("revenue")).alias("break_even_max"))
    return df.select("campaign", "spend", "revenue").crossJoin(F.broadcast(bound)).select(
        "campaign",
        "spend",
        "revenue",
        (F.col("revenue") > F.col("spend")).cast("bigint").alias("above_break_even"),
        "break_even_max",
    )


def distinct_values(df: DataFrame, cols: tuple[str, ...] = ("campaign", "channel", "device")) -> DataFrame:
    """Distinct values of each category, long form ``(dimension, value)``."""
    out = None
    for c in cols:
        part = df.select(F.lit(c).alias("dimension"), F.col(c).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("dimension", "value")


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Value counts of a label, most frequent first."""
    return (
        df.groupBy(F.col(target).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def target_range(df: DataFrame, target: str = "target") -> DataFrame:
    """Min / max / mean of a continuous target."""
    return df.agg(
        npround(F.min(target), 4).alias("target_min"),
        npround(F.max(target), 4).alias("target_max"),
        npround(F.avg(target), 4).alias("target_mean"),
    )
