"""One grouping-sets pass for all grouped reports A1-A8, I1-I14.

``rollups`` scans the KPI table once and stores a row per campaign, channel, device, weekday,
channel and week, month, and one for the whole table, each with the same sums, means and counts.
Every grouped report takes a table or these rollups: ``grouped`` gives it the rows of its key, either
from the stored ones or by an aggregate of its own, of which Spark computes only the columns in use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf.session import materialize

SUMS = ["impressions", "clicks", "spend", "conversions", "revenue"]
MEANS = ["ctr", "cpc", "conversion_rate", "roas", "roi", "bounce_rate"]
#: Names of the weekdays from Monday on.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def week_start(c: str = "date") -> Column:
    """Monday of the week (Spark's ``date_trunc('week')`` starts on Monday)."""
    return F.date_trunc("week", F.col(c)).cast("date")


def month_start(c: str = "date") -> Column:
    return F.date_trunc("month", F.col(c)).cast("date")


def _keys(df: DataFrame) -> dict[str, Column]:
    keys = {c: F.col(c) for c in ("campaign", "channel", "device")}
    if "date" in df.columns:
        keys |= {"weekday_index": F.weekday("date"), "week": week_start(), "month": month_start()}
    return keys


def _measures(df: DataFrame) -> list[Column]:
    out = [F.sum(c).alias(f"sum_{c}") for c in SUMS] + [F.avg(c).alias(f"avg_{c}") for c in MEANS if c in df.columns]
    out += [F.count(F.lit(1)).alias("n_rows"), F.count("spend").alias("n_spend"), F.count("impressions").alias("n_impressions")]
    return out + ([F.min("date").alias("first_date"), F.max("date").alias("last_date")] if "date" in df.columns else [])


def _sets(df: DataFrame) -> list[tuple[str, ...]]:
    dated = [("weekday_index",), ("channel", "week"), ("month",)] if "date" in df.columns else []
    return [("campaign",), ("channel",), ("device",), *dated, ()]


@dataclass
class Rollups:
    """Stored rollups; ``ids`` has the grouping id of each set of keys."""

    table: DataFrame
    ids: dict[tuple[str, ...], int]

    def by(self, *keys: str) -> DataFrame:
        rows = self.table.where(F.col("grouping") == self.ids[keys])
        other = {c for s in self.ids for c in s} - set(keys)
        return rows.drop("grouping", *other)


def rollups(df: DataFrame) -> Rollups:
    """All rollups of a KPI table, from one scan of it."""
    keys = _keys(df)
    measured = {c for c in [*SUMS, *MEANS, "date"] if c in df.columns}
    rows = df.select(*[k.alias(n) for n, k in keys.items()], *measured)
    sets = _sets(df)
    grouped_sets = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    table = materialize(grouped_sets.agg(F.grouping_id().alias("grouping"), *_measures(df)))
    # bit of a key, the last one lowest, is 1 where it is not grouped by
    names = list(keys)
    ids = {s: sum(1 << (len(names) - 1 - k) for k, n in enumerate(names) if n not in s) for s in sets}
    return Rollups(table, ids)


def grouped(source: DataFrame | Rollups, *keys: str) -> DataFrame:
    """The rows of a rollup by ``keys`` (none: one row for the whole table)."""
    if isinstance(source, Rollups):
        return source.by(*keys)
    of = _keys(source) if keys else {}
    return source.groupBy(*[of[k].alias(k) for k in keys]).agg(*_measures(source))
