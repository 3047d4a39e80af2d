"""KPI projections K1-K7: row-level, guarded ratios, NumPy rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adperf.functions import guarded_ratio, npround


def kpi_columns() -> dict[str, Column]:
    c = F.col
    return {
        "ctr": npround(guarded_ratio("clicks", "impressions"), 6),
        "cpc": npround(guarded_ratio("spend", "clicks"), 4),
        "cpm": npround(
            F.when(c("impressions") > 0, (c("spend") / c("impressions")) * 1000).otherwise(0.0), 4
        ),
        "conversion_rate": npround(guarded_ratio("conversions", "clicks"), 6),
        "roas": npround(guarded_ratio("revenue", "spend"), 4),
        "roi": npround(
            F.when(c("spend") > 0, (c("revenue") - c("spend")) / c("spend")).otherwise(0.0), 4
        ),
        "revenue_per_conversion": npround(guarded_ratio("revenue", "conversions"), 2),
    }


def compute_kpis(df: DataFrame) -> DataFrame:
    """Add the seven KPI columns; row count unchanged."""
    return df.withColumns(kpi_columns())
