"""Business insights I1-I14.

Per-key statistics come from the rollups of ``rollup.py``.  Anything that
needs a value across groups (a maximum, a total, a best row) is a one-row
aggregate over the grouped frame (broadcast cross join) or a top-1
(``orderBy().limit(1)``, each task keeps one row) — never a global window.
Ties are broken explicitly: best by value then name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround, safe_ratio
from adperf.operators.rollup import DAYS, SUMS, Rollups, grouped, rollups


def _totals(df: DataFrame | Rollups, key: str) -> DataFrame:
    """The rollup by ``key`` under the names of these reports."""
    return grouped(df, key).withColumnsRenamed({f"sum_{c}": f"total_{c}" for c in SUMS} | {"n_spend": "count"})


def _day():
    return F.get(F.array(*map(F.lit, DAYS)), F.col("weekday_index"))


def _top1(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order).limit(1)


# ------------------------------------------------------------------ channels
def channel_stats(df: DataFrame | Rollups) -> DataFrame:
    """Channel sums / means, actual ROAS, profit, efficiency band,
    sorted by mean ROAS descending."""
    g = _totals(df, "channel")
    roas_actual = npround(safe_ratio("total_revenue", "total_spend"), 4)
    profit = npround(F.col("total_revenue") - F.col("total_spend"), 2)
    return (
        g.withColumn("roas_actual", roas_actual)
        .withColumn("profit", profit)
        .select(
            "channel",
            npround("total_spend", 4).alias("total_spend"),
            npround("total_revenue", 4).alias("total_revenue"),
            F.col("total_clicks").cast("bigint").alias("total_clicks"),
            F.col("total_conversions").cast("bigint").alias("total_conversions"),
            npround("avg_ctr", 6).alias("avg_ctr"),
            npround("avg_cpc", 6).alias("avg_cpc"),
            F.col("avg_roas"),
            F.col("count").cast("bigint").alias("count"),
            "roas_actual",
            "profit",
            F.when(F.col("roas_actual") >= 1.5, "good")
            .when(F.col("roas_actual") >= 1.0, "warn")
            .otherwise("bad")
            .alias("efficiency_band"),
            (F.col("profit") > 0).cast("bigint").alias("is_profitable"),
        )
    )


def channel_efficiency(df: DataFrame | Rollups) -> DataFrame:
    """I1-I3 report (mean ROAS rounded for display)."""
    s = channel_stats(df)
    return s.withColumn("avg_roas", npround("avg_roas", 6)).orderBy(F.desc("avg_roas"), "channel")


def channel_extremes(df: DataFrame | Rollups) -> DataFrame:
    """I4: best / worst channel by *mean* ROAS, reporting their *actual* ROAS
    (2 dp)."""
    s = channel_stats(df)
    best = _top1(s, F.desc("avg_roas"), F.asc("channel")).select(
        F.col("channel").alias("best_channel"), npround("roas_actual", 2).alias("best_roas")
    )
    worst = _top1(s, F.asc("avg_roas"), F.desc("channel")).select(
        F.col("channel").alias("worst_channel"), npround("roas_actual", 2).alias("worst_roas")
    )
    return best.crossJoin(worst)


# ----------------------------------------------------------------- campaigns
def campaign_scores(df: DataFrame | Rollups) -> DataFrame:
    """Per-campaign means normalised by their maximum over campaigns,
    efficiency score = 0.2 ctr + 0.3 conversion + 0.5 roas (4 dp), best
    first.  A non-positive maximum gives a normalised value of 0."""
    g = _totals(df, "campaign")
    means = ["avg_ctr", "avg_conversion_rate", "avg_roas"]
    mx = g.agg(*[F.max(c).alias(f"max_{c}") for c in means])
    j = g.crossJoin(F.broadcast(mx))
    norm = {
        f"{c}_norm": F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(F.lit(0.0))
        for c in means
    }
    j = j.withColumns(norm)
    score = npround(
        F.col("avg_ctr_norm") * 0.2 + F.col("avg_conversion_rate_norm") * 0.3 + F.col("avg_roas_norm") * 0.5, 4
    )
    return j.select(
        "campaign",
        npround("total_spend", 4).alias("total_spend"),
        npround("total_revenue", 4).alias("total_revenue"),
        F.col("total_conversions").cast("bigint").alias("total_conversions"),
        *[npround(c, 6).alias(c) for c in means],
        *[npround(f"{c}_norm", 6).alias(f"{c}_norm") for c in means],
        score.alias("efficiency_score"),
    ).orderBy(F.desc("efficiency_score"), "campaign")


def campaign_profit(df: DataFrame | Rollups) -> DataFrame:
    """Profit per campaign and the top campaign (highest efficiency score)."""
    s = campaign_scores(df)
    top = _top1(s, F.desc("efficiency_score"), F.asc("campaign")).select(F.col("campaign").alias("top"))
    return (
        s.crossJoin(F.broadcast(top))
        .select(
            "campaign",
            "total_spend",
            "total_revenue",
            npround(F.col("total_revenue") - F.col("total_spend"), 2).alias("profit"),
            (F.col("campaign") == F.col("top")).cast("bigint").alias("is_top"),
        )
        .orderBy(F.desc("profit"), "campaign")
    )


# -------------------------------------------------------------------- budget
def budget_allocation(df: DataFrame | Rollups) -> DataFrame:
    """ROAS-weighted budget reallocation per channel.

    Rounding happens in sequence on already-rounded values, as in the
    reference: roas (4 dp) -> current / recommended (1 dp) -> shift (1 dp) ->
    amount (0 dp)."""
    g = _totals(df, "channel").select("channel", "total_spend", "total_revenue")
    g = g.withColumn("roas", npround(safe_ratio("total_revenue", "total_spend"), 4))
    tot = g.agg(
        F.sum("total_spend").alias("total_budget"),
        F.sum(F.greatest(F.col("roas"), F.lit(0.0))).alias("roas_pos_sum"),
    )
    j = g.crossJoin(F.broadcast(tot))
    j = j.withColumns(
        {
            "current_pct": npround(safe_ratio(F.col("total_spend"), "total_budget") * 100, 1),
            "recommended_pct": npround(
                safe_ratio(F.greatest(F.col("roas"), F.lit(0.0)), "roas_pos_sum") * 100, 1
            ),
        }
    )
    j = j.withColumn("shift_pct", npround(F.col("recommended_pct") - F.col("current_pct"), 1))
    j = j.withColumn("shift_amount", npround(F.col("shift_pct") / 100 * F.col("total_budget"), 0))
    return j.select(
        "channel",
        npround("total_spend", 4).alias("total_spend"),
        npround("total_revenue", 4).alias("total_revenue"),
        "roas",
        npround(F.col("total_revenue") - F.col("total_spend"), 4).alias("profit"),
        "current_pct",
        "recommended_pct",
        "shift_pct",
        "shift_amount",
        F.when(F.col("shift_pct") > 0, "INCREASE")
        .when(F.col("shift_pct") < 0, "DECREASE")
        .otherwise("KEEP")
        .alias("direction"),
        npround("total_budget", 4).alias("total_budget"),
    ).orderBy(F.desc("roas"), "channel")


# ------------------------------------------------------------------- devices
def device_stats(df: DataFrame | Rollups) -> DataFrame:
    """Device sums, means, count and actual ROAS; mean ROAS descending."""
    g = _totals(df, "device")
    return g.select(
        "device",
        npround("total_spend", 4).alias("total_spend"),
        npround("total_revenue", 4).alias("total_revenue"),
        npround("avg_ctr", 6).alias("avg_ctr"),
        npround("avg_conversion_rate", 6).alias("avg_conversion_rate"),
        npround("avg_roas", 6).alias("avg_roas"),
        npround("avg_bounce_rate", 6).alias("avg_bounce"),
        F.col("count").cast("bigint").alias("count"),
        npround(safe_ratio("total_revenue", "total_spend"), 4).alias("roas_actual"),
    ).orderBy(F.desc("avg_roas"), "device")


def best_device(df: DataFrame | Rollups) -> DataFrame:
    """Device with the highest mean ROAS."""
    return _top1(_totals(df, "device"), F.desc("avg_roas"), F.asc("device")).select(
        F.col("device").alias("best_device"),
        npround(safe_ratio("total_revenue", "total_spend"), 4).alias("roas_actual"),
    )


# ---------------------------------------------------------------------- time
def weekday_stats(df: DataFrame | Rollups) -> DataFrame:
    """Mean ROAS, mean CTR and conversions per weekday, Monday first;
    absent days are simply missing."""
    if isinstance(df, DataFrame) and "date" not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "weekday string, weekday_index bigint, avg_roas double, avg_ctr double, total_conversions bigint"
        )
    g = _totals(df, "weekday_index")
    return g.select(
        _day().alias("weekday"),
        F.col("weekday_index").cast("bigint").alias("weekday_index"),
        npround("avg_roas", 6).alias("avg_roas"),
        npround("avg_ctr", 6).alias("avg_ctr"),
        F.col("total_conversions").cast("bigint").alias("total_conversions"),
    ).orderBy("weekday_index")


def best_weekday(df: DataFrame | Rollups) -> DataFrame:
    """Weekday with the highest mean ROAS (earlier weekday on ties)."""
    return _top1(_totals(df, "weekday_index"), F.desc("avg_roas"), F.asc("weekday_index")).select(
        _day().alias("best_day"), npround("avg_roas", 6).alias("avg_roas")
    )


# ----------------------------------------------------------------- summary
def executive_summary(df: DataFrame | Rollups) -> DataFrame:
    """One row — totals, net profit, overall ROI, best / worst channel,
    top campaign, largest increase / decrease channel, best weekday.

    A table is scanned once, for the rollups that all parts read."""
    if isinstance(df, DataFrame):
        df = rollups(df)
    totals = grouped(df).select(F.col("sum_spend").alias("s"), F.col("sum_revenue").alias("r")).select(
        npround("s", 2).alias("total_spend"),
        npround("r", 2).alias("total_revenue"),
        npround(F.col("r") - F.col("s"), 2).alias("net_profit"),
        npround(safe_ratio(F.col("r") - F.col("s"), "s"), 6).alias("overall_roi"),
    )
    ext = channel_extremes(df)
    top = _top1(campaign_scores(df), F.desc("efficiency_score"), F.asc("campaign")).select(
        F.col("campaign").alias("top_campaign")
    )
    b = budget_allocation(df)
    inc = _top1(b, F.desc("shift_pct"), F.desc("roas"), F.asc("channel")).select(
        F.col("channel").alias("increase_channel"), F.col("shift_pct").alias("increase_pct")
    )
    dec = _top1(b, F.asc("shift_pct"), F.desc("roas"), F.asc("channel")).select(
        F.col("channel").alias("decrease_channel"), F.col("shift_pct").alias("decrease_pct")
    )
    day = best_weekday(df).select("best_day")
    return totals.crossJoin(ext).crossJoin(top).crossJoin(inc).crossJoin(dec).crossJoin(day)
