"""Cleaning chain C1-C10: dedupe -> standardise -> impute -> cast -> validity.

The order matters and is kept: duplicates are removed *before* categories are
standardised (case variants survive as separate rows), and medians / modes
are global over the de-duplicated, standardised rows, *before* the validity
filters.  Everything stays one lazy plan: the fill values are a one-row
aggregate that is broadcast and cross-joined (no ``collect``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import title_case
from adperf.operators.quantile import approx_quantiles, exact_quantiles, modes
from adperf.schema import (
    AMOUNT_COLUMNS,
    CATEGORICAL_COLUMNS,
    COUNT_COLUMNS,
    NUMERIC_COLUMNS,
    REQUIRED_COLUMNS,
)


def dedupe(df: DataFrame) -> DataFrame:
    """Full-row de-duplication (NULLs compare equal).

    Planned as a hash aggregate with map-side partial aggregation, so heavily
    repeated rows collapse before the shuffle.
    """
    return df.dropDuplicates()


def standardize(df: DataFrame, cols: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Strip whitespace and title-case the categorical columns."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: title_case(c) for c in present})


def fill_values_long(df: DataFrame, approx: bool = False) -> DataFrame:
    """C3/C4 fill values as ``(col, value_double, value_text)`` rows."""
    nums = [c for c in NUMERIC_COLUMNS if c in df.columns]
    cats = [c for c in CATEGORICAL_COLUMNS if c in df.columns]
    q = approx_quantiles(df, nums) if approx else exact_quantiles(df, nums)
    m = modes(df, cats)
    return q.select("col", F.col("value").alias("value_double"), F.lit(None).cast("string").alias("value_text")).unionByName(
        m.select("col", F.lit(None).cast("double").alias("value_double"), F.col("value").alias("value_text"))
    )


def fills_row(fills_long: DataFrame, df_columns: list[str]) -> DataFrame:
    """Pivot the fill rows into one row ``fill_<col>`` (a handful of rows)."""
    nums = [c for c in NUMERIC_COLUMNS if c in df_columns]
    cats = [c for c in CATEGORICAL_COLUMNS if c in df_columns]
    pick = lambda c, v: F.max(F.when(F.col("col") == c, F.col(v))).alias(f"fill_{c}")
    return fills_long.agg(*[pick(c, "value_double") for c in nums], *[pick(c, "value_text") for c in cats])


def fill_values(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: ``fill_<col>`` = median (numeric) or mode (categorical)."""
    return fills_row(fill_values_long(df, approx=approx), df.columns)


def impute(df: DataFrame, fills: DataFrame) -> DataFrame:
    """Replace NULLs with the fill row (broadcast; exactly one row)."""
    joined = df.crossJoin(F.broadcast(fills))
    out = []
    for c in df.columns:
        if f"fill_{c}" in fills.columns:
            out.append(F.coalesce(F.col(c), F.col(f"fill_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def impute_values(df: DataFrame, fills: dict[str, float | str | None]) -> DataFrame:
    """C3/C4 with fill values that are known: literals, no join."""
    new = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items() if c in df.columns and v is not None}
    return df.withColumns(new)


def fix_types(df: DataFrame) -> DataFrame:
    """Counts to BIGINT (truncating, as a float->int cast does), amounts to
    DOUBLE, date to DATE."""
    casts = {c: F.col(c).cast("bigint") for c in COUNT_COLUMNS if c in df.columns}
    casts.update({c: F.col(c).cast("double") for c in AMOUNT_COLUMNS if c in df.columns})
    if "date" in df.columns:
        casts["date"] = F.col("date").cast("date")
    return df.withColumns(casts)


def validity_condition():
    """C6-C8 as one predicate (NULL counts as invalid, like NaN comparisons)."""
    return (
        (F.col("clicks") <= F.col("impressions"))
        & (F.col("spend") >= 0)
        & (F.col("impressions") >= 0)
        & (F.col("clicks") >= 0)
        & (F.col("bounce_rate") >= 0)
        & (F.col("bounce_rate") <= 1)
    )


def drop_invalid(df: DataFrame) -> DataFrame:
    """Clicks <= impressions; spend, impressions, clicks >= 0;
    0 <= bounce_rate <= 1.  Conversions, revenue and session length are not
    range-checked."""
    return df.filter(F.coalesce(validity_condition(), F.lit(False)))


def standardized(raw: DataFrame) -> DataFrame:
    """C1 -> C2: the frame the fill values are computed on."""
    return standardize(dedupe(raw.select(*REQUIRED_COLUMNS)))


def imputed(raw: DataFrame, approx: bool = False) -> DataFrame:
    """C1 -> C2 -> C3/C4 -> C5."""
    std = standardized(raw)
    return fix_types(impute(std, fill_values(std, approx=approx)))


def clean_data(raw: DataFrame, approx: bool = False) -> DataFrame:
    """The full chain C1 -> C2 -> C3/C4 -> C5 -> C6-C8."""
    return drop_invalid(imputed(raw, approx=approx))


def cleaning_report(
    raw: DataFrame,
    approx: bool = False,
    std: DataFrame | None = None,
    fills: DataFrame | None = None,
    clean: DataFrame | None = None,
) -> DataFrame:
    """``(step, column_name, n, fill_value, fill_text)``.

    Steps: ``input`` rows, ``duplicates`` removed, ``fill`` per column with
    its NULL count and fill value (only columns that had NULLs), ``invalid``
    rows removed, ``output`` rows.  Built from a few global aggregates.
    """
    raw = raw.select(*REQUIRED_COLUMNS)
    std = std if std is not None else standardized(raw)
    cols = NUMERIC_COLUMNS + CATEGORICAL_COLUMNS
    n_in = raw.agg(F.count(F.lit(1)).alias("n"))
    nulls = std.agg(
        F.count(F.lit(1)).alias("n_std"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
    )
    fills = fills if fills is not None else fill_values_long(std, approx=approx)
    if clean is None:
        clean = drop_invalid(fix_types(impute(std, fills_row(fills, std.columns))))
    n_out = clean.agg(F.count(F.lit(1)).alias("n_out"))

    stats = n_in.crossJoin(nulls).crossJoin(n_out)
    null_long = nulls.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"null_{c}").alias("n")) for c in cols])
        ).alias("s")
    ).select("s.*")
    fill_rows = (
        null_long.filter(F.col("n") > 0)
        .join(F.broadcast(fills), "col")
        .select(
            F.lit("fill").alias("step"),
            F.col("col").alias("column_name"),
            F.col("n").cast("bigint").alias("n"),
            F.col("value_double").alias("fill_value"),
            F.col("value_text").alias("fill_text"),
        )
    )

    def step(name: str, n):
        return stats.select(
            F.lit(name).alias("step"),
            F.lit(None).cast("string").alias("column_name"),
            n.cast("bigint").alias("n"),
            F.lit(None).cast("double").alias("fill_value"),
            F.lit(None).cast("string").alias("fill_text"),
        )

    return (
        step("input", F.col("n"))
        .unionByName(step("duplicates", F.col("n") - F.col("n_std")))
        .unionByName(fill_rows)
        .unionByName(step("invalid", F.col("n_std") - F.col("n_out")))
        .unionByName(step("output", F.col("n_out")))
    )
