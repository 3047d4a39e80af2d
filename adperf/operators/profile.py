"""Profiling P1-P6: shape, types, missing values, duplicates, describe.

Each report is one or two global aggregates (partial aggregation per task,
one small row at the end) turned into a long table — no ``collect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.functions import npround
from adperf.operators.quantile import quantile_values


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_columns)``."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
    )


def dtypes(df: DataFrame) -> DataFrame:
    """Column -> Spark type name (schema metadata, in column order)."""
    rows = [(i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, dtype string")


def missing(df: DataFrame) -> DataFrame:
    """P3 + P4: NULL count and percentage (2 dp) per column, one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"m{i}").cast("bigint").alias("missing"),
                        npround(F.try_divide(F.col(f"m{i}") * 100.0, F.col("_n")), 2).alias("missing_pct"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        ).alias("s")
    ).select("s.*")


def duplicates(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """P5: rows that repeat an earlier row (total minus distinct rows).
    ``distinct`` is the de-duplicated frame where it is at hand already."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    distinct = (df.dropDuplicates() if distinct is None else distinct).agg(F.count(F.lit(1)).alias("d"))
    return total.crossJoin(distinct).select((F.col("n") - F.col("d")).cast("bigint").alias("duplicates"))


# The statistics of a describe() table, in display order.
DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max per numeric
    column; the date column as days since epoch, without std.  Long form
    ``(column_name, count, mean, std, min, p25, p50, p75, max)``.

    Quartiles are exact (two-pass sketch-bracketed selection), not the
    approximate ones of ``df.summary()``.
    """
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int", "smallint", "tinyint")]
    dates = [c for c, t in df.dtypes if t == "date"]
    as_num = df.select(
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.unix_date(F.col(c)).cast("double").alias(c) for c in dates],
    )
    cols = numeric + dates
    moments = [
        f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for f, n in ((F.count, "c"), (F.avg, "a"), (F.stddev_samp, "s"), (F.min, "lo"), (F.max, "hi"))
    ]
    quartiles, row = quantile_values(as_num, cols, [0.25, 0.5, 0.75], extra=moments)
    # one row a column
    out = df.sparkSession.createDataFrame(
        [(c, row[f"c{i}"], row[f"a{i}"], None if c in dates else row[f"s{i}"], row[f"lo{i}"], row[f"hi{i}"], *[quartiles[c, p] for p in (0.25, 0.5, 0.75)])
         for i, c in enumerate(cols)],
        "column_name string, count long, mean double, std double, min double, max double, p25 double, p50 double, p75 double",
    )
    r = lambda c: npround(c, digits).alias(c)
    return out.select("column_name", "count", r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"), r("max"))
