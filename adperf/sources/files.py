"""File sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, REQUIRED_COLUMNS


def _reader_error(path: str, err: AnalysisException) -> Exception:
    if "PATH_NOT_FOUND" in str(err) or "Path does not exist" in str(err):
        return FileNotFoundError(f"nothing to read at {path}")
    return err


def validate_columns(df: DataFrame) -> DataFrame:
    """Every required column must be present; extra columns are allowed."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    return df


def _nan_to_null(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v).alias(c)


def typed_raw(df: DataFrame) -> DataFrame:
    """Select the required columns by *name* and give them the raw types.

    Counts stay DOUBLE (CSV writes integers with holes as ``123.0``) and NaN
    becomes NULL, because in Spark ``NaN > 0`` is true.
    """
    validate_columns(df)
    date = F.col("date")
    date_expr = date if dict(df.dtypes)["date"] == "date" else F.to_date(date)
    return df.select(
        date_expr.alias("date"),
        *[F.col(c).cast("string").alias(c) for c in CATEGORICAL_COLUMNS],
        *[_nan_to_null(c) for c in NUMERIC_COLUMNS],
    )


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; columns are matched by name, not position."""
    try:
        df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    except AnalysisException as err:
        raise _reader_error(path, err) from None
    return typed_raw(df)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.parquet(path)
    except AnalysisException as err:
        raise _reader_error(path, err) from None
    return typed_raw(df)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by_month: bool = False) -> None:
    """Parquet sink; ``by_month`` partitions by month so date filters prune files."""
    if by_month:
        df = df.withColumn("month", F.date_format("date", "yyyy-MM"))
        df.write.mode(mode).partitionBy("month").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Union all by column name."""
    return df.unionByName(extra)


def split_key(df: DataFrame) -> Column:
    """Deterministic row key (only DATE/STRING/BIGINT parts, engine-neutral text)."""
    parts = [F.col("date").cast("string"), F.col("campaign"), F.col("channel"), F.col("device")]
    parts.append(F.col("clicks").cast("bigint").cast("string"))
    return F.md5(F.concat_ws("|", *parts))


def sample_exact(df: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by a stable hash.

    A top-k (``orderBy(...).limit(n)``): each partition keeps its best ``n``
    and only ``n x partitions`` rows reach the final merge.  Rows sharing a
    key are ordered by all columns so the choice is deterministic.
    """
    order = [split_key(df)] + [F.col(c) for c in df.columns]
    return df.orderBy(*order).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """S7 (Bernoulli form): ``df.sample`` without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
