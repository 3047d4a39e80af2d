"""The row-level operators on a streaming source.

The reference is batch only.  Its row-level steps — standardise (C2),
impute with *fixed* fill values (C3/C4), cast (C5), validity filters
(C6-C8) and the KPI projections (K1-K7) — are stateless, so the same
functions apply unchanged to a ``readStream`` DataFrame.  The fill values
come from a batch table (a one-row stream-static cross join).  Global steps
(de-duplication, medians) are not streaming-safe and stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adperf.operators import clean as C
from adperf.operators.kpi import compute_kpis
from adperf.schema import RAW_SCHEMA, REQUIRED_COLUMNS


def read_raw_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stream of raw fact files (schema fixed up front, as streaming needs)."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def kpi_stream(stream: DataFrame, fills: DataFrame) -> DataFrame:
    """Standardise -> impute (fixed fills) -> cast -> validity -> KPIs."""
    std = C.standardize(stream.select(*REQUIRED_COLUMNS))
    return compute_kpis(C.drop_invalid(C.fix_types(C.impute(std, fills))))


def write_stream(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append the cleaned rows as parquet; the checkpoint location makes the
    query restartable after failures (exactly-once file sink)."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.outputMode("append").start()
