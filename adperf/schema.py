"""Schemas and column groups of the advertising fact table."""

from __future__ import annotations

from pyspark.sql import types as T

# The required input columns, in the order of the fact table.
REQUIRED_COLUMNS = [
    "date", "campaign", "channel", "device",
    "impressions", "clicks", "spend",
    "conversions", "revenue", "bounce_rate", "avg_session_duration",
]

CATEGORICAL_COLUMNS = ["campaign", "channel", "device"]
# Numeric columns imputed with the median, in reference order.
NUMERIC_COLUMNS = [
    "impressions", "clicks", "spend", "conversions",
    "revenue", "bounce_rate", "avg_session_duration",
]
COUNT_COLUMNS = ["impressions", "clicks", "conversions"]
AMOUNT_COLUMNS = ["spend", "revenue", "bounce_rate", "avg_session_duration"]

KPI_COLUMNS = ["ctr", "cpc", "cpm", "conversion_rate", "roas", "roi", "revenue_per_conversion"]

# Raw schema: counts are DOUBLE so that CSV text such as ``123.0`` or holes
# survive loading; the cleaning step casts them to BIGINT.
RAW_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLUMNS]
)

CLEAN_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS]
    + [
        T.StructField(c, T.LongType() if c in COUNT_COLUMNS else T.DoubleType())
        for c in NUMERIC_COLUMNS
    ]
)
