"""Deterministic advertising fact view derived from the TPC-H-style tables.

The driver data hold no advertising facts, so every query starts from this
view (FIXTURES.md F2).  It is a plain star join plus projections; the same
mapping is written as SQL for the DuckDB oracle in ``oracle/sql.py``.

Join order is chosen for scale: ``orders`` is first reduced to
``(o_orderkey, c_mktsegment)`` by joining the customer dimension, so the
large ``lineitem`` side is shuffled once on ``l_orderkey``; ``part`` then
joins on ``l_partkey``.  AQE broadcasts a side only when its runtime size is
below ``spark.sql.autoBroadcastJoinThreshold`` and splits skewed partitions
of sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adperf.schema import REQUIRED_COLUMNS
from adperf.session import table_path


def _null_if(cond, value):
    return F.when(cond, F.lit(None)).otherwise(value)


def ad_facts_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advertising row per lineitem (before the injected duplicates)."""
    li = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select("o_orderkey", "o_custkey")
    cust = spark.read.parquet(table_path(sf_dir, "customer")).select("c_custkey", "c_mktsegment")
    part = spark.read.parquet(table_path(sf_dir, "part")).select("p_partkey", "p_brand")

    order_segment = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "c_mktsegment"
    )
    j = li.join(order_segment, li.l_orderkey == order_segment.o_orderkey).join(
        part, li.l_partkey == part.p_partkey
    )

    qty, ok, pk = F.col("l_quantity"), F.col("l_orderkey"), F.col("l_partkey")
    seg = F.col("c_mktsegment")
    units = F.floor(qty * F.col("l_tax"))
    return j.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.when((ok * 7 + F.col("l_linenumber")) % 60 == 7, F.upper("p_brand"))
        .otherwise(F.col("p_brand"))
        .alias("campaign"),
        _null_if((ok + pk) % 97 == 5, seg).alias("channel"),
        F.when(F.col("l_returnflag") == "A", F.lit(" mobile"))
        .when(F.col("l_returnflag") == "N", F.lit("Desktop"))
        .otherwise(F.lit("tablet "))
        .alias("device"),
        _null_if(ok % 33 == 0, F.floor(F.col("l_extendedprice") / 10).cast("double")).alias(
            "impressions"
        ),
        _null_if(ok % 31 == 0, qty * F.col("l_linenumber")).cast("double").alias("clicks"),
        _null_if(pk % 37 == 0, qty * (pk % 250) / 100).cast("double").alias("spend"),
        _null_if(pk % 29 == 0, units.cast("double")).alias("conversions"),
        _null_if(
            F.col("l_suppkey") % 41 == 0,
            (units * (pk % 75) * (F.length(seg) % 4 + 1)).cast("double"),
        ).alias("revenue"),
        _null_if(ok % 43 == 0, F.col("l_discount") * 11).cast("double").alias("bounce_rate"),
        (qty * 12).cast("double").alias("avg_session_duration"),
    )


def ad_facts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty raw fact table: base rows plus exact duplicates."""
    base = ad_facts_base(spark, sf_dir)
    # UNION ALL of the base rows and a second copy of rows with clicks % 100 = 0,
    # produced from one scan and one join: each row explodes into 1 or 2 copies.
    copies = F.when(F.col("clicks") % 100 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.withColumn("_copy", F.explode(copies)).select(*REQUIRED_COLUMNS)
