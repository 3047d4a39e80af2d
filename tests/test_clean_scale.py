"""The shared cleaning step: cheap paths give what the general ones give."""

from pyspark.sql import functions as F

from adperf.functions import title_case
from adperf.functions.exprs import ONE_RUN, strip_ws
from adperf.operators.quantile import DEFAULT_ACCURACY
from adperf.session import small_hash_joins


def test_one_run_texts_equal_split_texts(spark):
    texts = ["tablet ", " mobile", "Desktop", "BRAND#12", "brand 7 ", " x", "a-b", "o'neil", "ads2x", "", " ", "\tkey\n", "éa", "a ", "12ab", "aß", "ab 1\n", "aⒶ", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    split = F.array_join(F.transform(F.regexp_extract_all(strip_ws("s"), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda x: F.initcap(x)), "")
    rows = df.select("s", title_case("s").alias("got"), split.alias("want"), F.col("s").rlike(ONE_RUN).alias("short")).collect()
    assert all(r.got == r.want for r in rows)
    assert {r.s for r in rows if r.short} == {"tablet ", " mobile", "Desktop", "BRAND#12", "brand 7 ", " x"}


def test_small_sides_join_without_sorting(spark):
    """Where measured partitions are small no side is sorted; the setting is given back."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(name, None)
    a = spark.range(2000).select((F.col("id") % 300).alias("k"), "id")
    b = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        with small_hash_joins(spark):
            joined = a.join(b, "k")
            assert joined.count() == 2000 and len(joined.collect()) == 2000
            plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and spark.conf.get(name, None) == before


def test_sketches_are_small():
    """What one task merges from all tasks is bounded by the sketch's accuracy."""
    assert DEFAULT_ACCURACY <= 5_000
