"""Micro-frames for the edge semantics N1-N13 (FIXTURES F5)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adperf.functions import npround, title_case
from adperf.operators import clean as C
from adperf.operators.kpi import compute_kpis
from adperf.sources import files
from tests.conftest import raw_rows

D = dt.date(2025, 7, 1)


def row(**kw):
    base = dict(date=D, campaign="A", channel="Email", device="Mobile", impressions=100.0, clicks=10.0,
                spend=5.0, conversions=1.0, revenue=20.0, bounce_rate=0.5, avg_session_duration=60.0)
    base.update(kw)
    return tuple(base[k] for k in ["date", "campaign", "channel", "device", "impressions", "clicks", "spend",
                                   "conversions", "revenue", "bounce_rate", "avg_session_duration"])


def test_npround_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,), (-0.125,)], "x double")
    got = [r[0] for r in df.select(npround("x", 2)).collect()]
    assert got[0] == 0.12 and got[3] == -0.12
    assert [r[0] for r in df.select(npround("x", 0)).collect()][2] == 2.0


def test_title_case_letter_runs(spark):
    df = spark.createDataFrame([("o'neil a-b",), ("google ads2x",), ("  \ttablet \n",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == ["O'Neil A-B", "Google Ads2X", "Tablet", "", None]


def test_zero_denominators_give_zero_kpis(spark):
    df = C.fix_types(raw_rows(spark, [row(impressions=0.0, clicks=0.0, spend=0.0, conversions=0.0)]))
    r = compute_kpis(df).collect()[0]
    for k in ["ctr", "cpc", "cpm", "conversion_rate", "roas", "roi", "revenue_per_conversion"]:
        assert r[k] == 0.0


def test_rounding_tie_ctr(spark):
    df = C.fix_types(raw_rows(spark, [row(impressions=8.0, clicks=1.0)]))
    # 1/8 = 0.125 at 6 dp stays; at 2 dp NumPy rounding gives 0.12
    assert compute_kpis(df).select(npround("ctr", 2)).collect()[0][0] == 0.12


def test_median_fill_truncates_and_mode_tie(spark):
    rows = [row(clicks=1.0, channel="b"), row(clicks=2.0, channel="a", spend=6.0), row(clicks=None, channel=None, spend=7.0)]
    out = C.imputed(raw_rows(spark, rows)).orderBy("spend").collect()
    assert out[2]["clicks"] == 1          # median 1.5 truncated by the int cast
    assert out[2]["channel"] == "A"       # mode tie -> smallest ('a' then title case)


def test_case_variants_survive_dedupe(spark):
    df = raw_rows(spark, [row(campaign="X Y"), row(campaign="X y"), row(campaign="X Y")])
    d = C.dedupe(df)
    assert d.count() == 2
    assert {r[0] for r in C.standardize(d).select("campaign").collect()} == {"X Y"}


def test_bounce_rate_validity(spark):
    rows = [row(bounce_rate=b, spend=float(i)) for i, b in enumerate([0.0, 1.0, 1.0001, -0.1])]
    out = C.clean_data(raw_rows(spark, rows)).select("bounce_rate").collect()
    assert sorted(r[0] for r in out) == [0.0, 1.0]


def test_clicks_above_impressions_dropped(spark):
    out = C.clean_data(raw_rows(spark, [row(clicks=200.0), row(spend=9.0)]))
    assert out.count() == 1


def test_all_null_column_stays_null(spark):
    rows = [row(revenue=None), row(revenue=None, spend=3.0)]
    df = C.fix_types(C.impute(C.standardized(raw_rows(spark, rows)), C.fill_values(C.standardized(raw_rows(spark, rows)))))
    assert df.filter(F.col("revenue").isNull()).count() == 2


def test_cleaning_report_counts(spark):
    rows = [row(), row(), row(spend=None, clicks=3.0), row(bounce_rate=2.0, clicks=4.0)]
    rep = {(r["step"], r["column_name"]): r for r in C.cleaning_report(raw_rows(spark, rows)).collect()}
    assert rep[("input", None)]["n"] == 4
    assert rep[("duplicates", None)]["n"] == 1
    assert rep[("fill", "spend")]["n"] == 1 and rep[("fill", "spend")]["fill_value"] == 5.0
    assert rep[("invalid", None)]["n"] == 1
    assert rep[("output", None)]["n"] == 2


def test_csv_nan_empty_and_float_ints(spark, tmpdir_path):
    path = f"{tmpdir_path}/ads.csv"
    header = "date,campaign,channel,device,impressions,clicks,spend,conversions,revenue,bounce_rate,avg_session_duration,extra"
    lines = [header,
             "2025-07-01,A,Email,Mobile,NaN,1.0,2.0,0,1,0.5,10,x",
             "2025-07-02,A,Email,Mobile,,2.0,2.0,0,1,0.5,10,y",
             "2025-07-03,A,Email,Mobile,123.0,3.0,2.0,0,1,0.5,10,z"]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    df = files.load_csv(spark, path)
    vals = [r["impressions"] for r in df.orderBy("date").collect()]
    assert vals == [None, None, 123.0]
    assert C.fix_types(df.fillna(0.0)).schema["impressions"].dataType.typeName() == "long"


def test_missing_column_and_path(spark, tmpdir_path):
    path = f"{tmpdir_path}/bad.csv"
    with open(path, "w") as fh:
        fh.write("date,campaign\n2025-07-01,A\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        files.load_csv(spark, path)
    with pytest.raises(FileNotFoundError):
        files.load_csv(spark, f"{tmpdir_path}/nope.csv")


def test_csv_roundtrip_sink(spark, tmpdir_path):
    df = raw_rows(spark, [row(), row(spend=1.5)])
    files.write_csv(df, f"{tmpdir_path}/out")
    back = files.load_csv(spark, f"{tmpdir_path}/out")
    assert back.count() == 2
    files.write_parquet(df, f"{tmpdir_path}/pq", by_month=True)
    assert files.load_parquet(spark, f"{tmpdir_path}/pq").count() == 2


def test_metamorphic_duplicates_and_scaling(spark):
    from tests.conftest import SF_SMALL
    from adperf.sources.fixture import ad_facts_raw

    raw = ad_facts_raw(spark, SF_SMALL)
    once = C.dedupe(raw).count()
    assert C.dedupe(raw.unionByName(raw)).count() == once
    k = compute_kpis(C.fix_types(raw_rows(spark, [row(spend=4.0, revenue=10.0)]))).collect()[0]
    k3 = compute_kpis(C.fix_types(raw_rows(spark, [row(spend=12.0, revenue=30.0)]))).collect()[0]
    assert (k["roas"], k["roi"]) == (k3["roas"], k3["roi"])
