"""Reports over the stored rollups equal those over the table itself."""

import pytest
from pyspark.sql import functions as F

from adperf.operators import aggregate as A
from adperf.operators import insights as I
from adperf.operators.rollup import grouped, rollups
from adperf.plans.frames import kpi_frame
from adperf.session import materialize
from tests.conftest import SF_SMALL

REPORTS = {
    "summary": lambda d: A.summarize_by(d, "campaign"), "overall": A.overall_summary, "share": A.channel_share, "devices": A.device_means,
    "roi": A.roi_by_key, "weeks": A.weekly_ctr, "months": A.monthly_trend, "channels": I.channel_efficiency, "scores": I.campaign_scores,
    "budget": I.budget_allocation, "weekdays": I.weekday_stats, "best day": I.best_weekday,
}


@pytest.fixture(scope="module")
def kpi(spark):
    # a row without its keys, one without measures, one of another year
    rows = kpi_frame(spark, SF_SMALL)
    odd = rows.limit(3).withColumns({"channel": F.lit(None).cast("string"), "campaign": F.lit(None).cast("string")})
    return materialize(rows.unionByName(odd).unionByName(rows.limit(1).withColumns({"spend": F.lit(None).cast("double"), "date": F.lit(None).cast("date")})))


@pytest.fixture(scope="module")
def rolled(kpi):
    return rollups(kpi)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_over_rollups(kpi, rolled, name):
    def rows(source):
        return sorted((tuple((v is None, round(v, 4) if isinstance(v, float) else v) for v in r) for r in REPORTS[name](source).collect()), key=str)

    assert rows(kpi) == rows(rolled)


def test_one_scan_gives_every_set(kpi, rolled):
    n = kpi.count()
    for keys in rolled.ids:
        assert grouped(rolled, *keys).agg(F.sum("n_rows")).collect()[0][0] == n
    assert rolled.table.select("grouping").distinct().count() == len(rolled.ids) == 7
