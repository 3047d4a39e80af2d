"""Row-level operators on a stream equal the batch result for the same rows."""

import datetime as dt

from adperf.operators import clean as C
from adperf.operators.kpi import compute_kpis
from adperf.streaming import kpi_stream, read_raw_stream, write_stream
from tests.conftest import raw_rows


def test_stream_matches_batch(spark, tmpdir_path):
    d = dt.date(2025, 7, 1)
    rows = [
        (d, " brand x", "email", "Mobile", 100.0, 10.0, 5.0, 1.0, 20.0, 0.5, 60.0),
        (d, "Brand X", None, "tablet ", 50.0, None, 2.0, 0.0, 0.0, 0.2, 30.0),
        (d, "Brand Y", "Email", "Desktop", 10.0, 20.0, 1.0, 0.0, 0.0, 0.3, 10.0),
    ]
    raw = raw_rows(spark, rows)
    src = f"{tmpdir_path}/in"
    raw.write.parquet(src)
    fills = C.fill_values(C.standardized(raw))
    out = f"{tmpdir_path}/out"
    q = write_stream(kpi_stream(read_raw_stream(spark, src), fills), out, f"{tmpdir_path}/ckpt")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = compute_kpis(C.drop_invalid(C.fix_types(C.impute(C.standardize(raw), fills))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2
