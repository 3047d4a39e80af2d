import numpy as np
import pandas as pd
import pytest

from adperf.ml.encode import encoder
from adperf.ml.train import feature_importance
from adperf.operators.aggregate import correlation
from adperf.session import ensure_checkpoint_dir


def test_correlation_uses_the_rows_where_a_pair_is_present(spark):
    data = pd.DataFrame({"spend": [1.0, 2.0, None, 4.0, 5.5], "revenue": [2.0, None, 6.0, 8.5, 9.0], "clicks": [None] * 5})
    data["clicks"] = data["clicks"].astype(float)
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), "spend double, revenue double, clicks double")
    got = {(r.col_a, r.col_b): r["corr"] for r in correlation(df, ["spend", "revenue", "clicks"]).collect()}
    assert got["revenue", "spend"] == pytest.approx(data.spend.corr(data.revenue), abs=1e-6)
    assert got["clicks", "spend"] is None and got["spend", "spend"] == 1.0


def test_correlation_is_stable_and_pairwise(spark):
    """Large offsets lose no digits, whatever the rows' order and tasks; masks differ by pair."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4))
    x[:, 1] += 0.5 * x[:, 0]
    data = pd.DataFrame(x + [1e8, -1e7, 0, 5], columns=list("abcd"))
    data = data.mask(rng.random(data.shape) < [0, 0.3, 0.6, 0.1])
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in data.values], "a double, b double, c double, d double").repartition(7)
    want = data.corr()
    got = correlation(df, list("abcd")).collect()
    assert len(got) == 10 and all(r["corr"] == pytest.approx(want.loc[r.col_a, r.col_b], abs=2e-6) for r in got)
    assert all(r["corr"] is None for r in correlation(df.limit(0), list("abcd")).collect())


def test_importances_carry_the_names_of_their_slots(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import LinearRegression

    # the label is 10 for y of c1 and 3 for q of c2, so their coefficients stand out
    rows = [(float(i % 7), a, b, 10.0 * (a == "y") + 3.0 * (b == "q")) for i, (a, b) in enumerate([("x", "p"), ("y", "q"), ("x", "q"), ("y", "p"), ("z", "r")] * 12)]
    df = spark.createDataFrame(rows, "n1 double, c1 string, c2 string, label double")
    enc = encoder(["n1"], ["c1", "c2"]).fit(df)
    model = PipelineModel([*enc.stages, LinearRegression(labelCol="label", regParam=1e-6).fit(enc.transform(df))])
    slots = model.transform(df).schema["features"].metadata["ml_attr"]["attrs"]
    names = [r.feature for r in feature_importance(model, spark).collect()]
    assert len(names) == sum(map(len, slots.values())) == 7
    binary = {a["idx"]: a["name"] for a in slots.get("binary", [])}
    assert all(names[i].split("=")[1] == name.rsplit("_", 1)[1] for i, name in binary.items())
    value = {r.feature: r.importance for r in feature_importance(model, spark).collect()}
    assert value["c1=y"] > value["c2=q"] > value["n1"]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
