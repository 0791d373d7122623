import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import panel
from credence.plans import queries_models as Q
from credence.plans.model import InferenceError

SCHEMA = "series_id string, store string, item int, month string, trend double, x double, sales double"


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        store, item, month = f"s{rng.integers(23)}", int(rng.integers(5)), [None, "", "a=b", "m:1"][rng.integers(4)]
        out.append(("g" if k % 3 else None, store if k % 50 else None, item, month, k / n, float(rng.normal()), float(3 + item + 2 * k / n + rng.normal())))
    return out


def dense(data, factors, slopes, sigma):
    """The same posterior from the whole design matrix."""
    place = {"store": 1, "item": 2, "month": 3, "trend": 4, "x": 5}
    got = {}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        params = [(f, v) for f in factors for v in dict.fromkeys(None if r[place[f]] is None else str(r[place[f]]) for r in own)] + [(s, None) for s in slopes]
        value = lambda r, f, v: r[place[f]] if f in slopes else float((None if r[place[f]] is None else str(r[place[f]])) == v)
        x = np.array([[value(r, f, v) for f, v in params] for r in own], float)
        a = x.T @ x / sigma**2 + np.diag([{**factors, **slopes}[f] ** -2.0 for f, _ in params])
        cov = np.linalg.inv(a)
        mean = cov @ x.T @ np.array([r[6] for r in own]) / sigma**2
        got |= {(g, *p): (m, s) for p, m, s in zip(params, mean, np.sqrt(np.diag(cov)))}
    return got


@pytest.mark.parametrize(
    "factors, slopes",
    [({"store": 20.0, "item": 10.0, "month": 30.0}, {"trend": 20.0, "x": 5.0}), ({"store": 20.0}, {"x": 5.0}), ({"item": 2.0, "store": 20.0}, {}), ({"item": 3.0}, {})],
)
def test_equal_to_the_dense_regression(spark, factors, slopes):
    data = rows()
    want = dense(data, factors, slopes, 1.5)
    for partitions in (1, 5):
        frame = spark.createDataFrame(data, SCHEMA).withColumn("level_0", F.lit("clash")).repartition(partitions)
        got = {(r.series_id, r.term, r.level): (r["mean"], r.sd) for r in panel.panel_effects(frame, factors, slopes, "sales", 1.5, buckets=3).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-8, abs=1e-8)


def test_any_factor_may_be_eliminated(spark):
    frame = spark.createDataFrame(rows(200), SCHEMA)
    runs = [{tuple(r)[:3]: (r["mean"], r.sd) for r in panel.panel_effects(frame, {"store": 20.0, "item": 10.0, "month": 3.0}, {"x": 5.0}, "sales", 1.5, eliminate=f, buckets=2).collect()} for f in ("store", "month")]
    assert runs[0].keys() == runs[1].keys() and all(runs[0][k] == pytest.approx(runs[1][k], rel=1e-8, abs=1e-9) for k in runs[0])


def test_odd_panels(spark, monkeypatch):
    frame = spark.createDataFrame(rows(60), SCHEMA)
    factors = {"store": 20.0, "item": 10.0}
    assert panel.panel_effects(frame.where(F.lit(False)), factors, {"x": 1.0}, "sales", 1.0).count() == 0
    with pytest.raises(Exception, match="finite"):
        panel.panel_effects(frame.withColumn("x", F.lit(None).cast("double")), factors, {"x": 1.0}, "sales", 1.0).collect()
    for bad in (({}, {"x": 1.0}, 1.0), (factors, {"x": 0.0}, 1.0), (factors, {}, 0.0)):
        with pytest.raises(InferenceError):
            panel.panel_effects(frame, bad[0], bad[1], "sales", bad[2])


def test_many_levels_are_eliminated_one_by_one(spark):
    """Ten thousand effects beside four others; the slope is recovered."""
    frame = spark.range(40000).selectExpr("'all' AS series_id", "id % 10000 AS shop", "cast(id % 3 AS string) AS kind", "sin(id) AS x", "sin(id) * 2 + (id % 10000) / 1000 + (id % 3) AS sales")
    got = panel.panel_effects(frame, {"shop": 100.0, "kind": 5.0}, {"x": 10.0}, "sales", 0.1)
    assert got.count() == 10004 and got.where("term = 'x'").first()["mean"] == pytest.approx(2.0, abs=1e-4)


def test_registered_panel_equals_the_dense_regression(spark, sf):
    factors, slopes = Q.PANEL
    data = Q.panel_rows(spark, sf).toPandas()
    x = np.concatenate([*((data[f].to_numpy()[:, None] == np.unique(data[f])).astype(float) for f in factors), data[[*slopes]].to_numpy()], axis=1)
    spread = np.concatenate([*([v] * data[f].nunique() for f, v in factors.items()), [*slopes.values()]])
    covariance = np.linalg.inv(x.T @ x / 225 + np.diag(spread**-2.0))
    params = [(f, str(v)) for f in factors for v in np.unique(data[f])] + [(s, None) for s in slopes]
    want = dict(zip(params, zip(covariance @ x.T @ data["y"].to_numpy() / 225, np.sqrt(np.diag(covariance)))))
    got = {(r.term, r.level): (r["mean"], r.sd) for r in Q.panel_indicators(spark, sf).collect()}
    assert got.keys() == want.keys() and len(got) > 115
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-7)
