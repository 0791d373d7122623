import math

import numpy as np
import pytest

from credence.operators import kalman as K
from credence.operators import structural as M


def test_one_step():
    f = K.filter_series(K.local_level(1, 2, 0, 3), np.array([2.0]))
    assert f["pc"][0, 0, 0] == pytest.approx(4) and f["fm"][0, 0] == pytest.approx(4 / 3) and f["fc"][0, 0, 0] == pytest.approx(4 / 3)


def test_smoother_and_forecast(spark):
    s = K.local_level(1, 1, 0, 1)
    series = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "series_id string, t int, y double")
    rows = K.kalman_filter(series, s, smooth=True).orderBy("t").collect()
    assert [r.smoothed_mean[0] for r in rows] == pytest.approx([1, 1.5]) and [r.smoothed_cov[0] for r in rows] == pytest.approx([0.5, 0.625])
    joint = K.with_cumulative(K.forecast_joint(series, s, 2)).orderBy("step").collect()
    assert [r.obs_var for r in joint] == pytest.approx([2.625, 3.625]) and [r.cum_var for r in joint] == pytest.approx([2.625, 9.5])
    closed = K.scalar_forecast(K.scalar_last(series, 1, 1, 1, 0, 1), 1, 1, 1, 2).orderBy("step").collect()
    assert [r.cum_var for r in closed] == pytest.approx([2.625, 9.5])


def test_missing_is_prediction_only():
    f = K.filter_series(K.local_level(1, 1, 0, 1), np.array([1.0, math.nan]))
    assert f["fm"][1] == f["fm"][0] and f["fc"][1] == f["pc"][1] and f["ll"][1] == 0


def test_seasonal_cycle():
    s = K.seasonal_local_level(4, 1e-9, 1e-9, 1, 10, [1, 2, -1, -2])
    mean, _, _, _ = K.forecast_series(s, s.mean, s.covariance, 4)
    assert mean == pytest.approx([11, 12, 9, 8])


@pytest.mark.parametrize("bad", [dict(observation_variance=0), dict(process_variance=-1), dict(process_variance=math.nan)])
def test_bad_systems(bad):
    with pytest.raises(K.StateSpaceError):
        K.local_level(**({"process_variance": 1, "observation_variance": 1} | bad))


def test_draws_have_the_smoother_moments():
    rng = np.random.default_rng(0)
    y = np.array([0.2, -0.1, math.nan, 0.4, 0.3, 0.6])
    s = K.local_level(0.1, 0.2, 0, 1)
    sm, sc = K.smooth_series(s, K.filter_series(s, y))
    draws = np.array([M._level_states(y, 0.1, 0.2, 0, 1, rng)[1:] for _ in range(20000)])
    assert np.abs(draws.mean(0) - sm[:, 0]).max() < 0.02 and np.abs(draws.var(0) / sc[:, 0, 0] - 1).max() < 0.06


def test_seasonal_draws_equal_the_general_ones():
    rng = np.random.default_rng(1)
    y = np.sin(np.arange(16) * np.pi / 2) + 3 + rng.normal(0, 0.2, 16)
    y[5] = np.nan
    p = M.InverseGammaPrior(3, 0.1)
    s = K.seasonal_local_level(4, 0.05, 0.02, 0.1, 0, None, 100, 10)
    a = np.array([M.SeasonalLocalLevel(4, p, p, p)._states(y, 0.05, 0.02, 0.1, s, rng) for _ in range(3000)])
    b = np.array([K.draw_states(s, y, rng) for _ in range(3000)])
    assert np.abs(a.mean(0) - b.mean(0)).max() < 0.06 and np.abs(np.log(a.var(0) / b.var(0))).max() < 0.2


def test_partitioning_plays_no_part(spark):
    rows = [(f"s{k}", t, math.sin(t + k)) for k in range(3) for t in range(20)]
    series = spark.createDataFrame(rows, "series_id string, t int, y double")
    p = M.InverseGammaPrior(3, 0.5)
    got = []
    for n in (1, 7):
        fit = M.fit(series.repartition(n), M.LocalLevel(p, p), chains=2, draws=20, warmup=10)
        got.append(sorted(map(tuple, M.forecast_local_level(fit, 3).collect())))
    assert got[0] == got[1]


def test_input_minimums():
    p = M.InverseGammaPrior(3, 1)
    for model, y in ((M.LocalLevel(p, p), [1.0]), (M.LocalLinearTrend(p, p, p), [1.0, 2]), (M.SeasonalLocalLevel(4, p, p, p), [1.0] * 7)):
        with pytest.raises(K.StateSpaceError):
            model.check(np.array(y))


def test_online_filter(spark, tmp_path):
    from credence.streaming.online import online_local_level

    rows = [("a", t, float(t)) for t in range(6)]
    for i in range(2):
        spark.createDataFrame(rows[3 * i : 3 * i + 3], "series_id string, t long, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, t long, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_local_level(stream, 0.1, 0.5, 0, 1).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("online").count() == 6
