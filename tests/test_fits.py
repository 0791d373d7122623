"""Getters, metadata, labels, export, batch report, guards, and the seasonal forecast against a loop."""

import numpy as np
import pytest

from credence.operators import fits
from credence.operators import samplers as H
from credence.operators import structural as M
from credence.operators.kalman import StateSpaceError
from credence.plans.model import InferenceError
from credence.plans.queries_models import regression_model

FITTED = "series_id string, chain int, draw int, level_variance double, seasonal_variance double, observation_variance double, terminal_level double, terminal_seasonal array<double>"


@pytest.fixture(scope="module")
def fitted(spark):
    return spark.createDataFrame([("a", c, d, 0.25, 0.04, 1.0, 5.0 + d, [1.0, -2.0, 0.5]) for c in range(2) for d in range(3)], FITTED)


def test_samples_and_metadata(spark, fitted):
    got = fits.samples(fitted).where("chain = 1 and draw = 2").collect()
    assert {(r.param, r.idx): r.value for r in got} == {
        ("level_variance", None): 0.25, ("level_sd", None): 0.5, ("seasonal_variance", None): 0.04, ("seasonal_sd", None): 0.2, ("observation_variance", None): 1.0, ("observation_sd", None): 1.0,
        ("terminal_level", None): 7.0, ("terminal_seasonal", 0): 1.0, ("terminal_seasonal", 1): -2.0, ("terminal_seasonal", 2): 0.5,
    }
    series = spark.createDataFrame([("a", t, None if t == 2 else float("nan") if t == 3 else 1.0) for t in range(6)], "series_id string, t int, y double")
    r = fits.metadata(fitted, series, warmup=9, period=4).first()
    assert (r.chains, r.draws, r.time_count, r.observed_count, r.warmup, r.thin, r.period, r.order) == (2, 3, 6, 4, 9, 1, 4, None)


def test_export(spark, fitted, tmp_path):
    series = spark.createDataFrame([("a", 0, 1.0)], "series_id string, t int, y double")
    assert fits.export_series(f"file://{tmp_path}", fitted, series) == ["posterior", "observed_data"]
    assert spark.read.parquet(f"file://{tmp_path}/posterior").count() == 60 and spark.read.parquet(f"file://{tmp_path}/observed_data").count() == 1


def test_seasonal_forecast_folds_its_states(spark, fitted):
    """Without noise the states are moved as by hand; labelled intervals are their quantiles."""
    still = fitted.selectExpr("series_id", "chain", "draw", "0.0D as level_variance", "0.0D as seasonal_variance", "0.0D as observation_variance", "terminal_level", "terminal_seasonal")
    rows = M.forecast_seasonal(still, 9).where("chain = 0 and draw = 1").orderBy("step").collect()
    states, want = [1.0, -2.0, 0.5], []
    for _ in range(9):
        states = [-sum(states), *states[:-1]]
        want.append(states[0])
    assert [r.seasonal for r in rows] == pytest.approx(want) and [r.observation for r in rows] == pytest.approx([6.0 + x for x in want])
    assert rows[-1].cumulative == pytest.approx(sum(r.observation for r in rows))
    paths = M.forecast_seasonal(fitted, 2)
    one = fits.intervals(paths, level=0.5).where("step = 1").first()
    seen = [r.observation for r in paths.where("step = 1").collect()]
    assert (one.lower, one.upper) == pytest.approx(tuple(np.quantile(seen, [0.25, 0.75])))
    assert (one.uncertainty_kind, one.interval_kind) == ("parameter_integrated_posterior_predictive", "pointwise_equal_tailed")


def test_guards(spark, fitted):
    with pytest.raises(StateSpaceError, match="limit is 50"):
        M.forecast_seasonal(fitted, 9, most=50)
    with pytest.raises(StateSpaceError):
        M.forecast_seasonal(fitted, 0)
    prior = M.InverseGammaPrior(3.0, 1.0)
    model, kind = M.HierarchicalMean(prior, prior, prior), "program_id string, group_id string, y double"
    with pytest.raises(StateSpaceError, match="limit is 10"):
        model.fit(spark.createDataFrame([("p", "g", 1.0), ("q", "g", 2.0)], kind), chains=1, draws=2, warmup=1, most=10)
    with pytest.raises(InferenceError, match="one group"):
        model.fit(spark.createDataFrame([("p", "g", 1.0), ("p", "h", 2.0)], kind), chains=1, draws=2, warmup=1)


def test_batch_report(spark):
    rows = spark.createDataFrame([(d, 0.1 * k, 1 + 0.2 * k + 0.3 * (k * 7 % 5)) for d in ("x", "y", "z") for k in range(30)], "dataset_id string, x double, y double")
    told = H.sample(regression_model(), rows, chains=2, draws=30, warmup=40, what="transitions")
    got = {r.dataset_id: r for r in fits.batch_report(told, spark.createDataFrame([("z", 0), ("y", 1), ("x", 2)], "dataset_id string, dataset_index int")).collect()}
    assert [(got[d].dataset_index, got[d].place_from_end) for d in "zyx"] == [(0, -3), (1, -2), (2, -1)]
    assert all(r.chains == 2 and r.draws == 30 and len(r.accept_rates) == 2 and r.divergences == sum(r.divergences_per_chain) and 0.4 < r.accept_rate <= 1 for r in got.values())
    assert [fits.batch_report(told).orderBy("dataset_index").first().dataset_id] == ["x"]
