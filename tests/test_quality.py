import numpy as np
import pandas as pd
import pytest

from compare import duck, same
from credence.operators import quality as V
from credence.operators import summary as S
from credence.plans import queries_models as Q


@pytest.mark.parametrize("name", ["exact_marginals", "posterior_errors"])
def test_sql_agrees(spark, sf, name):
    same(Q.QUERIES[name](spark, sf).toPandas(), duck(sf, Q.ORACLES[name]))


def _measures(draws, exact):
    """The measures by the book, from (chain, draw, parameter)."""
    mean, sd = draws.mean((0, 1)), draws.reshape(-1, draws.shape[2]).std(0, ddof=1)
    m, s = (np.array(v) for v in exact)
    return np.sqrt(np.mean((mean - m) ** 2)), np.sqrt(np.mean(((mean - m) / s) ** 2)), np.sqrt(np.mean((sd / s - 1) ** 2))


def test_measures_and_gate(spark):
    """Good draws pass; biased, narrow and stuck ones fail for their own reasons; a divergence fails alone."""
    rng = np.random.default_rng(4)
    good = rng.normal(size=(4, 500, 2)) * [0.1, 2.0] + [1.0, -3.0]
    stuck = good + np.array([0.0, 0.02, 0.05, 0.1])[:, None, None]
    cases = {"good": good, "biased": good + [0.05, 0.0], "narrow": (good - [1, -3]) * 0.7 + [1, -3], "stuck": stuck, "divergent": good}
    rows = [(d, c, i, f"p{k}", float(v[c, i, k])) for d, v in cases.items() for c in range(4) for i in range(500) for k in range(2)]
    draws = spark.createDataFrame(pd.DataFrame(rows, columns=["dataset_id", "chain", "draw", "param", "value"]))
    exact = spark.createDataFrame([(d, f"p{k}", m, s) for d in cases for k, (m, s) in enumerate([(1.0, 0.1), (-3.0, 2.0)])], "dataset_id string, param string, exact_mean double, exact_sd double")
    told = spark.createDataFrame([("divergent", 3), ("good", 0)], "dataset_id string, divergences long")
    got = {r.dataset_id: r for r in V.quality_gate(V.posterior_quality(S.diagnostics(draws, ["dataset_id", "param"]), exact, told)).collect()}
    for d, v in cases.items():
        r = got[d]
        assert (r.mean_rmse_vs_exact_posterior, r.mean_rmse_exact_posterior_sd_units, r.sd_relative_rmse_vs_exact_posterior) == pytest.approx(_measures(v, ([1.0, -3.0], [0.1, 2.0])))
    assert got["good"].passed and got["good"].failures == []
    assert got["biased"].failures == ["mean_rmse_exact_posterior_sd_units"] and got["narrow"].failures == ["sd_relative_rmse_vs_exact_posterior"]
    assert "rhat_rank_max" in got["stuck"].failures and got["divergent"].failures == ["divergences"] and not got["divergent"].passed


def test_what_is_not_a_number_fails(spark):
    q = spark.createDataFrame([(float("nan"), None, 500.0, 0.0, float("nan"))], "rhat_rank_max double, divergences long, ess_bulk_min double, mean_rmse_exact_posterior_sd_units double, sd_relative_rmse_vs_exact_posterior double")
    assert V.quality_gate(q).first().failures == ["rhat_rank_max", "divergences", "sd_relative_rmse_vs_exact_posterior"]
