import pytest

from compare import duck, same
from credence.plans import catalog

ROWS_ONLY = ["kalman_trend_smoother", "kalman_seasonal_forecast", "ar2_posterior", "study_generator", "shared_inputs_bind", "model_artifact", "gibbs_local_level", "gibbs_hierarchy", "ar_forecast_paths", "prior_predictive", "prior_draws_discrete", "export_groups", "fixed_effects_panel"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), duck(sf, catalog.ORACLES[name]))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 21
    assert set(e.oracle_sql()) <= set(e.queries())
