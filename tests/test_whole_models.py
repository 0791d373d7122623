import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import samplers as H
from credence.operators import structural as M
from credence.plans import queries_models as Q
from credence.plans.model import ModelBuilder
from credence.sources.tables import daily_revenue, table
from test_models import every_family


def test_weights_equal_repeated_rows():
    rng = np.random.default_rng(3)
    m, rows = every_family(rng)
    q, n = rng.normal(size=m.n_params) * 0.3, rng.integers(1, 5, 25)
    a, b = H.Target(m, rows, weight=n.astype(float))(q), H.Target(m, {k: np.repeat(v, n, axis=0) for k, v in rows.items()})(q)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


def test_posterior_predictive_simulates_every_line(spark, sf):
    got = Q.posterior_predictive(spark, sf).collect()
    assert len(got) == 12 and sum(r.n for r in got) == 4 * table(spark, sf, "lineitem").count()


def test_counts_models_see_every_order(spark, sf, monkeypatch):
    seen, many = {}, H.sample_many

    def spy(models, **options):
        seen.update({k: rows.count() for k, (_, rows) in models.items()})
        return many(models, **options)

    monkeypatch.setattr(H, "sample_many", spy)
    assert Q.nuts_counts_batch(spark, sf).count() == 5
    orders = table(spark, sf, "lineitem").select("l_orderkey").distinct().count()
    assert seen == {"poisson": orders, "negative_binomial": orders}


def test_negative_binomial_far_out_is_no_refuge():
    y, one = np.array([4.0, 2.0]), np.ones(2)
    at = lambda eta, alpha: one @ H._likelihood("negative_binomial", y, np.full(2, eta), alpha)[0]
    assert at(1768.0, 1e-100) < at(700.0, 1e-100) + 1e-6 < at(1.2, 5.0)


@pytest.mark.parametrize("name", ["gibbs_local_level", "gibbs_trend", "gibbs_seasonal"])
def test_series_models_see_whole_series(spark, sf, monkeypatch, name):
    class SeenError(Exception):
        pass

    def spy(series, *args, **options):
        raise SeenError(series.count())

    monkeypatch.setattr(M, "fit", spy)
    with pytest.raises(SeenError) as e:
        Q.QUERIES[name](spark, sf)
    assert e.value.args == (daily_revenue(spark, sf).count(),)


def test_weekly_revenue_is_all_revenue(spark, sf):
    weeks = Q.weekly_revenue(spark, sf).orderBy("t").collect()
    want = table(spark, sf, "lineitem").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).first()[0]
    assert [w.t for w in weeks] == list(range(len(weeks))) and sum(w.y or 0 for w in weeks) == pytest.approx(want / 1e6)
    assert Q.weekly_revenue(spark, sf).count() > 300 and Q.gibbs_yearly_season(spark, sf).count() == 26


def test_rollup_and_export_take_all_groups(spark, sf):
    groups = Q.programs(spark, sf).select("group_id").distinct().count()
    assert groups > 2 and Q.hierarchy_forecast_rollup(spark, sf).select("group_id").distinct().count() == groups + 1
    got = {r.group: r.rows for r in Q.export_groups(spark, sf).collect()}
    assert got["observed_data"] == table(spark, sf, "lineitem").count() and got["posterior"] == 3 * 3 * 2 * 50


def _draws(frame):
    return {(r.dataset_id, r.chain, r.draw, r.param): r.value for r in frame.collect()}


@pytest.mark.parametrize("family", ["bernoulli", "negative_binomial", "matrix"])
def test_large_datasets_are_dealt_over_tasks_with_the_same_draws(spark, family):
    """One task or a barrier stage of 1, 3 or 4, and other partitions of the rows: not a bit differs."""
    rows = spark.range(3000).select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("dataset_id"), (F.sin("id") * 2).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(3))).cast("double").alias("k"))
    b = ModelBuilder()
    if family == "bernoulli":
        b.bernoulli_logit_likelihood("y", b.normal_prior("a", 0, 2) + b.normal_prior("b", 0, 2) * "x", "y")
        rows = rows.withColumn("y", (F.col("k") > 1).cast("double"))
    elif family == "negative_binomial":
        b.negative_binomial_likelihood("y", b.normal_prior("a", 0, 2) + b.normal_prior("b", 0, 2) * "x", b.half_normal_prior("alpha", 5), "y")
        rows = rows.withColumn("y", F.col("k"))
    else:
        b.poisson_log_likelihood("y", b.vector_normal_prior("w", 3) @ "m", "y")
        rows = rows.select("dataset_id", F.array(F.lit(1.0), F.col("x"), F.cos("x")).alias("m"), F.col("k").alias("y"))
    model, options = b.compile(), {"chains": 2, "draws": 8, "warmup": 12, "max_tree_depth": 5}
    want = _draws(H.sample(model, rows, **options))
    for tasks, partitions in ((1, 4), (3, 7), (4, 1)):
        assert _draws(H.sample(model, rows.repartition(partitions), task_values=0, most_tasks=tasks, **options)) == want
    told = [H.sample(model, rows, what="transitions", task_values=n, **options).orderBy("dataset_id", "chain", "iter").collect() for n in (0, 10**9)]
    assert told[0] == told[1]


def test_small_and_large_datasets_of_one_run(spark):
    """Datasets on either side of the bound, and more tasks than blocks that hold rows."""
    rows = spark.range(1200).select(F.when(F.col("id") < 1190, "large").otherwise("small").alias("dataset_id"), F.sin("id").alias("x"), (F.col("id") % 3 > 0).cast("double").alias("y"))
    options = {"chains": 3, "draws": 6, "warmup": 8, "max_tree_depth": 4}
    want = _draws(H.sample(Q.logistic_model(), rows, **options))
    assert _draws(H.sample(Q.logistic_model(), rows, task_values=1000, **options)) == want and len({k[0] for k in want}) == 2
    tiny = rows.where("dataset_id = 'small'")
    assert _draws(H.sample(Q.logistic_model(), tiny, task_values=0, **options)) == {k: v for k, v in want.items() if k[0] == "small"}


def test_equal_rows_count_once_against_the_bound(spark):
    rows = spark.range(4000).selectExpr("double(id % 5) as x", "double((id div 5) % 2) as y")
    plan = lambda n: H.sample(Q.logistic_model(), rows, chains=1, draws=5, warmup=5, task_values=n)
    assert plan(20).count() == plan(19).count() == 10  # ten different rows of two columns


def test_log_gamma():
    x = np.concatenate([np.logspace(-8, 9, 400), np.arange(1, 40) / 2])
    assert H._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
