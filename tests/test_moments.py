import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.functions.moments import mean_of, products_of
from credence.operators import samplers, series
from credence.plans.model import ModelBuilder


def test_moments_keep_digits_at_any_offset_and_partitioning(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=200_000), rng.normal(size=200_000)
    frame = spark.createDataFrame(pd.DataFrame({"a": a, "b": a + b})).repartition(16)
    for shift in (0.0, 1e8, -3e9):
        row = frame.select((F.col("a") + shift).alias("a"), (F.col("b") - shift).alias("b")).agg(mean_of(F.col("a")).alias("m"), F.array(*products_of([F.col("a"), F.col("b")])).alias("s")).first()
        assert abs(row.m - shift - a.mean()) < 1e-9 + abs(shift) * 3e-16
        da, db = a - a.mean(), a + b - (a + b).mean()
        assert np.allclose(row.s, [da @ da, da @ db, db @ db], rtol=1e-6 if shift else 1e-11)


def test_a_million_equal_large_values_have_their_mean(spark):
    rows = spark.range(1_000_000).select((F.lit(1e8) + F.col("id") % 7 / 8).alias("v"))
    want = 1e8 + sum(i % 7 for i in range(1_000_000)) / 8e6
    assert abs(rows.agg(mean_of(F.col("v")).alias("m")).first().m - want) < 3e-8


def _rows(spark, n=10_000):
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"series_id": "s", "x": x, "y": 2 * x + rng.normal(size=n)})).repartition(5).cache()


def test_conjugate_posterior_does_not_feel_an_offset(spark):
    """y + 10^8 with the prior moved along, and x + 1.7 * 10^9 with a free intercept."""
    rows, prec = _rows(spark), np.diag([1e-2, 1e-2])

    def fit(y, x, mean, precision=prec):
        sums = series.gaussian_sums(rows, [F.lit(1.0), x], y, ["series_id"])
        return series.nig_posterior(sums, 2, np.array(mean), precision, 2.0, 1.0).first()

    plain, high = fit(F.col("y"), F.col("x"), [0.0, 0.0]), fit(F.col("y") + 1e8, F.col("x"), [1e8, 0.0])
    assert np.allclose(np.array(high.coef) - [1e8, 0], plain.coef, atol=1e-6) and abs(high.scale / plain.scale - 1) < 1e-6
    # raw sums left nothing of this: residual squares below 0
    assert abs(plain.scale / (0.5 * 10_000) - 1) < 0.05
    free = np.diag([1e-30, 1e-2])
    near, far = fit(F.col("y"), F.col("x"), [0.0, 0.0], free), fit(F.col("y"), F.col("x") + 1.7e9, [0.0, 0.0], free)
    assert abs(far.coef[1] - near.coef[1]) < 1e-6 and abs(far.scale / near.scale - 1) < 1e-6


def test_solution_equals_the_plain_formula(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([np.full(60, 3.0), rng.normal(2, 1, 60), rng.normal(-1, 2, 60)])
    y, prior, mean = rng.normal(size=60), np.diag([0.5, 2.0, 1.0]) + 0.1, np.array([0.3, -0.2, 1.0])
    for design in (x, x[:, 1:]):  # with a constant predictor and without one
        k = design.shape[1]
        both = np.column_stack([design, y])
        d = both - both.mean(0)
        d[:, np.ptp(both, 0) == 0] = 0
        coef, post, shape, scale = series.nig_solve(60, both.mean(0), d.T @ d, mean[:k], prior[:k, :k], 2.0, 1.0)
        want_post = prior[:k, :k] + design.T @ design
        want = np.linalg.solve(want_post, prior[:k, :k] @ mean[:k] + design.T @ y)
        want_scale = 1 + 0.5 * (y @ y + mean[:k] @ prior[:k, :k] @ mean[:k] - want @ want_post @ want)
        assert np.allclose(coef, want) and np.allclose(post, want_post) and shape == 32 and np.isclose(scale, want_scale)


@pytest.mark.parametrize("sampler", ["nuts", "hmc"])
def test_sampler_draws_do_not_feel_an_offset(spark, sampler):
    """A constant of 10^8 in the predictor and in the response: the posterior of the rows without both."""
    rows = _rows(spark)

    def fit(shift):
        b = ModelBuilder()
        intercept, slope, sigma = b.normal_prior("a", 0.0, 10.0), b.normal_prior("b", 0.0, 10.0), b.half_normal_prior("sigma", 5.0)
        b.normal_likelihood("y", intercept + slope * "x" + shift if shift else intercept + slope * "x", sigma, "y")
        data = rows.select(F.lit("d").alias("dataset_id"), "x", (F.col("y") + shift).alias("y"))
        got = samplers.sample(b.compile(), data, chains=2, draws=150, warmup=200, sampler=sampler).groupBy("param").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()
        return {r.param: (r.m, r.s) for r in got}

    plain, high = fit(0.0), fit(1e8)
    for name, (m, s) in plain.items():
        assert abs(high[name][0] - m) < 0.5 * s and 0.7 < high[name][1] / s < 1.4
    assert abs(high["b"][0] - 2) < 0.05 and abs(high["sigma"][0] - 1) < 0.05
