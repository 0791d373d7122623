import math

import numpy as np
import pytest

from credence.operators import samplers as H
from credence.operators import summary as S
from credence.plans.model import InferenceError, Model, ModelBuilder, ParameterError
from credence.plans.queries_models import regression_model
from credence.sources.tables import regression_problem


def every_family(rng, n=25):
    b = ModelBuilder()
    mu, tau = b.normal_prior("mu", 0, 5), b.half_normal_prior("tau", 2)
    th, v = b.normal_prior("th", mu, tau), b.vector_normal_prior("v", 2)
    s, u, be = b.gamma_prior("s", 2, 1), b.uniform_prior("u", -1, 3), b.beta_prior("be", 2, 3)
    st, ln, ex = b.student_t_prior("st", 4), b.log_normal_prior("ln", 0, 1), b.exponential_prior("ex", 1)
    b.normal_likelihood("a", th + mu * "x" + v @ "X" + 1.0, s, "y")
    b.poisson_log_likelihood("p", u * "x" + be, "c")
    b.negative_binomial_likelihood("n", st * "x", ln, "c2")
    b.bernoulli_logit_likelihood("b", ex * "x", "z")
    b.log_normal_likelihood("l", th + 0.0, ln, "w")
    b.exponential_likelihood("e", st + u, "w2")
    rows = {"x": rng.normal(size=n), "X": rng.normal(size=(n, 2)), "y": rng.normal(size=n), "c": rng.poisson(2, n).astype(float), "c2": rng.poisson(2, n).astype(float)}
    return b.compile(), rows | {"z": (rng.random(n) < 0.5).astype(float), "w": rng.lognormal(size=n), "w2": rng.exponential(size=n)}


def test_gradient_and_artifact():
    rng = np.random.default_rng(0)
    m, rows = every_family(rng)
    target, q = H.Target(m, rows), rng.normal(size=m.n_params) * 0.3
    num = [(target(q + e)[0] - target(q - e)[0]) / 2e-5 for e in np.eye(m.n_params) * 1e-5]
    assert target(q)[1] == pytest.approx(num, rel=1e-5, abs=1e-5)
    again = Model.from_json(m.to_json())
    assert again.param_names == m.param_names and H.Target(again, rows)(q)[0] == target(q)[0]


def test_sums_equal_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    y = 1 + 2 * x + rng.normal(size=50)
    d = np.stack([np.ones(50), x, y], 1)
    m, q = regression_model(), np.array([0.3, 0.2, 0.1])
    a, b = H.Target(m, {"x": x, "y": y})(q), H.Target(m, stats=[(50, d.T @ d)])(q)
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


@pytest.mark.parametrize("sampler", ["nuts", "hmc"])
def test_recovery(spark, sampler):
    rows = regression_problem(spark, 400, 1).selectExpr("x[0] as x", "1.5 + y as y")
    draws = H.sample(regression_model(), rows, chains=4, draws=300, warmup=300, sampler=sampler, seed=7).persist()
    got = {r.param: r for r in S.mean_std(draws).collect()}
    assert abs(got["alpha"].mean - 1.5) < 0.2 and abs(got["beta"].mean - 1) < 0.2 and abs(got["sigma"].mean - 1) < 0.2
    if sampler == "nuts":
        assert max(r.r_hat for r in S.split_r_hat(draws).collect()) < 1.05
    again = H.sample(regression_model(), rows.coalesce(1), chains=4, draws=300, warmup=300, sampler=sampler, seed=7)
    means = {r.param: r.mean for r in S.mean_std(again).collect()}
    assert all(abs(means[k] - got[k].mean) < 0.05 for k in got)


def test_constant_and_correlated_chains(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 1000
    for chain in range(4):
        x = 0.0
        for i in range(n):
            x = 0.5 * x + rng.normal()
            rows += [("ar", chain, i, x), ("flat", chain, i, 1.0), ("shifted", chain, i, rng.normal() + chain)]
    d = spark.createDataFrame(rows, "param string, chain int, draw int, value double")
    ess = {r.param: r.ess for r in S.ess(d).collect()}
    assert 900 < ess["ar"] < 1900 and math.isnan(ess["flat"])  # (1 - 0.5) / (1 + 0.5) of 4,000 draws
    r_hat = {r.param: r.r_hat for r in S.split_r_hat(d).collect()}
    assert r_hat["ar"] < 1.02 and r_hat["shifted"] > 1.3 and math.isnan(r_hat["flat"])


def test_binding_errors(spark):
    m = regression_model()
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert m.bind(df).count() == 1
    for bad, what in (
        (df.select("x"), "missing observation 'y'"), (df.selectExpr("x as xx", "y"), "did you mean 'xx'"), (df.selectExpr("array(x) as x", "y"), "must be a number"), (df.selectExpr("x", "y", "1 as yy"), "unexpected column 'yy'; did you mean 'y'"),
        (df.selectExpr("x", "double('nan') as y"), "aren't finite"), (df.where("false"), "empty"), (df.selectExpr("x", "cast(null as double) as y"), "aren't finite"),
    ):
        with pytest.raises(InferenceError, match=what.replace("(", r"\(")):
            m.bind(bad)
    b = ModelBuilder()
    b.poisson_log_likelihood("n", b.normal_prior("a", 0, 1) + 0.0, "y")
    with pytest.raises(InferenceError, match="support"):
        b.compile().bind(spark.createDataFrame([(1.5,)], "y double"))


def test_declaration_errors():
    b = ModelBuilder()
    a = b.normal_prior("alpha", 0, 1)
    other = ModelBuilder().normal_prior("alpha", 0, 1)
    for bad in (lambda: b.normal_prior("alpha", 0, 1), lambda: b.normal_prior("z", other, 1), lambda: b.half_normal_prior("s", -1), lambda: a * 2, lambda: b.vector_normal_prior("v", 2) * "x", lambda: b.uniform_prior("u", 2, 1), lambda: (a + other), lambda: a + "x"):
        with pytest.raises(ParameterError):
            bad()
    c = ModelBuilder()
    c.priors = [*c.priors]
    c.normal_likelihood("y", c.normal_prior("beta", 0, 1) * "x", 1.0, "y")
    c.likelihoods[0] = c.likelihoods[0].__class__("y", "normal", (("coef", "betta", "x", 0.0),), 1.0, "y")
    with pytest.raises(ParameterError, match="did you mean 'beta'"):
        c.compile()
    with pytest.raises(InferenceError):
        H.check_options(0, 1, 1, 0, 0.8, 10, 15)


def test_templates_and_tables(spark):
    from credence.plans import templates

    rng = np.random.default_rng(4)
    rows = [(*[float(g == k) for k in range(3)], [0.0, 1.0, 2.0][g] + rng.normal(0, 0.3)) for g in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "g0 double, g1 double, g2 double, y double")
    for model, names in ((templates.hierarchy(["g0", "g1", "g2"]), "group_"), (templates.centred_hierarchy(["g0", "g1", "g2"]), "offset_")):
        draws = H.sample(model, df, chains=2, draws=200, warmup=200).persist()
        got = {r.param: r.mean for r in S.mean_std(draws).collect()}
        assert 1.7 < got[f"{names}g2"] - got[f"{names}g0"] < 2.3
    assert "param" in S.format_table(S.diagnostics(draws))
