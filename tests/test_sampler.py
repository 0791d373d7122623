"""Posteriors against closed forms, telemetry against its definition, and what the sampler refuses."""

import json
import math

import numpy as np
import pytest

from credence.operators import predictive as P
from credence.operators import samplers as H
from credence.operators import series as W
from credence.plans.model import InferenceError, Model, ModelBuilder, ParameterError
from credence.plans.queries_models import counts_model, regression_model


def problems(n, seed=0):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        x = rng.normal(2.5, 1.4, 300)
        out.append((x, 0.1 + 1.5 * x + rng.normal(0, 1.5, 300)))
    return out


def sums(some):
    grams = [d.T @ d for x, y in some for d in (np.stack([np.ones(len(x)), x, y], 1),)]
    return [(np.full(len(some), 300.0), np.stack(grams))]


def test_batch_recovers_each_posterior():
    """Means and deviations of 40 regressions, run together, against least squares (the priors are wide)."""
    some, m = problems(40), regression_model()
    target = H.Target(m, stats=sums(some))
    raw, told = H.run_chains(target, 400, 300, [(1, k) for k in range(40)])
    got, z, ratio = target.values(raw), [], []
    for k, (x, y) in enumerate(some):
        d = np.stack([np.ones(300), x], 1)
        coef, rss, _, _ = np.linalg.lstsq(d, y, rcond=None)
        sd = math.sqrt(np.linalg.inv(d.T @ d)[1, 1] * rss[0] / 298)
        z.append((got["beta"][k].mean() - coef[1]) / sd * math.sqrt(400))
        ratio.append(got["beta"][k].std() / sd)
    assert abs(np.mean(z)) < 0.8 and np.std(z) < 2.5 and 0.93 < np.mean(ratio) < 1.07
    assert sum(row[3].sum() for row in told[300:]) == 0


@pytest.mark.parametrize("sampler", ["nuts", "hmc"])
def test_chains_do_not_depend_on_their_neighbours(sampler):
    some, m = problems(5), regression_model()
    together, _ = H.run_chains(H.Target(m, stats=sums(some)), 20, 40, [(3, k) for k in range(5)], sampler=sampler)
    alone, _ = H.run_chains(H.Target(m, stats=sums(some[4:])), 20, 40, [(3, 4)], sampler=sampler)
    assert np.array_equal(together[4], alone[0])


def normal_target(sd):
    b = ModelBuilder()
    for i, s in enumerate(sd):
        b.normal_prior(f"x{i}", 0.0, float(s))
    return H.Target(b.compile(), {})


def test_normal_density_and_energy_of_the_chosen_point():
    sd = np.array([0.1, 1.0, 5.0])
    target = normal_target(sd)
    raw, _ = H.run_chains(target, 3000, 400, [(7, 0), (8, 0)])
    assert np.allclose(raw.std((0, 1)) / sd, 1, atol=0.08) and np.all(abs(raw.mean((0, 1)) / sd) < 0.1)
    streams, metric, q = H.Streams([(1, 2), (3, 4)]), H.Metric(2, 3), np.tile(sd, (2, 1))
    value, g = target(q)
    for i in range(60):
        p = metric.momentum(streams.normal(i, 3))
        q2, v2, _, _, change, _, leaves, depth, moved = H.nuts_transition(target, metric, q, value, g, np.array([0.05, 0.12]), 6, streams, i)
        assert np.all(change[~moved] == 0) and np.all(v2 <= 0)
        # energy of the chosen point is at least its potential, so the error is bounded below by the change of that alone
        assert np.all(change >= value - v2 - metric.energy(p) - 1e-9)
        assert np.all(leaves >= 2**depth - 1) and np.all(leaves <= 2 ** (depth + 1) - 1)


def test_momenta_and_energies_share_a_matrix():
    rng, metric = np.random.default_rng(0), H.Metric(2, 3)
    for _ in range(30):
        metric.add(rng.normal(size=(2, 3)) * [0.01, 1, 30])
    metric.update()
    for k in range(2):
        assert np.allclose(metric.root[k] @ metric.root[k].T @ metric.inverse[k], np.eye(3), atol=1e-6)


def test_predictive_keys(spark):
    """Chains beyond 16 and draws beyond a million have values of their own, of any family."""
    rows = spark.createDataFrame([("0", k, 0.1 * k, 1.0) for k in range(5)], "dataset_id string, row_idx long, x double, y double")
    for m, names in ((regression_model(), ("alpha", "beta", "sigma")), (counts_model("poisson"), ("a", "b"))):
        draws = spark.createDataFrame([("0", c, d, n, None, 1.5) for c, d in ((0, 0), (17, 0), (40, 3), (0, 1_000_000), (1, 0)) for n in names], "dataset_id string, chain int, draw int, param string, idx int, value double")
        got = P.posterior_predictive(draws, rows, m).collect()
        assert len(got) == 25 and len({r.sample for r in got}) == 5
        if len(names) == 3:
            assert len({r.value for r in got}) == 25


def test_autoregression_refuses_missing_values(spark):
    good = [("a", t, float(t % 3)) for t in range(12)]
    kind = "series_id string, t int, y double"
    assert W.ar_posterior(spark.createDataFrame(good, kind), 2).count() == 1
    for bad in (("a", 12, None), ("a", 12, float("nan")), ("b", 0, 1.0)):
        with pytest.raises(Exception, match="finite values"):
            W.ar_posterior(spark.createDataFrame([*good, bad], kind), 2).collect()


def test_artifacts_are_checked():
    good = json.loads(regression_model().to_json())
    assert Model.from_json(json.dumps(good)).param_names == ["alpha", "beta", "sigma"]
    for change in (
        lambda a: a["likelihoods"][0].update(scale="sigmo"), lambda a: a["likelihoods"][0].update(scale=None), lambda a: a["likelihoods"][0].update(scale=-1.0), lambda a: a["likelihoods"][0]["terms"][0].__setitem__(0, "power"),
        lambda a: a["likelihoods"][0]["terms"][0].__setitem__(1, "nobody"), lambda a: a["priors"][0].update(args=[0.0, -1.0]), lambda a: a["priors"][2].update(args=["alpha"]), lambda a: a["priors"][0].update(size=0), lambda a: a.update(version=2),
    ):
        bad = json.loads(json.dumps(good))
        change(bad)
        with pytest.raises((InferenceError, ParameterError)):
            Model.from_json(json.dumps(bad))


def test_widths_from_data_and_structure_id(spark):
    """A scalar prior used with @ becomes a vector as wide as the data's arrays."""
    df = spark.createDataFrame([([0.1 * k, 1.0, -0.5 * k], 1.0 + 0.3 * k) for k in range(12)], "x array<double>, y double")
    b = ModelBuilder()
    b.normal_likelihood("y", b.student_t_prior("beta", 4.0, 0.0, 1.0) @ "x", 1.0, "y")
    m = b.compile(data=df)
    assert m.param_names == ["beta[0]", "beta[1]", "beta[2]"] and m.bind(df).count() == 12
    again = Model.from_json(m.to_json())
    assert again.structure_id == m.structure_id != regression_model().structure_id
    with pytest.raises(InferenceError, match="did you mean 'x'"):
        c = ModelBuilder()
        c.normal_likelihood("y", c.student_t_prior("beta", 4.0, 0.0, 1.0) @ "xx", 1.0, "y")
        c.compile(data=df)
