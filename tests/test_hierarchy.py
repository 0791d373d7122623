import numpy as np
import pytest

from credence.operators import structural as M
from credence.operators import summary as S
from credence.plans.model import InferenceError

PRIOR = M.InverseGammaPrior(3.0, 2.0)
KIND = "program_id string, group_id string, y double"


def programs():
    rng = np.random.default_rng(3)
    rows = []
    for g, mean in (("a", 1.0), ("b", 4.0), ("c", 2.0)):
        for p in range(12):
            own = mean + rng.normal()
            rows += [(f"{g}{p}", g, float(own + rng.normal())) for _ in range(1 + p % 4)]
    return [*rows, ("a0", "a", float("nan"))]


def by_program(rows, draws, warmup):
    """The chain that draws each program in turn: mean and deviation of every parameter."""
    rows = [r for r in rows if r[2] == r[2]]
    names, groups = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = [np.array([r[2] for r in rows if r[0] == p]) for p in names]
    of = np.array([groups.index(p[0]) for p in names])
    n, own, rng = np.array([len(v) for v in y], float), np.array([v.mean() for v in y]), np.random.default_rng(1)
    within, size, kept = sum(((v - v.mean()) ** 2).sum() for v in y), np.bincount(of), []
    p, g, vg, vp, vo = own.copy(), np.bincount(of, own) / size, 0.5, 0.5, 0.5
    for i in range(warmup + draws):
        prec = 0.01 + len(g) / vg
        pop = g.sum() / vg / prec + rng.normal() / prec**0.5
        prec = 1 / vg + size / vp
        g = (pop / vg + np.bincount(of, p) / vp) / prec + rng.normal(size=len(g)) / prec**0.5
        prec = 1 / vp + n / vo
        p = (g[of] / vp + n * own / vo) / prec + rng.normal(size=len(n)) / prec**0.5
        vo = PRIOR.draw(rng, n.sum(), within + (n * (own - p) ** 2).sum())
        vp = PRIOR.draw(rng, len(n), ((p - g[of]) ** 2).sum())
        vg = PRIOR.draw(rng, len(g), ((g - pop) ** 2).sum())
        kept.append((pop, vg, vp, vo, *g, *p))
    x = np.array(kept[warmup:])
    keys = [("population_mean", None), ("group_variance", None), ("program_variance", None), ("observation_variance", None), *[("group_mean", k) for k in groups], *[("program_mean", k) for k in names]]
    return {k: (m, s) for k, m, s in zip(keys, x.mean(0), x.std(0))}


def test_the_posterior_is_that_of_program_by_program(spark):
    fitted = M.HierarchicalMean(PRIOR, PRIOR, PRIOR).fit(spark.createDataFrame(programs(), KIND), chains=2, draws=3000, warmup=300)
    got = {(r["param"], r["id"]): (r["mean"], r["std"]) for r in S.mean_std(fitted, ["param", "id"]).collect()}
    want = by_program(programs(), 6000, 300)
    assert got.keys() == want.keys()
    for k, (mean, sd) in want.items():
        assert abs(got[k][0] - mean) < 0.15 * sd and 0.85 < got[k][1] / sd < 1.15, (k, got[k], want[k])


def test_a_fit_has_no_limit_of_its_own(spark):
    rows = spark.createDataFrame(programs(), KIND)
    assert M.HierarchicalMean(PRIOR, PRIOR, PRIOR).fit(rows, draws=10_000_000).columns == ["chain", "draw", "param", "id", "value"]


def test_groups_may_be_joined_instead_of_broadcast(spark, monkeypatch):
    model, rows = M.HierarchicalMean(PRIOR, PRIOR, PRIOR), spark.createDataFrame(programs(), KIND)
    one = sorted(map(tuple, model.fit(rows, chains=2, draws=3, warmup=2).where("id is not null").collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    two = sorted(map(tuple, model.fit(rows.repartition(3), chains=2, draws=3, warmup=2).where("id is not null").collect()))
    assert len(one) == 2 * 3 * (3 + 36) and [r[:4] for r in one] == [r[:4] for r in two] and np.allclose([r[4] for r in one], [r[4] for r in two], rtol=1e-9)
    with pytest.raises(InferenceError, match="observation"):
        model.fit(spark.createDataFrame([("p", "g", float("nan"))], KIND))
    assert model.fit(rows.limit(0)).count() == 0


def test_membership_moves_no_draws(spark):
    rows = spark.createDataFrame(programs(), KIND)
    fitted = M.HierarchicalMean(PRIOR, PRIOR, PRIOR).fit(rows, chains=2, draws=5, warmup=2)
    paths = M.forecast_hierarchy(fitted, rows, 2)
    assert paths.count() == 2 * 5 * 2 * 36
    plan = paths._jdf.queryExecution().executedPlan().toString()
    # between the draws of a program and the join with its group no row changes its task
    assert "ShuffledHashJoin" in plan and "Union" not in plan
    total = S.rollup_paths(paths).where("group_id is null").count()
    assert total == 2 * 5 * 2
