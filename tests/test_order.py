import re

import numpy as np
import pandas as pd
import pytest

from credence.operators import summary as S

KIND = "param string, chain int, draw int, value double"


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(1e6, 1, 5000), "heavy": rng.standard_cauchy(5000), "tied": rng.integers(0, 7, 5000).astype(float), "equal": np.full(5000, 2.5),
        "wide": np.append(rng.normal(size=4999), 1e300), "endless": np.append(rng.normal(size=4998), [np.inf, -np.inf]), None: rng.exponential(size=5000), "one": np.array([3.0]),
    }


@pytest.fixture(scope="module")
def draws(spark, values):
    return spark.createDataFrame([(p, k % 4, k // 4, float(v)) for p, x in values.items() for k, v in enumerate(x)], KIND).repartition(5)


@pytest.mark.parametrize("cell", (2000, 50))
def test_ranks_and_quantiles_do_not_depend_on_cells(draws, values, monkeypatch, cell):
    monkeypatch.setattr(S, "CELL", cell)
    got = {r["param"]: r for r in S.quantiles(draws, (0.05, 0.5, 0.95)).collect()}
    assert got.keys() == values.keys()
    for p, x in values.items():
        assert [got[p][c] for c in ("q_0_05", "q_0_5", "q_0_95")] == pytest.approx([np.quantile(x, q) for q in (0.05, 0.5, 0.95)], rel=1e-12)
    places = S._placed(draws, ["param"]).toPandas()
    scores = S.rank_normalised(draws).toPandas()
    for p, x in values.items():
        mine = places[places["param"].isna() if p is None else places["param"] == p].sort_values("place")
        assert mine["place"].tolist() == list(range(len(x))) and mine["value"].tolist() == sorted(x) and set(mine["n"]) == {len(x)}
        z = scores[scores["param"].isna() if p is None else scores["param"] == p].sort_values(["draw", "chain"])["value"]
        assert z.rank().tolist() == pd.Series(x).rank().tolist() and z.median() == pytest.approx(0, abs=0.5)


def test_no_task_sorts_or_holds_a_parameter(draws):
    """Windows over values are over cells, and no percentile gathers a parameter's values."""
    for made in (S.rank_normalised(draws), S.quantiles(draws, (0.5,)), S.hdi(draws), S.truncating_quantile(draws, 0.9), S.split_r_hat(draws), S.ess_tail(draws)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan
        windows = [line for line in plan.splitlines() if re.search(r"Window \[.*, \[value#\d+ ASC", line)]
        assert windows and all(re.search(r"\], \[[^\]]*cell#\d+L?\], \[value#\d+ ASC", line) for line in windows)


def test_null_values_are_left_out_of_quantiles(spark):
    rows = spark.createDataFrame([("a", 0, 0, None), ("a", 0, 1, 1.0), ("a", 0, 2, 2.0), ("b", 0, 0, None), ("c", 0, 0, float("nan")), ("c", 0, 1, 1.0)], KIND)
    got = {r["param"]: r["q_0_5"] for r in S.quantiles(rows, (0.5,)).collect()}
    assert got["a"] == 1.5 and got["b"] is None and np.isnan(got["c"])
    assert S.quantiles(rows.limit(0), (0.5,)).count() == 0


def test_intervals(draws, values):
    got = {r["param"]: (r["lower"], r["upper"]) for r in S.interval(draws, 0.9).collect()}
    for p in ("normal", None):
        assert got[p] == pytest.approx(tuple(np.quantile(values[p], [0.05, 0.95])), rel=1e-12)
