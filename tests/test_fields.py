import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.operators import fields
from credence.operators import kalman as K
from credence.operators import structural as M

P = M.InverseGammaPrior(3.0, 0.5)


def ragged(rng, lengths):
    ys = [np.cumsum(rng.normal(0, 0.4, n)) + np.sin(np.arange(n)) + rng.normal(0, 0.3, n) for n in lengths]
    for y in ys:
        y[rng.random(len(y)) < 0.2] = np.nan
    return ys


def trend():
    return M.LocalLinearTrend(P, P, P, 1.0, -0.2, 3.0, 2.0, 0.5), lambda a, b, r: K.System(np.array([[1.0, 1], [0, 1]]), np.array([1.0, 0]), np.diag([a, b]), r, np.array([1.0, -0.2]), np.array([[3.0, 0.5], [0.5, 2.0]]))


def season(period):
    effects = tuple(np.sin(2 * np.pi * np.arange(period) / period))
    model = M.SeasonalLocalLevel(period, P, P, P, 2.0, effects, 4.0, 1.5)
    return model, lambda a, b, r: K.seasonal_local_level(period, a, b, r, 2.0, effects, 4.0, 1.5)


@pytest.mark.parametrize("model, system", [trend(), season(2), season(4), season(7), season(12)])
def test_fields_have_the_smoothers_moments(model, system):
    """Means (no noise) and covariances (unit noise, one number at a time) of ragged series in one batch."""
    rng = np.random.default_rng(5)
    ys, variances = ragged(rng, [40, 9, 57]), np.array([[0.3, 0.02, 0.2], [0.01, 0.5, 1.0], [2.0, 0.1, 0.05]])
    grid = fields.Grid(ys, *model._layout())
    field = model._field(grid)
    zero = np.zeros((*grid.shape[:2], grid.size))
    mean = field.draw(variances, zero)
    spread = np.zeros((len(ys), 2, 2))
    for k in range(grid.shape[0]):
        for j in range(grid.size):
            z = zero.copy()
            z[k, :, j] = 1
            moved = field.draw(variances, z) - mean
            for i in range(len(ys)):
                last = grid.places(moved, i)[-1]
                spread[i] += np.outer(last, last)
    for i, y in enumerate(ys):
        s = system(*variances[i])
        f = K.filter_series(s, y)
        sm, sc = K.smooth_series(s, f)
        got = grid.places(mean, i)
        assert got[grid.lead + 1 :, 0] == pytest.approx(sm[:, 0], abs=1e-8) and got[grid.lead + 1 :, 1] == pytest.approx(sm[:, 1], abs=1e-8)
        assert spread[i] == pytest.approx(sc[-1][:2, :2], abs=1e-8)
        assert model._last(got) is not None and (model.NAMES[-1] != "terminal_seasonal" or model._last(got)[1] == pytest.approx(sm[-1][1:], abs=1e-8))


@pytest.mark.parametrize("model", [trend()[0], season(4)[0]])
def test_squares_are_those_of_the_moves(model):
    rng = np.random.default_rng(6)
    ys = ragged(rng, [21, 12])
    grid = fields.Grid(ys, *model._layout())
    x = rng.normal(size=(*grid.shape[:2], grid.size))
    got = model._field(grid).squares(x)
    for i, y in enumerate(ys):
        at, lead, n = grid.places(x, i), grid.lead, len(y)
        level, second, seen = at[lead:, 0], at[:, 1], ~np.isnan(y)
        if model.NAMES[-1] == "terminal_slope":
            want = [np.square(np.diff(level) - second[:-1]).sum(), np.square(np.diff(second)).sum(), np.square(y - level[1:])[seen].sum()]
        else:
            want = [np.square(np.diff(level)).sum(), sum(second[t : t + 4].sum() ** 2 for t in range(n)), np.square(y - level[1:] - second[lead + 1 :])[seen].sum()]
        assert got[i] == pytest.approx(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(8, 60), min_size=1, max_size=5), st.sampled_from([trend()[0], season(2)[0], season(4)[0]]))
def test_a_batch_is_its_series_one_by_one(lengths, model):
    ys = ragged(np.random.default_rng(len(lengths)), lengths)
    for y in ys:
        y[:6] = 1.0
    rngs = lambda: [np.random.default_rng(100 + i) for i in range(len(ys))]
    flat = lambda runs: [np.concatenate([np.ravel(v) for d in run for v in d]) for run in runs]
    one = [flat(model.run([y], 4, 3, 2, [rng]))[0] for y, rng in zip(ys, rngs())]
    for a, b in zip(flat(model.run(ys, 4, 3, 2, rngs())), one):
        assert a == pytest.approx(b, rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("model", [trend()[0], season(4)[0]])
def test_draws_by_field_and_by_filter_agree(model, monkeypatch):
    y = ragged(np.random.default_rng(8), [36])[0]
    means = []
    for ratio in (fields.MOST_RATIO, 0.0):  # the latter leaves every sweep to the filter
        monkeypatch.setattr(fields, "MOST_RATIO", ratio)
        run = model.run([y] * 4, 600, 100, 1, [np.random.default_rng(i) for i in range(4)])
        means.append(np.array([[d[:4] for d in one] for one in run]).mean((0, 1)))
    assert means[0] == pytest.approx(means[1], rel=0.12, abs=0.08)


def test_far_variances_are_left_to_the_filter():
    y = ragged(np.random.default_rng(9), [30])[0] * 1e8
    p = M.InverseGammaPrior(3, 1e-6)
    for model in (M.LocalLinearTrend(p, p, P), M.SeasonalLocalLevel(4, p, p, P)):
        got = model.run([y], 5, 5, 1, [np.random.default_rng(1)])[0]
        assert np.isfinite(np.concatenate([np.ravel(v) for d in got for v in d])).all()


def test_starts_must_be_uncertain():
    for model in (M.LocalLinearTrend(P, P, P, initial_slope_variance=0.0), M.SeasonalLocalLevel(4, P, P, P, initial_level_variance=0.0)):
        with pytest.raises(K.StateSpaceError):
            model.run([np.arange(12.0)], 2, 0, 1, [np.random.default_rng(1)])


def test_fits_do_not_depend_on_partitions_or_neighbours(spark, monkeypatch):
    rows = [(f"s{k}", t, None if (t + k) % 9 == 0 else math.sin(t + k) + 0.1 * t) for k in range(5) for t in range(20 + 7 * k)]
    series = spark.createDataFrame(rows, "series_id string, t int, y double")
    model = M.SeasonalLocalLevel(4, P, P, P)
    columns = lambda f: {(r.series_id, r.chain, r.draw): [*r[3:7], *r[7]] for r in f.collect()}
    want = columns(M.fit(series, model, chains=2, draws=6, warmup=4, thin=2))
    assert len(want) == 60
    again = columns(M.fit(series.repartition(7).where("series_id > 's1'"), model, chains=2, draws=6, warmup=4, thin=2))
    assert set(again) == {k for k in want if k[0] > "s1"}
    for k, v in again.items():
        assert v == pytest.approx(want[k], rel=1e-7)


def test_series_cross_frames_and_bounds(monkeypatch):
    """A series over several frames is one; frames may be empty; chains are apart."""
    rows = pd.DataFrame([(f"s{k}", c, t, float(t + k)) for k in range(3) for c in range(2) for t in range(5)], columns=["series_id", "chain", "t", "y"])
    for step in (1, 3, 7, 30):
        frames = [rows.iloc[:0], *(rows.iloc[a : a + step] for a in range(0, len(rows), step))]
        got = list(M._elements(frames))
        assert [(n, c) for n, c, _ in got] == [(f"s{k}", c) for k in range(3) for c in range(2)]
        assert all(y.tolist() == [int(n[1]) + t for t in range(5)] for n, _, y in got)
    assert list(M._elements([])) == []


def test_small_batches_and_no_series(spark, monkeypatch):
    series = spark.createDataFrame([(f"s{k}", t, float(t % 3)) for k in range(3) for t in range(12)], "series_id string, t int, y double")
    assert M.fit(series.where(F.lit(False)), M.LocalLinearTrend(P, P, P), draws=2, warmup=1).count() == 0
    assert M.fit(series, M.LocalLinearTrend(P, P, P), chains=2, draws=2, warmup=1).count() == 12
    assert M.fit(series.withColumn("extra", F.lit(1)), M.LocalLevel(P, P), chains=2, draws=2, warmup=1).count() == 12
