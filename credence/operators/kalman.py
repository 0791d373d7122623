"""Linear Gaussian state-space models: filter, smoother, forecast, simulation.

``System`` holds the fixed matrices.  A transition happens before the first observation.  Null
observations are missing: predict only.  Local-level summaries that need only the last state are a
fold over a sorted array in the JVM; everything else runs one group per series in numpy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import inv_normal


class StateSpaceError(ValueError):
    """A system or series that can't be used."""


@dataclass(frozen=True)
class System:
    """transition T, observation H (a row), process covariance Q, observation variance R, and the
    state's mean and covariance one step before the first observation."""

    transition: np.ndarray
    observation: np.ndarray
    process: np.ndarray
    noise: float
    mean: np.ndarray
    covariance: np.ndarray

    def __post_init__(self):
        d = len(self.mean)
        shapes = [(self.transition, (d, d)), (self.observation, (d,)), (self.process, (d, d)), (self.covariance, (d, d))]
        if any(np.shape(m) != s for m, s in shapes):
            raise StateSpaceError("the matrices' shapes don't fit the state")
        if not all(np.isfinite(m).all() for m, _ in shapes) or not np.isfinite(self.mean).all():
            raise StateSpaceError("the system must be finite")
        if not self.noise > 0 or not math.isfinite(self.noise):
            raise StateSpaceError("observation variance must be positive")
        for m, name, positive in ((self.process, "process covariance", False), (self.covariance, "initial covariance", True)):
            scale = max(1.0, float(np.abs(m).max()))
            if np.abs(m - m.T).max() > 1e-10 * scale:
                raise StateSpaceError(f"{name} must be symmetric")
            least = float(np.linalg.eigvalsh(m).min())
            if least < -1e-12 * scale or positive and least <= 0:
                raise StateSpaceError(f"{name} must be positive {'definite' if positive else 'semidefinite'}")

    @property
    def dimension(self) -> int:
        return len(self.mean)


def _system(t, h, q, r, m, p) -> System:
    return System(*(np.array(x, float) for x in (t, h, q)), float(r), np.array(m, float), np.array(p, float))


def local_level(process_variance, observation_variance, initial_mean=0.0, initial_variance=1.0) -> System:
    return _system([[1]], [1], [[process_variance]], observation_variance, [initial_mean], [[initial_variance]])


def local_linear_trend(level_variance, trend_variance, observation_variance, initial_level=0.0, initial_trend=0.0, initial_level_variance=1.0, initial_trend_variance=1.0) -> System:
    return _system([[1, 1], [0, 1]], [1, 0], np.diag([level_variance, trend_variance]), observation_variance, [initial_level, initial_trend], np.diag([initial_level_variance, initial_trend_variance]))


def seasonal_local_level(period, level_variance, seasonal_variance, observation_variance, initial_level=0.0, initial_seasonal_effects=None, initial_level_variance=1.0, initial_seasonal_variance=1.0) -> System:
    """Level and ``period - 1`` seasonal states; the effects of a cycle sum to about 0.  Effects are
    those of the first cycle's steps and must sum to 0."""
    if period < 2:
        raise StateSpaceError("period must be 2 or more")
    effects = [0.0] * period if initial_seasonal_effects is None else list(map(float, initial_seasonal_effects))
    if len(effects) != period or abs(sum(effects)) > 1e-8 * max(1.0, max(map(abs, effects))):
        raise StateSpaceError("seasonal effects must be one for each step of the period and sum to 0")
    t = np.zeros((period, period))
    t[0, 0] = 1
    t[1, 1:] = -1
    for k in range(2, period):
        t[k, k - 1] = 1
    h = np.zeros(period)
    h[:2] = 1
    mean = [initial_level, *(effects[period - k] for k in range(1, period))]
    return _system(t, h, np.diag([level_variance, seasonal_variance, *[0] * (period - 2)]), observation_variance, mean, np.diag([initial_level_variance, *[initial_seasonal_variance] * (period - 1)]))


def stationary_ar1(coefficient, process_variance, observation_variance) -> System:
    if not abs(coefficient) < 1 or not process_variance > 0:
        raise StateSpaceError("the coefficient must lie within (-1, 1) and the process variance be positive")
    return _system([[coefficient]], [1], [[process_variance]], observation_variance, [0], [[process_variance / (1 - coefficient**2)]])


# --- numpy kernels --------------------------------------------------------------------------------


def _filter_scalar(s: System, y: np.ndarray) -> dict[str, np.ndarray]:
    """The filter of a state of one dimension, in plain numbers."""
    a, h, q, r = float(s.transition[0, 0]), float(s.observation[0]), float(s.process[0, 0]), s.noise
    m, p, rows = float(s.mean[0]), float(s.covariance[0, 0]), []
    for v in y.tolist():
        m = pm = a * m
        p = pp = a * p * a + q
        ll = 0.0
        if v == v:
            var = h * p * h + r
            gain, miss = p * h / var, v - h * m
            ll = -0.5 * (math.log(2 * math.pi * var) + miss * miss / var)
            m, p = m + gain * miss, (1 - gain * h) ** 2 * p + r * gain * gain
        rows.append((pm, pp, m, p, ll))
    pm, pp, fm, fp, ll = np.array(rows, float).reshape(-1, 5).T
    return {"pm": pm[:, None], "pc": pp[:, None, None], "fm": fm[:, None], "fc": fp[:, None, None], "ll": ll}


def _smooth_scalar(s: System, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a = float(s.transition[0, 0])
    pm, pc, fm, fc = (f[k].ravel().tolist() for k in ("pm", "pc", "fm", "fc"))
    sm, sc = fm.copy(), fc.copy()
    for t in range(len(sm) - 2, -1, -1):
        back = a * fc[t] / pc[t + 1]
        sm[t] = fm[t] + back * (sm[t + 1] - pm[t + 1])
        sc[t] = fc[t] + back * (sc[t + 1] - pc[t + 1]) * back
    return np.array(sm)[:, None], np.array(sc)[:, None, None]


def filter_series(s: System, y: np.ndarray) -> dict[str, np.ndarray]:
    n, d = len(y), s.dimension
    if d == 1:
        return _filter_scalar(s, y)
    pm, pc, fm, fc, ll = np.empty((n, d)), np.empty((n, d, d)), np.empty((n, d)), np.empty((n, d, d)), np.zeros(n)
    m, p, eye = s.mean, s.covariance, np.eye(d)
    for t in range(n):
        m = s.transition @ m
        p = s.transition @ p @ s.transition.T + s.process
        p = (p + p.T) / 2
        pm[t], pc[t] = m, p
        if not math.isnan(y[t]):
            ph = p @ s.observation
            var = s.observation @ ph + s.noise
            gain, miss = ph / var, y[t] - s.observation @ m
            ll[t] = -0.5 * (math.log(2 * math.pi * var) + miss * miss / var)
            m = m + gain * miss
            a = eye - np.outer(gain, s.observation)
            p = a @ p @ a.T + s.noise * np.outer(gain, gain)
            p = (p + p.T) / 2
        fm[t], fc[t] = m, p
    return {"pm": pm, "pc": pc, "fm": fm, "fc": fc, "ll": ll}


def smooth_series(s: System, f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if s.dimension == 1:
        return _smooth_scalar(s, f)
    sm, sc = f["fm"].copy(), f["fc"].copy()
    for t in range(len(sm) - 2, -1, -1):
        back = np.linalg.solve(f["pc"][t + 1], s.transition @ f["fc"][t]).T
        sm[t] = f["fm"][t] + back @ (sm[t + 1] - f["pm"][t + 1])
        c = f["fc"][t] + back @ (sc[t + 1] - f["pc"][t + 1]) @ back.T
        sc[t] = (c + c.T) / 2
    return sm, sc


def forecast_series(s: System, mean: np.ndarray, covariance: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Observation means, their joint covariance, and the states' moments."""
    m, p, means, covs, states, cross = mean, covariance, [], np.zeros((steps, steps)), [], []
    for k in range(steps):
        m = s.transition @ m
        p = s.transition @ p @ s.transition.T + s.process
        states.append(m)
        cross.append(p)
        means.append(s.observation @ m)
    for i in range(steps):
        moved = cross[i] @ s.observation
        for j in range(i, steps):
            covs[i, j] = covs[j, i] = s.observation @ moved
            moved = s.transition @ moved
        covs[i, i] += s.noise
    return np.array(means), covs, states, cross


def psd_factor(m: np.ndarray) -> np.ndarray:
    """A factor L with L Lᵀ = m for a semidefinite matrix; directions below 1e-12 of the scale are 0."""
    m = (m + m.T) / 2
    values, vectors = np.linalg.eigh(m)
    if values.min(initial=0) < -1e-10 * max(1.0, np.abs(m).max()):
        raise StateSpaceError("a covariance isn't positive semidefinite")
    return vectors * np.sqrt(np.where(values > 1e-12 * max(1.0, np.abs(m).max()), values, 0))


def draw_states(s: System, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw of the states before the first observation (row 0) and at each (rows 1 to T): forward
    filter, backward sampling."""
    f = filter_series(s, y)
    fm = np.concatenate([s.mean[None], f["fm"]])
    fc = np.concatenate([s.covariance[None], f["fc"]])
    n, d = len(y), s.dimension
    out = np.empty((n + 1, d))
    out[n] = fm[n] + psd_factor(fc[n]) @ rng.standard_normal(d)
    for t in range(n - 1, -1, -1):
        pc = f["pc"][t]
        back = np.linalg.solve(pc, s.transition @ fc[t]).T
        mean = fm[t] + back @ (out[t + 1] - f["pm"][t])
        a = np.eye(d) - back @ s.transition
        cov = a @ fc[t] @ a.T + back @ s.process @ back.T
        out[t] = mean + psd_factor(cov) @ rng.standard_normal(d)
    return out


# --- over DataFrames (series_id, t, y) ----------------------------------------------------------------


def _values(pdf: pd.DataFrame) -> np.ndarray:
    y = pdf.sort_values("t")["y"].to_numpy(dtype=float)
    if np.isinf(y).any():
        raise StateSpaceError("observations must be finite or missing")
    return y


def kalman_filter(series: DataFrame, s: System, smooth: bool = False) -> DataFrame:
    """Filtered (and smoothed) moments and log-likelihood of each step; covariances row by row."""
    extra = ", smoothed_mean array<double>, smoothed_cov array<double>" if smooth else ""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        f = filter_series(s, _values(pdf))
        flat = lambda a: list(a.reshape(len(a), -1))
        out = pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "t": pdf["t"].to_numpy(), "predicted_mean": flat(f["pm"]), "predicted_cov": flat(f["pc"]), "filtered_mean": flat(f["fm"]), "filtered_cov": flat(f["fc"]), "loglik": f["ll"]})
        if smooth:
            sm, sc = smooth_series(s, f)
            out["smoothed_mean"], out["smoothed_cov"] = flat(sm), flat(sc)
        return out

    return series.select("series_id", "t", "y").groupBy("series_id").applyInPandas(run, f"series_id string, t int, predicted_mean array<double>, predicted_cov array<double>, filtered_mean array<double>, filtered_cov array<double>, loglik double{extra}")


def forecast_joint(series: DataFrame, s: System, steps: int) -> DataFrame:
    """(series_id, step, obs_mean, obs_cov): obs_cov is the step's row of the joint covariance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _values(pdf)
        f = filter_series(s, y)
        mean, cov, _, _ = forecast_series(s, f["fm"][-1] if len(y) else s.mean, f["fc"][-1] if len(y) else s.covariance, steps)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "step": np.arange(1, steps + 1), "obs_mean": mean, "obs_cov": list(cov)})

    return series.select("series_id", "t", "y").groupBy("series_id").applyInPandas(run, "series_id string, step int, obs_mean double, obs_cov array<double>")


def with_cumulative(joint: DataFrame) -> DataFrame:
    """obs_var, cum_mean and cum_var: the variance of a sum counts each covariance twice."""
    order = Window.partitionBy("series_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    own = F.element_at("obs_cov", F.col("step"))
    before = F.aggregate(F.slice("obs_cov", 1, F.col("step")), F.lit(0.0), lambda a, x: a + x)
    return joint.select("series_id", "step", "obs_mean", own.alias("obs_var"), F.sum("obs_mean").over(order).alias("cum_mean"), F.sum(2 * before - own).over(order).alias("cum_var"))


def gaussian_interval(df: DataFrame, mean: str, var: str, level: float = 0.95) -> DataFrame:
    if not 0 < level < 1:
        raise StateSpaceError("level must lie between 0 and 1")
    z = inv_normal(0.5 + level / 2)
    half = F.lit(z) * F.sqrt(var)
    return df.withColumn("lower", F.col(mean) - half).withColumn("upper", F.col(mean) + half)


# --- one-dimensional systems in the JVM -----------------------------------------------------------


def scalar_last(series: DataFrame, transition: float, process: float, noise: float, mean: float, variance: float) -> DataFrame:
    """(series_id, m, p, loglik, n): the last filtered moments of one-dimensional systems."""
    start = F.struct(F.lit(float(mean)).alias("m"), F.lit(float(variance)).alias("p"), F.lit(0.0).alias("ll"))

    def step(state: Column, x: Column) -> Column:
        m, p = F.lit(float(transition)) * state["m"], F.lit(float(transition) ** 2) * state["p"] + F.lit(float(process))
        var = p + F.lit(float(noise))
        gain, miss = p / var, x["y"] - m
        rest = F.lit(1.0) - gain
        seen = F.struct(
            (m + gain * miss).alias("m"), (rest * rest * p + gain * gain * F.lit(float(noise))).alias("p"),
            (state["ll"] - F.lit(0.5) * (F.lit(math.log(2 * math.pi)) + F.log(var) + miss * miss / var)).alias("ll"),
        )
        return F.when(x["y"].isNull() | F.isnan(x["y"]), F.struct(m.alias("m"), p.alias("p"), state["ll"].alias("ll"))).otherwise(seen)

    folded = series.groupBy("series_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("t", "y"))), start, step).alias("s"), F.count("*").alias("n"))
    return folded.select("series_id", F.col("s.m").alias("m"), F.col("s.p").alias("p"), F.col("s.ll").alias("loglik"), "n")


def scalar_forecast(last: DataFrame, transition: float, process: float, noise: float, steps: int) -> DataFrame:
    """Moments of ``steps`` observations from (series_id, m, p), in closed form, with their running sums."""
    a = float(transition)
    grid = last.select("series_id", "m", "p", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    k = F.col("step").cast("double")
    if a == 1.0:
        power, grown = F.lit(1.0), k * process
    else:
        power = F.pow(F.lit(a), k)
        grown = F.lit(float(process)) * (1 - power * power) / F.lit(1 - a * a)
    grid = grid.withColumn("obs_mean", power * F.col("m")).withColumn("state_var", power * power * F.col("p") + grown)
    grid = grid.withColumn("obs_var", F.col("state_var") + float(noise))
    # cov(i, k) = a^(k-i) var(i) for i < k
    order = Window.partitionBy("series_id").orderBy("step")
    earlier = F.sum(F.col("state_var") * F.pow(F.lit(a), -k)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("added", F.col("obs_var") + 2 * F.coalesce(F.pow(F.lit(a), k) * earlier, F.lit(0.0)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("series_id", "step", "obs_mean", "obs_var", F.sum("obs_mean").over(upto).alias("cum_mean"), F.sum("added").over(upto).alias("cum_var"))
