"""Fitted series models: local level, seasonal, trend (Gibbs with forward filter, backward sampling),
exact autoregression, and the hierarchy of means.

A task steps the chains of many series together and reads them one after another from its sorted rows;
what leaves it are variances and the last state.  Forecast paths are expressions over draws and steps
with counter-based normals, so they need no group.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal, split_mix
from ..plans.model import InferenceError
from . import fields, kalman
from .kalman import StateSpaceError
from .series import hierarchy_sums

FIT, FORECAST = 0x46495421, 0x46435354  # domains of the seeds


@dataclass(frozen=True)
class InverseGammaPrior:
    """Density ∝ x^(-shape - 1) exp(-scale / x)."""

    shape: float
    scale: float

    def __post_init__(self):
        if not (self.shape > 0 and self.scale > 0 and math.isfinite(self.shape) and math.isfinite(self.scale)):
            raise StateSpaceError("shape and scale must be positive and finite")

    @property
    def mode(self) -> float:
        return self.scale / (self.shape + 1)

    def draw(self, rng: np.random.Generator, n: float, squares: float) -> float:
        """From the posterior after ``n`` normal residuals with this sum of squares."""
        return 1 / rng.gamma(self.shape + n / 2, 1 / (self.scale + squares / 2))


def _rng(seed: int, series: str, chain: int, domain: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox([split_mix(seed, chain, domain), zlib.crc32(series.encode())]))


#: Values that a fit may retain for a series, and a forecast for a draw table, unless told otherwise.
MOST_RETAINED, MOST_FORECAST = 50_000_000, 25_000_000
#: Draws of groups that each task of a hierarchy may be given; more are joined.
MOST_BROADCAST = 500_000


def check_size(values: int, most: int, what: str) -> None:
    """Refuse a run that would make more values than ``most``; give another limit where the cluster is up to it."""
    if values > most:
        raise StateSpaceError(f"{what} would hold {values} values; the limit is {most}")


def _check_run(chains: int, draws: int, warmup: int = 0, thin: int = 1) -> None:
    if min(chains, draws, thin) < 1 or warmup < 0:
        raise StateSpaceError("chains, draws and thin must be 1 or more")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _chains(series: DataFrame, chains: int) -> DataFrame:
    return series.select("*", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))


# --- scalar local level, vectorised draws -------------------------------------------------------------


def _level_states(y, q, r, m0, p0, rng):
    """One draw of x[-1] to x[T-1] of a local level."""
    n = len(y)
    m, p = np.empty(n + 1), np.empty(n + 1)
    m[0], p[0] = m0, p0
    a, b = m0, p0
    for t, v in enumerate(y.tolist()):
        b = b + q
        if v == v:
            k = b / (b + r)
            a = a + k * (v - a)
            b = (1 - k) ** 2 * b + k * k * r
        m[t + 1], p[t + 1] = a, b
    z = rng.standard_normal(n + 1)
    x = np.empty(n + 1)
    x[n] = now = m[n] + math.sqrt(p[n]) * z[n]
    back = p / (p + q)
    spread = np.sqrt(p * (1 - back))
    for t in range(n - 1, -1, -1):
        now = m[t] + back[t] * (now - m[t]) + spread[t] * z[t]
        x[t] = now
    return x


@dataclass(frozen=True)
class LocalLevel:
    process_variance_prior: InverseGammaPrior
    observation_variance_prior: InverseGammaPrior
    initial_mean: float = 0.0
    initial_variance: float = 100.0

    NAMES = ("process_variance", "observation_variance", "terminal_level")

    def check(self, y: np.ndarray) -> None:
        if np.isfinite(y).sum() < 2:
            raise StateSpaceError("a local level needs two observations")

    def values(self, n: int) -> int:
        return n

    def run(self, ys, draws, warmup, thin, rngs):
        # one number a step: plain arithmetic is as fast for one chain as arrays are for many
        return [self.chain(y, draws, warmup, thin, rng) for y, rng in zip(ys, rngs)]

    def chain(self, y, draws, warmup, thin, rng):
        q, r = self.process_variance_prior.mode, self.observation_variance_prior.mode
        seen, out = ~np.isnan(y), []
        for i in range(warmup + draws * thin):
            x = _level_states(y, q, r, self.initial_mean, self.initial_variance, rng)
            q = self.process_variance_prior.draw(rng, len(y), float(np.square(np.diff(x)).sum()))
            r = self.observation_variance_prior.draw(rng, seen.sum(), float(np.square(y[seen] - x[1:][seen]).sum()))
            if i >= warmup and (i + 1 - warmup) % thin == 0:
                out.append((q, r, x[-1]))
        return out


class _TwoStates:
    """Gibbs chains of models with two states a step, stepped together for many series.

    A model gives its grid, field, priors, and the draw by filtering that takes over where its variances
    lie too far apart for the field's digits (both draw from the same distribution)."""

    def values(self, n: int) -> int:
        """Numbers in one matrix of the field, by which batches are bounded."""
        width, lead = self._layout()
        return -(-(lead + n + 1) // width) * 4 * width * width

    def run(self, ys, draws, warmup, thin, rngs):
        """For each series the kept draws: variances and last states."""
        grid = fields.Grid(ys, *self._layout())
        field, priors = self._field(grid), self._priors()
        variances = np.tile([p.mode for p in priors], (len(ys), 1))
        counts = [(len(y), len(y), int((~np.isnan(y)).sum())) for y in ys]
        out = [[] for _ in ys]
        for i in range(warmup + draws * thin):
            fit = variances.max(1) <= fields.MOST_RATIO * variances.min(1)
            z = np.zeros((*grid.shape[:2], grid.size))
            for e in np.flatnonzero(fit):
                z[:, e] = grid.normals(e, rngs[e])
            x = field.draw(np.where(fit[:, None], variances, 1.0), z) if fit.any() else z
            for e in np.flatnonzero(~fit):
                grid.put(x, e, self._filtered(ys[e], variances[e], rngs[e]))
            squares = field.squares(x)
            for e, rng in enumerate(rngs):
                variances[e] = [p.draw(rng, n, s) for p, n, s in zip(priors, counts[e], squares[e].tolist())]
                if i >= warmup and (i + 1 - warmup) % thin == 0:
                    out[e].append((*variances[e].tolist(), *self._last(grid.places(x, e))))
        return out

    def _field(self, grid: fields.Grid) -> fields.Field:
        start = self._system()
        return fields.Field([*map(grid.move, self._moves()), grid.observe(self._observed())], *grid.base(*self._first(start.covariance, start.mean)))


@dataclass(frozen=True)
class LocalLinearTrend(_TwoStates):
    level_variance_prior: InverseGammaPrior
    slope_variance_prior: InverseGammaPrior
    observation_variance_prior: InverseGammaPrior
    initial_level: float = 0.0
    initial_slope: float = 0.0
    initial_level_variance: float = 100.0
    initial_slope_variance: float = 10.0
    initial_level_slope_covariance: float = 0.0

    NAMES = ("level_variance", "slope_variance", "observation_variance", "terminal_level", "terminal_slope")

    def check(self, y: np.ndarray) -> None:
        if np.isfinite(y).sum() < 3:
            raise StateSpaceError("a trend needs three observations")

    def _layout(self):
        return 8, 0

    def _priors(self):
        return self.level_variance_prior, self.slope_variance_prior, self.observation_variance_prior

    def _moves(self):
        return [(0, 0, 1.0), (1, 0, -1.0), (1, 1, -1.0)], [(0, 1, 1.0), (1, 1, -1.0)]

    def _observed(self):
        return [(0, 0, 1.0)]

    def _system(self, a=1.0, b=1.0, r=1.0):
        c = self.initial_level_slope_covariance
        covariance = np.array([[self.initial_level_variance, c], [c, self.initial_slope_variance]], float)
        return kalman.System(np.array([[1.0, 1], [0, 1]]), np.array([1.0, 0]), np.diag([a, b]), r, np.array([self.initial_level, self.initial_slope], float), covariance)

    def _first(self, covariance, mean):
        return np.linalg.inv(covariance), mean

    def _filtered(self, y, variances, rng):
        return kalman.draw_states(self._system(*variances), y, rng)

    def _last(self, places):
        return places[-1].tolist()


@dataclass(frozen=True)
class SeasonalLocalLevel(_TwoStates):
    """Level and season of a step are the two states of its place; the season's moves reach back a period,
    so blocks are a period wide.  A sweep costs T s² either way: in the filter, too, whose predictions move
    rows and columns instead of multiplying matrices."""

    period: int
    level_variance_prior: InverseGammaPrior
    seasonal_variance_prior: InverseGammaPrior
    observation_variance_prior: InverseGammaPrior
    initial_level: float = 0.0
    initial_seasonal_effects: tuple | None = None
    initial_level_variance: float = 100.0
    initial_seasonal_variance: float = 10.0

    NAMES = ("level_variance", "seasonal_variance", "observation_variance", "terminal_level", "terminal_seasonal")

    def check(self, y: np.ndarray) -> None:
        if len(y) < 2 * self.period or np.isfinite(y).sum() < self.period + 2:
            raise StateSpaceError("a seasonal level needs two cycles, and observations for one and two more")

    @staticmethod
    def _moved(m):
        """T m for a vector, or T applied to the rows of a matrix."""
        out = np.empty_like(m)
        out[0] = m[0]
        out[1] = -m[1:].sum(0)
        out[2:] = m[1:-1]
        return out

    def _states(self, y, a, b, r, start, rng):
        """One draw of the states by simulation smoothing: simulate, filter the difference, smooth backwards.

        Backward sampling needs a solve for each step; the smoother's adjoint recursion needs none."""
        n, d = len(y), self.period
        p0 = np.concatenate([[start.covariance[0, 0]], np.diag(start.covariance)[1:]])
        # a path of the model from mean 0, and what it would be observed as
        fake = np.empty((n + 1, d))
        fake[0] = np.sqrt(p0) * rng.standard_normal(d)
        shocks = rng.standard_normal((n, 2)) * np.sqrt([a, b])
        for t in range(n):
            fake[t + 1] = self._moved(fake[t])
            fake[t + 1, :2] += shocks[t]
        target = y - fake[1:, 0] - fake[1:, 1] - math.sqrt(r) * rng.standard_normal(n)
        m, p = start.mean.astype(float), np.diag(p0)
        gains, misses, scales = np.zeros((n, d)), np.zeros(n), np.zeros(n)
        for t in range(n):
            m = self._moved(m)
            p = self._moved(self._moved(p).T)
            p[0, 0] += a
            p[1, 1] += b
            if target[t] == target[t]:
                ph = p[:, 0] + p[:, 1]
                f = ph[0] + ph[1] + r
                miss = target[t] - m[0] - m[1]
                m = m + ph * (miss / f)
                p = p - np.outer(ph, ph / f)
                gains[t], misses[t], scales[t] = ph / f, miss, f
        # adjoint of the filter, then states forward from smoothed shocks
        lam, adj = np.zeros(d), np.empty((n, d))
        for t in range(n - 1, -1, -1):
            if scales[t]:
                e = misses[t] / scales[t] - gains[t] @ lam
                lam = lam.copy()
                lam[:2] += e
            adj[t] = lam
            back = np.empty(d)  # Tᵀ lam
            back[0] = lam[0]
            back[1:] = -lam[1]
            back[1:-1] += lam[2:]
            lam = back
        x = np.empty((n + 1, d))
        x[0] = start.mean + p0 * lam
        for t in range(n):
            x[t + 1] = self._moved(x[t])
            x[t + 1, 0] += a * adj[t, 0]
            x[t + 1, 1] += b * adj[t, 1]
        return x + fake

    def _layout(self):
        return max(self.period, 8), self.period - 2

    def _priors(self):
        return self.level_variance_prior, self.seasonal_variance_prior, self.observation_variance_prior

    def _moves(self):
        return [(0, 0, 1.0), (1, 0, -1.0)], [(j, 1, 1.0) for j in range(self.period)]

    def _observed(self):
        return [(0, 0, 1.0), (0, 1, 1.0)]

    def _system(self, a=1.0, b=1.0, r=1.0):
        return kalman.seasonal_local_level(self.period, a, b, r, self.initial_level, self.initial_seasonal_effects, self.initial_level_variance, self.initial_seasonal_variance)

    def _first(self, covariance, mean):
        """Seasons stand from the oldest on at the first places; the level is known at the last of them alone."""
        n, variances = self.period - 1, np.diag(covariance)
        precision, first = np.zeros(2 * n), np.zeros(2 * n)
        precision[1::2], first[1::2] = 1 / variances[:0:-1], mean[:0:-1]
        precision[-2], first[-2] = 1 / variances[0], mean[0]
        return np.diag(precision), first

    def _filtered(self, y, variances, rng):
        x = self._states(y, *variances, self._system(*variances), rng)
        places = np.zeros((self.period - 2 + len(x), 2))
        places[self.period - 2 :, 0], places[self.period - 1 :, 1] = x[:, 0], x[1:, 1]
        places[: self.period - 1, 1] = x[0, :0:-1]
        return places

    def _last(self, places):
        return places[-1, 0], places[: -self.period : -1, 1].tolist()


#: Numbers in one matrix of a batch of chains; about ten such matrices are held.
MOST_BATCH = 1_000_000


def _elements(frames):
    """(series, chain, observations) one after another, from frames of rows sorted by series, chain and time."""
    key, parts = None, []
    for pdf in frames:
        names, chains = pdf["series_id"].to_numpy(object), pdf["chain"].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (chains[1:] != chains[:-1])) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if key != (names[a], chains[a]):
                if parts:
                    yield *key, kalman._values(pd.concat(parts))
                key, parts = (names[a], chains[a]), []
            parts.append(pdf.iloc[a:b])
    if parts:
        yield *key, kalman._values(pd.concat(parts))


def fit(series: DataFrame, model, chains=4, draws=1000, warmup=500, thin=1, seed=42, most=MOST_RETAINED) -> DataFrame:
    """Draws (series_id, chain, draw, variances, last states) of a structural model for every series."""
    _check_run(chains, draws, warmup, thin)
    check_size(chains * draws * len(model.NAMES), most, "a series' draws")
    kind = lambda n: "array<double>" if n == "terminal_seasonal" else "double"

    def together(batch):
        got = model.run([y for _, _, y in batch], draws, warmup, thin, [_rng(seed, name, int(chain), FIT) for name, chain, _ in batch])
        for (name, chain, _), kept in zip(batch, got):
            out = pd.DataFrame(kept, columns=list(model.NAMES))
            out.insert(0, "draw", np.arange(draws))
            out.insert(0, "chain", chain)
            out.insert(0, "series_id", name)
            yield out

    def run(frames):
        batch, held = [], 0
        for element in _elements(frames):
            model.check(element[2])
            values = model.values(len(element[2]))
            if batch and held + values > MOST_BATCH:
                yield from together(batch)
                batch, held = [], 0
            batch.append(element)
            held += values
        if batch:
            yield from together(batch)

    columns = ", ".join(f"{n} {kind(n)}" for n in model.NAMES)
    # a chain costs far more than its rows: ranges, which a sample of the rows balances, leave no task with several chains while others have none
    dealt = _chains(series.select("series_id", "t", "y"), chains).repartitionByRange(_tasks(series), "series_id", "chain")
    return dealt.sortWithinPartitions("series_id", "chain", "t").mapInPandas(run, f"series_id string, chain int, draw int, {columns}")


def _check_steps(fitted: DataFrame, steps: int, most: int | None) -> None:
    """With a limit, a fit's draws are counted first: those of one series, or of all programs of a hierarchy."""
    if steps < 1:
        raise StateSpaceError("steps must be 1 or more")
    if most is not None:
        rows = fitted.groupBy(*[c for c in ("series_id",) if c in fitted.columns]).count().agg(F.max("count")).first()[0] or 0
        check_size(rows * steps, most, "a forecast")


def _steps(fitted: DataFrame, steps: int, most: int | None = None) -> DataFrame:
    _check_steps(fitted, steps, most)
    return fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))


def _path() -> Window:
    return Window.partitionBy("series_id", "chain", "draw").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)


def _noise(seed: int, name: str):
    return normal(seed ^ FORECAST, F.lit(name), "series_id", "chain", "draw", "step")


def _with_cumulative(paths: DataFrame, *columns: str) -> DataFrame:
    """Running sums of observations; a path that isn't finite is an error."""
    value = F.when(F.isnan("observation") | (F.abs("observation") == float("inf")), F.raise_error(F.lit("a forecast path is not finite"))).otherwise(F.col("observation"))
    paths = paths.withColumn("observation", value.cast("double"))
    return paths.select("series_id", "chain", "draw", "step", *columns, "observation", F.sum("observation").over(_path()).alias("cumulative"))


def forecast_local_level(fitted: DataFrame, steps: int, seed=43, most: int | None = None) -> DataFrame:
    paths = _steps(fitted, steps, most).withColumn("level", F.col("terminal_level") + F.sum(F.sqrt("process_variance") * _noise(seed, "level")).over(_path()))
    return _with_cumulative(paths.withColumn("observation", F.col("level") + F.sqrt("observation_variance") * _noise(seed, "obs")), "level")


def forecast_trend(fitted: DataFrame, steps: int, seed=43, most: int | None = None) -> DataFrame:
    """The level moves with the slope before its step."""
    paths = _steps(fitted, steps, most).withColumn("slope", F.col("terminal_slope") + F.sum(F.sqrt("slope_variance") * _noise(seed, "slope")).over(_path()))
    before = F.coalesce(F.lag("slope").over(Window.partitionBy("series_id", "chain", "draw").orderBy("step")), F.col("terminal_slope"))
    paths = paths.withColumn("move", before + F.sqrt("level_variance") * _noise(seed, "level")).withColumn("level", F.col("terminal_level") + F.sum("move").over(_path()))
    return _with_cumulative(paths.withColumn("observation", F.col("level") + F.sqrt("observation_variance") * _noise(seed, "obs")), "level", "slope")


def forecast_seasonal(fitted: DataFrame, steps: int, seed=43, most: int | None = None) -> DataFrame:
    """The seasonal states of a draw are an array that is folded over the steps' shocks, once for each draw."""
    _check_steps(fitted, steps, most)
    kinds = {"seasonal": ("season", "seasonal_variance"), "level": ("level", "level_variance"), "seen": ("obs", "observation_variance")}
    one = lambda name, variance, k: F.sqrt(variance) * normal(seed ^ FORECAST, F.lit(name), "series_id", "chain", "draw", k)
    shocks = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.struct(*[one(*of, k).alias(to) for to, of in kinds.items()]))
    start = F.struct(F.col("terminal_level").alias("level"), F.col("terminal_seasonal").alias("states"), F.array().cast("array<struct<level:double,seasonal:double,observation:double>>").alias("out"))

    def move(state, shock):
        # the season's new effect is put in front first, so that it is worked out once and read from there
        states = F.concat(F.array(-F.aggregate(state["states"], F.lit(0.0), lambda a, v: a + v) + shock["seasonal"]), state["states"])
        return F.struct((state["level"] + shock["level"]).alias("level"), states.alias("states"), state["out"].alias("out"))

    def tell(state, shock):
        now = state["states"][0]
        told = F.struct(state["level"].alias("level"), now.alias("seasonal"), (state["level"] + now + shock["seen"]).alias("observation"))
        return F.struct(state["level"].alias("level"), F.slice(state["states"], F.lit(1), F.size(state["states"]) - 1).alias("states"), F.concat(state["out"], F.array(told)).alias("out"))

    path = F.aggregate(shocks, start, lambda state, shock: F.transform(F.array(move(state, shock)), lambda moved: tell(moved, shock))[0])["out"]
    paths = fitted.select("series_id", "chain", "draw", F.posexplode(path).alias("at", "x"))
    return _with_cumulative(paths.select("series_id", "chain", "draw", (F.col("at") + 1).alias("step"), "x.*"), "level", "seasonal")


# --- autoregression ---------------------------------------------------------------------------------------


def draw_autoregression(posterior: DataFrame, order: int, chains=4, draws=1000, seed=42) -> DataFrame:
    """Independent draws (series_id, chain, draw, coef, innovation_variance) from exact posteriors."""
    _check_run(chains, draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, k = pdf.iloc[0], order + 1
        rng = _rng(seed, r["series_id"], int(r["chain"]), FIT)
        low = np.linalg.cholesky(np.array(r["prec"]).reshape(k, k))
        variance = 1 / rng.gamma(r["shape"], 1 / r["scale"], draws)
        z = np.linalg.solve(low.T, rng.standard_normal((k, draws))).T
        coef = np.array(r["coef"]) + np.sqrt(variance)[:, None] * z
        return pd.DataFrame({"series_id": r["series_id"], "chain": int(r["chain"]), "draw": np.arange(draws), "coef": list(coef), "innovation_variance": variance})

    return _chains(posterior, chains).groupBy("series_id", "chain").applyInPandas(run, "series_id string, chain int, draw int, coef array<double>, innovation_variance double")


def forecast_autoregression(drawn: DataFrame, history: DataFrame, steps: int, seed=43, most: int | None = None) -> DataFrame:
    """Recursive means and observations; ``history`` has the last observations of each series, ``back`` from 1."""
    last = history.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("back", "y"))), lambda x: x["y"]).alias("past"))
    _check_steps(drawn, steps, most)
    grid = _steps(drawn.join(last, "series_id"), steps).withColumn("shock", F.sqrt("innovation_variance") * _noise(seed, "ar"))
    shocks = F.transform(F.array_sort(F.collect_list(F.struct("step", "shock"))), lambda x: x["shock"])
    one = grid.groupBy("series_id", "chain", "draw").agg(F.first("coef").alias("coef"), F.first("past").alias("past"), shocks.alias("shocks"))
    start = F.struct(F.col("past").alias("past"), F.array().cast("array<struct<mean:double,observation:double>>").alias("out"))

    def move(state, shock):
        lagged = F.aggregate(F.zip_with(F.slice("coef", F.lit(2), F.size("coef") - 1), state["past"], lambda c, v: c * v), F.lit(0.0), lambda a, v: a + v)
        mean = F.element_at("coef", 1) + lagged
        past = F.concat(F.array(mean + shock), F.slice(state["past"], F.lit(1), F.size(state["past"]) - 1))
        return F.struct(past.alias("past"), F.concat(state["out"], F.array(F.struct(mean.alias("mean"), (mean + shock).alias("observation")))).alias("out"))

    path = one.select("series_id", "chain", "draw", F.posexplode(F.aggregate("shocks", start, move)["out"]).alias("at", "x"))
    return _with_cumulative(path.select("series_id", "chain", "draw", (F.col("at") + 1).alias("step"), F.col("x.mean").alias("mean"), F.col("x.observation").alias("observation")), "mean")


# --- hierarchy of means -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HierarchicalMean:
    """Program means around group means around a population mean, all Gaussian."""

    group_variance_prior: InverseGammaPrior
    program_variance_prior: InverseGammaPrior
    observation_variance_prior: InverseGammaPrior
    population_mean_prior: float = 0.0
    population_variance_prior: float = 100.0

    def fit(self, programs: DataFrame, chains=4, draws=1000, warmup=500, thin=1, seed=42, most: int | None = None) -> DataFrame:
        """Draws in long form (chain, draw, param, id, value) from programs (program_id, group_id, y).

        A program has one group.  With ``most``, a fit that would have more values than that is refused.
        Rows are aggregated to count, sum and squares of each program, these to cells of programs with one group and
        count.  Given means and variances above them, programs are independent, so a chain draws the sums over a cell's
        programs that its other steps need, and holds cells alone; the programs' own draws are expressions over kept draws."""
        _check_run(chains, draws, warmup, thin)
        sums = hierarchy_sums(programs)
        size = sums.agg(F.count("*").alias("pairs"), F.count_distinct("program_id").alias("programs"), F.count_distinct("group_id").alias("groups"), F.min("n").alias("least")).first()
        if size["pairs"] != size["programs"]:
            raise InferenceError("a program belongs to one group")
        if size["pairs"] and size["least"] < 1:
            raise InferenceError("every program needs an observation")
        if most is not None:
            check_size(chains * draws * (4 + size["groups"] + size["programs"]), most, "a fit")
        scalars = ["population_mean", "group_variance", "program_variance", "observation_variance"]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["group_id", "n"]).reset_index(drop=True)
            n, many, mean, apart = (pdf[c].to_numpy(float) for c in ("n", "many", "mean", "apart"))
            within, rows, count = pdf["within"].sum(), (n * many).sum(), int(many.sum())
            chain = int(pdf["chain"].iloc[0])
            rng = _rng(seed, "hierarchy", chain, FIT)
            group, names = pd.factorize(pdf["group_id"], use_na_sentinel=False)
            size, g = np.bincount(group, many), len(names)
            totals = np.bincount(group, many * mean)
            groups_ = totals / size
            v_group, v_prog, v_obs = self.group_variance_prior.mode, self.program_variance_prior.mode, self.observation_variance_prior.mode
            kept = []
            for i in range(warmup + draws * thin):
                prec = 1 / self.population_variance_prior + g / v_group
                pop = (self.population_mean_prior / self.population_variance_prior + groups_.sum() / v_group) / prec + rng.standard_normal() / math.sqrt(prec)
                prec = 1 / v_group + size / v_prog
                groups_ = (pop / v_group + totals / v_prog) / prec + rng.standard_normal(g) / np.sqrt(prec)
                # programs are group + weight * (own mean - group) + spread * z; along the cell's mean, along what its means are apart, and all else of z
                prec = 1 / v_prog + n / v_obs
                weight, spread, off = n / v_obs / prec, 1 / np.sqrt(prec), mean - groups_[group]
                one, two = rng.standard_normal(len(n)), rng.standard_normal(len(n)) * (many > 1)
                noise = one**2 + two**2 + 2 * rng.standard_gamma(np.maximum(many - 2, 0) / 2)
                data, both = apart + many * off**2, spread * (np.sqrt(apart) * two + np.sqrt(many) * off * one)
                totals = np.bincount(group, many * (groups_[group] + weight * off) + spread * np.sqrt(many) * one)
                missed = n * ((1 - weight) ** 2 * data - 2 * (1 - weight) * both + spread**2 * noise)
                moved = weight**2 * data + 2 * weight * both + spread**2 * noise
                v_obs = self.observation_variance_prior.draw(rng, rows, float(within + np.maximum(missed, 0).sum()))
                v_prog = self.program_variance_prior.draw(rng, count, float(np.maximum(moved, 0).sum()))
                v_group = self.group_variance_prior.draw(rng, g, float(np.square(groups_ - pop).sum()))
                if i >= warmup and (i + 1 - warmup) % thin == 0:
                    kept.append((chain, (i + 1 - warmup) // thin - 1, pop, v_group, v_prog, v_obs, names.tolist(), groups_.tolist()))
            return pd.DataFrame(kept, columns=["chain", "draw", *scalars, "names", "means"])

        mean = F.col("total") / F.col("n")
        cells = sums.groupBy("group_id", "n").agg(F.count("*").alias("many"), F.avg(mean).alias("mean"), (F.var_pop(mean) * F.count("*")).alias("apart"), F.sum("within").alias("within"))
        # one chain is sequential; it sees a row for each group and count of observations
        above = _chains(cells, chains).groupBy("chain").applyInPandas(run, f"chain int, draw int, {', '.join(f'{c} double' for c in scalars)}, names array<string>, means array<double>")
        named = F.transform(F.arrays_zip("names", "means"), lambda x: F.struct(F.lit("group_mean").alias("param"), x["names"].alias("id"), x["means"].alias("value")))
        said = F.array(*[F.struct(F.lit(c).alias("param"), F.lit(None).cast("string").alias("id"), F.col(c).alias("value")) for c in scalars])
        # the filter says what these rows are not, so that a plan that asks for programs alone doesn't come here
        long = above.select("chain", "draw", F.explode(F.concat(said, named)).alias("e")).select("chain", "draw", "e.*").where("NOT param = 'program_mean'")

        of_group = above.select("chain", "draw", "program_variance", "observation_variance", F.explode(F.arrays_zip("names", "means")).alias("e"))
        of_group = of_group.groupBy(F.col("e.names").alias("name")).agg(F.collect_list(F.struct("chain", "draw", F.col("e.means").alias("mean"), "program_variance", "observation_variance")).alias("draws"))
        if chains * draws * (size["groups"] + 1) <= MOST_BROADCAST:
            of_group = F.broadcast(of_group)
        # dealt by program, as a join of membership is, which then moves no draws
        rows = sums.repartition(_tasks(programs), "program_id").join(of_group, F.col("group_id").cast("string").eqNullSafe(F.col("name"))).select(F.col("program_id").cast("string").alias("id"), "n", "total", F.explode("draws").alias("d"))
        prec = 1 / F.col("d.program_variance") + F.col("n") / F.col("d.observation_variance")
        value = (F.col("d.mean") / F.col("d.program_variance") + F.col("total") / F.col("d.observation_variance")) / prec + normal(seed ^ FIT, F.lit("program"), "id", "d.chain", "d.draw") / F.sqrt(prec)
        return long.unionByName(rows.select("d.chain", "d.draw", F.lit("program_mean").alias("param"), "id", value.alias("value")))


def forecast_hierarchy(fitted: DataFrame, membership: DataFrame, steps: int, seed=43, most: int | None = None) -> DataFrame:
    """(chain, draw, step, group_id, program_id, mean, observation): static means and noise."""
    _check_steps(fitted.where("param = 'program_mean'"), steps, most)
    means = fitted.where("param = 'program_mean'").select("chain", "draw", F.col("id").alias("program_id"), F.col("value").alias("mean"))
    noise = fitted.where("param = 'observation_variance'").select("chain", "draw", F.col("value").alias("v"))  # a row for each draw
    of = membership.select(F.col("program_id").cast("string").alias("program_id"), "group_id").distinct().repartition(_tasks(membership), "program_id")
    grid = means.join(F.broadcast(noise), ["chain", "draw"]).join(of.hint("shuffle_hash"), "program_id")
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    z = normal(seed ^ FORECAST, "program_id", "chain", "draw", "step")
    return grid.select("chain", "draw", "step", "group_id", "program_id", "mean", (F.col("mean") + F.sqrt("v") * z).alias("observation"))
