"""Window features of series (series_id, t, y), scores of forecasts, and closed-form regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import mean_of, products_of

LAGS = (1, 2, 3, 4, 6, 12, 26, 52)
WIDTHS = (3, 6, 12, 26, 52)


def _order(by: str = "series_id") -> Window:
    return Window.partitionBy(by).orderBy("t")


def difference(series: DataFrame, value: str = "y") -> DataFrame:
    """First differences of the states."""
    return series.withColumn("diff", F.col(value) - F.lag(value).over(_order()))


def trend_residuals(states: DataFrame) -> DataFrame:
    """(level - previous level - previous slope, slope - previous slope)."""
    before = _order()
    return states.withColumn("level_residual", F.col("level") - F.lag("level").over(before) - F.lag("slope").over(before)).withColumn("slope_residual", F.col("slope") - F.lag("slope").over(before))


def seasonal_residual(states: DataFrame, period: int, value: str = "y") -> DataFrame:
    """The seasonal state plus the ``period - 1`` before it; null until there are as many."""
    w = _order().rowsBetween(1 - period, 0)
    return states.withColumn("seasonal_residual", F.when(F.count(value).over(w) == period, F.sum(value).over(w)))


def running_sum(series: DataFrame, value: str = "y") -> DataFrame:
    return series.withColumn("cumulative", F.sum(value).over(_order().rowsBetween(Window.unboundedPreceding, 0)))


def standardised(series: DataFrame, fallback: float = 1.0) -> DataFrame:
    """(y - mean) / sample deviation; ``fallback`` where the deviation is 0 or missing."""
    every = Window.partitionBy("series_id")
    spread = F.stddev_samp("y").over(every)
    scale = F.when(spread > 0, spread).otherwise(F.lit(fallback))
    return series.withColumn("z", (F.col("y") - F.avg("y").over(every)) / scale)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.select("*", *[(F.col(column) == F.lit(v)).cast("double").alias(f"{column}_{v}") for v in values])


def seasonal_terms(df: DataFrame, period: float, horizon: float, t: str = "t") -> DataFrame:
    """Fourier pair of a period and the share of time passed."""
    angle = F.lit(2.0) * F.pi() * F.col(t) / F.lit(float(period))
    return df.withColumn("sin_t", F.sin(angle)).withColumn("cos_t", F.cos(angle)).withColumn("trend", F.col(t) / F.lit(float(horizon)))


def lag_features(series: DataFrame, lags=LAGS) -> DataFrame:
    """``lag_k``: the k-th latest value (1 is the row's own), the mean of up to 6 latest where there is none, and whether there is one."""
    order = _order()
    recent = F.avg("y").over(order.rowsBetween(-5, 0))
    out = series
    for k in lags:
        value = F.lag("y", k - 1).over(order)
        there = F.row_number().over(order) >= k
        out = out.withColumn(f"lag_{k}", F.when(there, value).otherwise(recent)).withColumn(f"has_{k}", there.cast("double"))
    return out


def rolling_features(series: DataFrame, widths=WIDTHS) -> DataFrame:
    """Mean, deviation (divisor n) and slope over the latest values of each width."""
    out = series
    for w in widths:
        rows = _order().rowsBetween(1 - w, 0)
        slope = F.when(F.count("y").over(rows) >= 2, F.covar_pop("y", F.col("t").cast("double")).over(rows) / F.var_pop(F.col("t").cast("double")).over(rows)).otherwise(0.0)
        out = out.withColumn(f"mean_{w}", F.avg("y").over(rows)).withColumn(f"std_{w}", F.stddev_pop("y").over(rows)).withColumn(f"slope_{w}", slope)
    return out


def cycle_drift(series: DataFrame, period: int) -> DataFrame:
    """Median change over one cycle, for each series."""
    changes = series.withColumn("change", F.col("y") - F.lag("y", period).over(_order()))
    return changes.where("change is not null").groupBy("series_id").agg(F.percentile("change", F.lit(0.5)).alias("drift"), F.count("*").alias("pairs"))


def last_values(series: DataFrame, p: int) -> DataFrame:
    """The last ``p`` observations, latest first."""
    latest = Window.partitionBy("series_id").orderBy(F.col("t").desc())
    return series.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= p)


# --- regressions from sums ------------------------------------------------------------------------------


def gaussian_sums(df: DataFrame, xs: list[Column | str], y: Column | str, by: list[str]) -> DataFrame:
    """n, means and centred products (upper triangle) of the predictors, then the response: all that a Gaussian
    likelihood needs of its rows, without the digits that raw squares lose."""
    cols = [c if isinstance(c, Column) else F.col(c) for c in (*xs, y)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[mean_of(c) for c in cols]).alias("means"), F.array(*products_of(cols)).alias("products"))


def ar_design(series: DataFrame, order: int) -> DataFrame:
    """Rows with all of ``y_lag_1 ... y_lag_order``."""
    w = _order()
    out = series.select("*", *[F.lag("y", k).over(w).alias(f"y_lag_{k}") for k in range(1, order + 1)])
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") > order).drop("place")


def nig_solve(n: float, means: np.ndarray, products: np.ndarray, mean: np.ndarray, precision: np.ndarray, shape: float, scale: float) -> tuple:
    """(means, precision, shape, scale) of a Normal-Inverse-Gamma posterior from centred products (response last).

    Solved for the distance from the prior's mean; where one predictor is constant, with the others about their
    means, so that an offset of predictors or response costs no digits.  The scale is a sum of squares: the
    residuals' own and the prior's, never a difference of large numbers."""
    k = len(mean)
    cross, centre = products[:k, :k], means[:k]
    drift = means[k] - centre @ mean
    to_y = products[:k, k] - cross @ mean
    left = products[k, k] - 2 * mean @ products[:k, k] + mean @ cross @ mean
    turn, fixed = np.eye(k), [i for i in range(k) if cross[i, i] == 0 and centre[i] != 0]
    if fixed:
        i = fixed[0]
        turn[i] = np.where(np.arange(k) == i, 1.0, -centre / centre[i])
    seen = turn.T @ centre  # the mean of each turned predictor: 0 but for the constant one
    if fixed:
        seen = np.where(np.arange(k) == fixed[0], centre[fixed[0]], 0.0)
    prior = turn.T @ precision @ turn
    g = np.linalg.solve(prior + cross + n * np.outer(seen, seen), to_y + n * drift * seen)
    about = n * (drift - seen @ g) ** 2 + max(left - 2 * g @ to_y + g @ cross @ g, 0.0)
    post = precision + cross + n * np.outer(centre, centre)
    return mean + turn @ g, post, shape + n / 2, scale + 0.5 * (about + g @ prior @ g)


def nig_posterior(sums: DataFrame, k: int, mean: np.ndarray, precision: np.ndarray, shape: float, scale: float, by: str = "series_id") -> DataFrame:
    """Posterior of a Normal-Inverse-Gamma regression from :func:`gaussian_sums` with ``k`` predictors.

    Returns coef (means), prec (precision, row by row), shape and scale; one small solve for each row.
    """

    def run(batches):
        upper = np.triu_indices(k + 1)
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                products = np.zeros((k + 1, k + 1))
                products[upper] = products[upper[::-1]] = r["products"]
                coef, post, a, b = nig_solve(r["n"], np.asarray(r["means"]), products, mean, precision, shape, scale)
                out.append((r[by], coef.tolist(), post.ravel().tolist(), a, b))
            yield pd.DataFrame(out, columns=[by, "coef", "prec", "shape", "scale"])

    return sums.mapInPandas(run, f"{by} string, coef array<double>, prec array<double>, shape double, scale double")


def ar_posterior(series: DataFrame, order: int, mean=None, precision=None, shape: float = 2.0, scale: float = 1.0) -> DataFrame:
    """Exact posterior of an autoregression with intercept, by window lags and sums; a null or infinite value is an error."""
    k = order + 1
    mean = np.zeros(k) if mean is None else np.asarray(mean, float)
    precision = np.eye(k) if precision is None else np.asarray(precision, float)
    design = ar_design(series, order)
    sums = gaussian_sums(design, [F.lit(1.0), *[f"y_lag_{j}" for j in range(1, order + 1)]], "y", ["series_id"])
    wrong = series.groupBy("series_id").agg(F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).alias("wrong"), F.count("*").alias("all"))
    refuse = F.raise_error(F.concat(F.lit("an autoregression needs finite values, more than its order: series "), F.coalesce(F.col("series_id").cast("string"), F.lit("null"))))
    sums = wrong.join(sums, "series_id", "left").withColumn("n", F.when((F.col("wrong") > 0) | (F.col("all") <= order), refuse).otherwise(F.col("n")))
    return nig_posterior(sums.drop("wrong", "all"), k, mean, precision, shape, scale)


def hierarchy_sums(programs: DataFrame) -> DataFrame:
    """Observed count, sum and squares about the own mean of each program (group_id, program_id, y)."""
    seen = F.when(~F.isnan("y"), F.col("y"))
    return programs.groupBy("group_id", "program_id").agg(F.count(seen).alias("n"), F.sum(seen).alias("total"), (F.var_pop(seen) * F.count(seen)).alias("within"))


def shrinkage(sums: DataFrame, program_variance: float, observation_variance: float) -> DataFrame:
    """Weight of a program's own mean against its group's."""
    own = F.col("n") * F.lit(float(program_variance))
    return sums.withColumn("weight", own / (own + F.lit(float(observation_variance))))


# --- scores ---------------------------------------------------------------------------------------------


def interval_score(truth, lower, upper, alpha: float) -> Column:
    y, lo, hi = F.col(truth), F.col(lower), F.col(upper)
    out = hi - lo + F.when(y < lo, F.lit(2.0 / alpha) * (lo - y)).otherwise(0.0)
    return out + F.when(y > hi, F.lit(2.0 / alpha) * (y - hi)).otherwise(0.0)


def accuracy(df: DataFrame, by: list[str], mean="mean", truth="y", lower="lower", upper="upper") -> DataFrame:
    """MAE, RMSE, symmetric percentage error, coverage and mean width."""
    e = F.col(mean) - F.col(truth)
    floor = F.greatest(F.abs(mean) + F.abs(truth), F.lit(1e-12))
    inside = ((F.col(truth) >= F.col(lower)) & (F.col(truth) <= F.col(upper))).cast("double")
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100.0 * F.avg(2.0 * F.abs(e) / floor)).alias("smape"), F.avg(inside).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"), F.avg(interval_score(truth, lower, upper, 0.05)).alias("interval_score_95"),
    )


def nlpd(df: DataFrame, by: list[str], mean="mean", sd="sd", truth="y") -> DataFrame:
    """Mean negative log density of Gaussian predictions."""
    var = F.greatest(F.col(sd) * F.col(sd), F.lit(1e-10))
    e = F.col(truth) - F.col(mean)
    return df.groupBy(*by).agg(F.avg(0.5 * (F.log(2 * F.pi() * var) + e * e / var)).alias("nlpd"))


def weighted_interval_score(paths: DataFrame, by: list[str], value="value", truth="y") -> DataFrame:
    """From draws of each target (``by``, each with its truth): median and the 80 % and 95 % intervals."""
    q = lambda p: F.percentile(value, F.lit(p))
    per = paths.groupBy(*by, truth).agg(q(0.5).alias("q50"), q(0.1).alias("q10"), q(0.9).alias("q90"), q(0.025).alias("q025"), q(0.975).alias("q975"))
    total = 0.5 * F.abs(F.col(truth) - F.col("q50")) + 0.1 * interval_score(truth, "q10", "q90", 0.2) + 0.025 * interval_score(truth, "q025", "q975", 0.05)
    return per.withColumn("wis", total / 0.625)


def best_candidate(scores: DataFrame, by: list[str], score: str = "wis", name: str = "candidate") -> DataFrame:
    """The candidate of the least mean score; the first name where they tie."""
    mean = scores.groupBy(*by, name).agg(F.avg(score).alias("score"))
    return mean.groupBy(*by).agg(F.min_by(F.struct(name, "score"), F.struct("score", name)).alias("b")).select(*by, f"b.{name}", "b.score")


def cycle_agreement(series: DataFrame, period: int) -> DataFrame:
    """Correlation of the first two cycles after a quadratic trend is taken out, and the amplitude of their mean.

    The trend's normal equations are sums; the residual of each point is an expression."""
    every = Window.partitionBy("series_id")
    u = F.col("t").cast("double") / (F.max("t").over(every) + 1)
    base = series.withColumn("u", u)
    s = {k: F.sum(F.pow("u", F.lit(float(k)))).over(every) for k in range(5)}
    r = {k: F.sum(F.pow("u", F.lit(float(k))) * F.col("y")).over(every) for k in range(3)}
    base = base.select("series_id", "t", "y", "u", *[v.alias(f"s{k}") for k, v in s.items()], *[v.alias(f"r{k}") for k, v in r.items()])
    c = {k: F.col(f"s{k}") for k in range(5)}
    d = {k: F.col(f"r{k}") for k in range(3)}

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    m = [[c[i + j] for j in range(3)] for i in range(3)]
    whole = det(m)
    coef = [det([[d[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    resid = base.withColumn("e", F.col("y") - coef[0] - coef[1] * F.col("u") - coef[2] * F.col("u") * F.col("u")).select("series_id", "t", "e")
    pair = resid.withColumn("next", F.lead("e", period).over(_order()))
    two = pair.where(F.col("t") < period).groupBy("series_id").agg(F.corr("e", "next").alias("cycle_correlation"), F.avg(F.pow((F.col("e") + F.col("next")) / 2, F.lit(2.0))).alias("mean_sq"))
    spread = resid.groupBy("series_id").agg(F.avg(F.col("e") * F.col("e")).alias("all_sq"))
    return two.join(spread, "series_id").select("series_id", "cycle_correlation", (F.sqrt("mean_sq") / F.sqrt("all_sq")).alias("amplitude_ratio"))
