"""Queries over series: Kalman filters and forecasts, window features, closed-form regressions, scores."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from ..functions.special import inv_normal
from ..operators import kalman as K
from ..operators import series as W
from ..sources.tables import daily_revenue, study_series, table
from . import oracle as O  # noqa: E741

QUERIES: dict = {}
ORACLES: dict = {}
Q, R, M0, P0 = 0.05, 0.5, 0.0, 100.0
LEVEL = K.local_level(Q, R, M0, P0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(name, digits=6):
    return F.round(name, digits).alias(name)


KAL = f"WITH RECURSIVE {O.SERIES}, {O.kalman(Q, R, M0, P0)}"
SER = f"WITH {O.SERIES}"


@query(f"{KAL} SELECT series_id, t, round(pm, 6) AS predicted_mean, round(pp, 6) AS predicted_var, round(m, 6) AS filtered_mean, round(p, 6) AS filtered_var, round(ll, 6) AS loglik FROM k WHERE t >= 0")
def kalman_local_level_filter(spark, sf):
    first = lambda c, n: F.round(F.element_at(c, 1), 6).alias(n)
    f = K.kalman_filter(daily_revenue(spark, sf), LEVEL)
    return f.select("series_id", "t", first("predicted_mean", "predicted_mean"), first("predicted_cov", "predicted_var"), first("filtered_mean", "filtered_mean"), first("filtered_cov", "filtered_var"), r("loglik"))


@query(f"{KAL} SELECT k.series_id, count(*) AS missing, round(sum(k.p), 6) AS var_sum, round(max(k.ll), 6) AS ll FROM k JOIN series s USING (series_id, t) WHERE s.y IS NULL GROUP BY k.series_id")
def kalman_missing(spark, sf):
    s = daily_revenue(spark, sf)
    gaps = s.where("y is null").select("series_id", "t")
    f = K.kalman_filter(s, LEVEL).join(gaps, ["series_id", "t"])
    return f.groupBy("series_id").agg(F.count("*").alias("missing"), F.round(F.sum(F.element_at("filtered_cov", 1)), 6).alias("var_sum"), F.round(F.max("loglik"), 6).alias("ll"))


@query(f"{KAL} SELECT series_id, count(*) - 1 AS n, round(arg_max(m, t), 6) AS m, round(arg_max(p, t), 6) AS p, round(sum(ll), 4) AS loglik FROM k GROUP BY series_id")
def kalman_loglik(spark, sf):
    out = K.scalar_last(daily_revenue(spark, sf), 1, Q, R, M0, P0)
    return out.select("series_id", "n", r("m"), r("p"), r("loglik", 4))


@query(f"""{KAL}, n AS (SELECT series_id, max(t) AS last FROM k GROUP BY ALL), s2 AS (
  SELECT k.series_id, k.t, k.m AS sm, k.p AS sv FROM k JOIN n ON n.series_id = k.series_id AND k.t = n.last
  UNION ALL
  SELECT k.series_id, k.t, k.m + k.p / (k.p + {Q}::DOUBLE) * (s2.sm - k.m), k.p + (k.p / (k.p + {Q}::DOUBLE)) * (k.p / (k.p + {Q}::DOUBLE)) * (s2.sv - (k.p + {Q}::DOUBLE))
  FROM s2 JOIN k ON k.series_id = s2.series_id AND k.t = s2.t - 1 WHERE k.t >= 0
) SELECT series_id, t, round(sm, 6) AS smoothed_mean, round(sv, 6) AS smoothed_var FROM s2""")
def rts_local_level(spark, sf):
    f = K.kalman_filter(daily_revenue(spark, sf), LEVEL, smooth=True)
    return f.select("series_id", "t", F.round(F.element_at("smoothed_mean", 1), 6).alias("smoothed_mean"), F.round(F.element_at("smoothed_cov", 1), 6).alias("smoothed_var"))


LAST = f"{KAL}, z AS (SELECT series_id, arg_max(m, t) AS m, arg_max(p, t) AS p FROM k GROUP BY ALL), h AS (SELECT unnest(range(1, 8))::INTEGER AS step)"


def _forecast(spark, sf):
    return K.scalar_forecast(K.scalar_last(daily_revenue(spark, sf), 1, Q, R, M0, P0), 1, Q, R, 7)


@query(f"{LAST} SELECT series_id, step, round(m, 6) AS obs_mean, round(p + step * {Q}::DOUBLE + {R}::DOUBLE, 6) AS obs_var FROM z, h")
def forecast_moments(spark, sf):
    return _forecast(spark, sf).select("series_id", "step", r("obs_mean"), r("obs_var"))


CUM = f"""{LAST}, c AS (SELECT z.series_id, a.step AS i, b.step AS j, p + least(a.step, b.step) * {Q}::DOUBLE + CASE WHEN a.step = b.step THEN {R}::DOUBLE ELSE 0 END AS cov FROM z, h a, h b)"""


@query(f"{CUM} SELECT series_id, i, j, round(cov, 6) AS cov FROM c")
def forecast_joint_cov(spark, sf):
    joint = K.forecast_joint(daily_revenue(spark, sf), LEVEL, 7)
    return joint.select("series_id", F.col("step").alias("i"), F.posexplode("obs_cov").alias("j", "cov")).select("series_id", "i", (F.col("j") + 1).alias("j"), r("cov"))


@query(f"{CUM} SELECT c.series_id, h.step, round(any_value(z.m) * h.step, 6) AS cum_mean, round(sum(cov), 6) AS cum_var FROM c JOIN h ON i <= h.step AND j <= h.step JOIN z ON z.series_id = c.series_id GROUP BY c.series_id, h.step")
def forecast_cumulative(spark, sf):
    return _forecast(spark, sf).select("series_id", "step", r("cum_mean"), r("cum_var"))


Z95 = inv_normal(0.975)


@query(f"""{CUM} SELECT c.series_id, h.step, round(any_value(z.m) - {Z95!r}::DOUBLE * sqrt(any_value(z.p) + h.step * {Q}::DOUBLE + {R}::DOUBLE), 6) AS lower, round(any_value(z.m) + {Z95!r}::DOUBLE * sqrt(any_value(z.p) + h.step * {Q}::DOUBLE + {R}::DOUBLE), 6) AS upper,
  round(any_value(z.m) * h.step - {Z95!r}::DOUBLE * sqrt(sum(cov)), 6) AS cum_lower, round(any_value(z.m) * h.step + {Z95!r}::DOUBLE * sqrt(sum(cov)), 6) AS cum_upper FROM c JOIN h ON i <= h.step AND j <= h.step JOIN z ON z.series_id = c.series_id GROUP BY c.series_id, h.step""")
def gaussian_interval(spark, sf):
    one = K.gaussian_interval(_forecast(spark, sf), "obs_mean", "obs_var").withColumnsRenamed({"lower": "lo", "upper": "up"})
    two = K.gaussian_interval(one, "cum_mean", "cum_var")
    return two.select("series_id", "step", F.round("lo", 6).alias("lower"), F.round("up", 6).alias("upper"), F.round("lower", 6).alias("cum_lower"), F.round("upper", 6).alias("cum_upper"))


PHI = 0.7
AR = K.stationary_ar1(PHI, 0.2, R)


@query(f"""WITH RECURSIVE {O.SERIES}, {O.kalman(0.2, R, 0.0, 0.2 / (1 - PHI * PHI), PHI)}, z AS (SELECT series_id, arg_max(m, t) AS m, arg_max(p, t) AS p FROM k GROUP BY ALL), h AS (SELECT unnest(range(1, 8))::INTEGER AS step)
  SELECT series_id, step, round(pow({PHI}::DOUBLE, step) * m, 6) AS obs_mean, round(pow({PHI}::DOUBLE, 2 * step) * p + 0.2::DOUBLE * (1 - pow({PHI}::DOUBLE, 2 * step)) / {1 - PHI * PHI!r}::DOUBLE + {R}::DOUBLE, 6) AS obs_var FROM z, h""")
def stationary_ar1_forecast(spark, sf):
    last = K.scalar_last(daily_revenue(spark, sf), PHI, 0.2, R, 0.0, 0.2 / (1 - PHI * PHI))
    return K.scalar_forecast(last, PHI, 0.2, R, 7).select("series_id", "step", r("obs_mean"), r("obs_var"))


@query()
def kalman_trend_smoother(spark, sf):
    s = K.local_linear_trend(0.05, 0.001, R, 0, 0, 100, 1)
    return K.kalman_filter(daily_revenue(spark, sf), s, smooth=True).select("series_id", "t", "filtered_mean", "smoothed_mean", "loglik")


@query()
def kalman_seasonal_forecast(spark, sf):
    s = K.seasonal_local_level(7, 0.05, 0.01, R, 0, None, 100, 10)
    return K.with_cumulative(K.forecast_joint(daily_revenue(spark, sf), s, 14))


@query(f"""{SER} SELECT series_id, t, round(y - lag(y) OVER w, 9) AS diff, round(sum(y) OVER (w ROWS UNBOUNDED PRECEDING), 9) AS cumulative,
  CASE WHEN count(y) OVER (w ROWS 6 PRECEDING) = 7 THEN round(sum(y) OVER (w ROWS 6 PRECEDING), 9) END AS seasonal_residual FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def state_residuals(spark, sf):
    s = W.seasonal_residual(W.running_sum(W.difference(daily_revenue(spark, sf))), 7)
    return s.select("series_id", "t", r("diff", 9), r("cumulative", 9), r("seasonal_residual", 9))


@query(f"""{SER} SELECT series_id, t, round(y - lag(y) OVER w - lag(y / 10) OVER w, 10) AS level_residual, round(y / 10 - lag(y / 10) OVER w, 10) AS slope_residual FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def trend_residuals(spark, sf):
    s = daily_revenue(spark, sf).select("series_id", "t", F.col("y").alias("level"), (F.col("y") / 10).alias("slope"))
    return W.trend_residuals(s).select("series_id", "t", r("level_residual", 10), r("slope_residual", 10))


@query(f"""{SER} SELECT series_id, t, round((y - avg(y) OVER (PARTITION BY series_id)) / stddev_samp(y) OVER (PARTITION BY series_id), 6) AS z FROM series""")
def standardize(spark, sf):
    return W.standardised(daily_revenue(spark, sf)).select("series_id", "t", r("z"))


@query("SELECT c_mktsegment, " + ", ".join(f"sum(CASE WHEN c_mktsegment = '{v}' THEN 1.0::DOUBLE ELSE 0 END) AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "MACHINERY")) + " FROM customer GROUP BY c_mktsegment")
def one_hot(spark, sf):
    hot = W.one_hot(table(spark, sf, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    return hot.groupBy("c_mktsegment").agg(*[F.sum(f"c_mktsegment_{v}").alias(f"c_mktsegment_{v}") for v in ("BUILDING", "MACHINERY")])


@query(f"{SER} SELECT series_id, t, round(sin(2.0::DOUBLE * pi() * t / 7.0::DOUBLE), 9) + 0.0::DOUBLE AS sin_t, round(cos(2.0::DOUBLE * pi() * t / 7.0::DOUBLE), 9) + 0.0::DOUBLE AS cos_t, round(t / 2500.0::DOUBLE, 9) AS trend FROM series")
def fourier_trend(spark, sf):
    return W.seasonal_terms(daily_revenue(spark, sf), 7, 2500).select("series_id", "t", (F.round("sin_t", 9) + 0.0).alias("sin_t"), (F.round("cos_t", 9) + 0.0).alias("cos_t"), r("trend", 9))


LAGS = ", ".join(f"round(CASE WHEN rn >= {k} THEN lag(y, {k - 1}) OVER w ELSE recent END, 12) AS lag_{k}, CASE WHEN rn >= {k} THEN 1.0::DOUBLE ELSE 0 END AS has_{k}" for k in W.LAGS)


@query(f"""{SER}, a AS (SELECT *, row_number() OVER w AS rn, avg(y) OVER (w ROWS 5 PRECEDING) AS recent FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t))
  SELECT series_id, t, {LAGS} FROM a WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def lag_features(spark, sf):
    out = W.lag_features(daily_revenue(spark, sf))
    return out.select("series_id", "t", *[c for k in W.LAGS for c in (r(f"lag_{k}", 12), F.col(f"has_{k}"))])


FULL = f"{SER}, full_series AS (SELECT series_id, t, coalesce(y, 0) AS y FROM series)"
ROLL = ", ".join(f"round(avg(y) OVER w{w}, 11) AS mean_{w}, round(stddev_pop(y) OVER w{w}, 8) AS std_{w}, round(CASE WHEN count(y) OVER w{w} >= 2 THEN covar_pop(y, t::DOUBLE) OVER w{w} / var_pop(t::DOUBLE) OVER w{w} ELSE 0 END, 10) AS slope_{w}" for w in (3, 12))


@query(f"{FULL} SELECT series_id, t, {ROLL} FROM full_series WINDOW w3 AS (PARTITION BY series_id ORDER BY t ROWS 2 PRECEDING), w12 AS (PARTITION BY series_id ORDER BY t ROWS 11 PRECEDING)")
def rolling_features(spark, sf):
    out = W.rolling_features(daily_revenue(spark, sf).fillna(0.0, ["y"]), (3, 12))
    return out.select("series_id", "t", *[r(f"{n}_{w}", d) for w in (3, 12) for n, d in (("mean", 11), ("std", 8), ("slope", 10))])


@query(f"{SER}, d AS (SELECT series_id, y - lag(y, 7) OVER (PARTITION BY series_id ORDER BY t) AS c FROM series) SELECT series_id, round(quantile_cont(c, 0.5), 6) AS drift, count(c) AS pairs FROM d WHERE c IS NOT NULL GROUP BY ALL")
def cycle_drift(spark, sf):
    return W.cycle_drift(daily_revenue(spark, sf), 7).select("series_id", r("drift"), "pairs")


@query(f"{SER} SELECT series_id, t, back, round(y, 9) AS y FROM (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY t DESC))::INTEGER AS back FROM series) WHERE back <= 5")
def forecast_history(spark, sf):
    return W.last_values(daily_revenue(spark, sf), 5).select("series_id", "t", "back", r("y", 9))


def _det(a):
    return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"


_M = [[f"s{i + j}" for j in range(3)] for i in range(3)]
_COEF = [f"{_det([[f'r{i}' if j == k else _M[i][j] for j in range(3)] for i in range(3)])} / {_det(_M)}" for k in range(3)]


@query(f"""{FULL}, u AS (SELECT *, t::DOUBLE / (max(t) OVER (PARTITION BY series_id) + 1) AS u FROM full_series),
  m AS (SELECT series_id, {', '.join(f'sum(pow(u, {k})) AS s{k}' for k in range(5))}, {', '.join(f'sum(pow(u, {k}) * y) AS r{k}' for k in range(3))} FROM u GROUP BY ALL),
  c AS (SELECT series_id, {', '.join(f'{x} AS c{k}' for k, x in enumerate(_COEF))} FROM m),
  e AS (SELECT series_id, t, y - c0 - c1 * u - c2 * u * u AS e FROM u JOIN c USING (series_id)),
  p AS (SELECT *, lead(e, 365) OVER (PARTITION BY series_id ORDER BY t) AS n FROM e)
  SELECT series_id, round(corr(e, n) FILTER (WHERE t < 365), 6) AS cycle_correlation, round(sqrt(avg(pow((e + n) / 2, 2)) FILTER (WHERE t < 365)) / sqrt(avg(e * e)), 6) AS amplitude_ratio FROM p GROUP BY ALL""")
def detrended_cycle_corr(spark, sf):
    return W.cycle_agreement(daily_revenue(spark, sf).fillna(0.0, ["y"]), 365).select("series_id", r("cycle_correlation"), r("amplitude_ratio"))


@query(f"{FULL}, a AS (SELECT series_id, t, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, row_number() OVER w AS rn FROM full_series WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, count(*) AS n, round(sum(l1 * l2), 4) AS l1l2, round(sum(l1 * y), 4) AS l1y, round(sum(l2 * y), 4) AS l2y FROM a WHERE rn > 2 GROUP BY ALL")
def ar_design(spark, sf):
    d = W.ar_design(daily_revenue(spark, sf).fillna(0.0, ["y"]), 2)
    return d.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y_lag_1") * F.col("y_lag_2")), 4).alias("l1l2"), F.round(F.sum(F.col("y_lag_1") * F.col("y")), 4).alias("l1y"), F.round(F.sum(F.col("y_lag_2") * F.col("y")), 4).alias("l2y"))


_AR1 = """a AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS x, row_number() OVER (PARTITION BY series_id ORDER BY t) AS rn FROM full_series),
  s AS (SELECT series_id, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM a WHERE rn > 1 GROUP BY ALL),
  p AS (SELECT *, ((sxx + 1) * sy - sx * sxy) / ((n + 1) * (sxx + 1) - sx * sx) AS b0, ((n + 1) * sxy - sx * sy) / ((n + 1) * (sxx + 1) - sx * sx) AS b1 FROM s)"""


@query(f"{FULL}, {_AR1} SELECT series_id, round(b0, 6) AS intercept, round(b1, 6) AS slope, 2 + n / 2.0::DOUBLE AS shape, round(1 + 0.5 * (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx + b0 * b0 + b1 * b1), 4) AS scale FROM p")
def ar1_posterior(spark, sf):
    p = W.ar_posterior(daily_revenue(spark, sf).fillna(0.0, ["y"]), 1)
    return p.select("series_id", F.round(F.element_at("coef", 1), 6).alias("intercept"), F.round(F.element_at("coef", 2), 6).alias("slope"), "shape", r("scale", 4))


@query(f"""{FULL}, a AS (SELECT series_id, y, lag(y) OVER w AS p, lag(y, 2) OVER w AS q, row_number() OVER w AS rn FROM full_series WINDOW w AS (PARTITION BY series_id ORDER BY t)),
  s AS (SELECT series_id, count(*) AS n, count(*) + 1.0::DOUBLE AS a, sum(p) AS b, sum(q) AS c, sum(p * p) + 1 AS d, sum(p * q) AS e, sum(q * q) + 1 AS f, sum(y) AS u, sum(p * y) AS v, sum(q * y) AS w, sum(y * y) AS yy FROM a WHERE rn > 2 GROUP BY ALL),
  m AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM s),
  x AS (SELECT *, (u * (d * f - e * e) - b * (v * f - w * e) + c * (v * e - w * d)) / det AS x0, (a * (v * f - w * e) - u * (b * f - c * e) + c * (b * w - c * v)) / det AS x1, (a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det AS x2 FROM m)
  SELECT series_id, round(x0, 6) AS intercept, round(x1, 6) AS lag_1, round(x2, 6) AS lag_2, 2 + n / 2.0::DOUBLE AS shape, round(1 + 0.5 * (yy - x0 * u - x1 * v - x2 * w), 4) AS scale FROM x""")
def ar2_posterior(spark, sf):
    p = W.ar_posterior(daily_revenue(spark, sf).fillna(0.0, ["y"]), 2)
    return p.select("series_id", *[F.round(F.element_at("coef", k + 1), 6).alias(n) for k, n in enumerate(("intercept", "lag_1", "lag_2"))], "shape", r("scale", 4))


@query("""WITH s AS (SELECT l_returnflag AS series_id, count(*) AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice / 1000) AS sy, sum(l_quantity * (l_extendedprice / 1000)) AS sxy, sum((l_extendedprice / 1000) * (l_extendedprice / 1000)) AS syy FROM lineitem GROUP BY ALL)
  SELECT series_id, round(((sxx + 0.01) * sy - sx * sxy) / ((n + 0.01) * (sxx + 0.01) - sx * sx), 6) AS intercept, round(((n + 0.01) * sxy - sx * sy) / ((n + 0.01) * (sxx + 0.01) - sx * sx), 6) AS slope, 2 + n / 2.0::DOUBLE AS shape FROM s""")
def regression_posterior_2x2(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    sums = W.gaussian_sums(rows, [F.lit(1.0), "l_quantity"], "y", ["series_id"])
    p = W.nig_posterior(sums, 2, np.zeros(2), 0.01 * np.eye(2), 2.0, 1.0)
    return p.select("series_id", F.round(F.element_at("coef", 1), 6).alias("intercept"), F.round(F.element_at("coef", 2), 6).alias("slope"), "shape")


PROGRAMS = "prog AS (SELECT n_name AS group_id, c_custkey::VARCHAR AS program_id, o_totalprice / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def programs(spark, sf):
    orders, customers, nations = (table(spark, sf, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey)  # 25 nations
    return joined.select(F.col("n_name").alias("group_id"), F.col("c_custkey").cast("string").alias("program_id"), (F.col("o_totalprice") / 1000).alias("y"))


@query(f"WITH {PROGRAMS} SELECT group_id, program_id, count(y) AS n, round(sum(y), 5) AS total, round(var_pop(y) * count(y), 4) AS within FROM prog GROUP BY ALL")
def hier_sufficient_stats(spark, sf):
    return W.hierarchy_sums(programs(spark, sf)).select("group_id", "program_id", "n", r("total", 5), r("within", 4))


@query(f"WITH {PROGRAMS}, s AS (SELECT group_id, program_id, count(y) AS n FROM prog GROUP BY ALL) SELECT group_id, program_id, round(n * 25.0::DOUBLE / (n * 25.0::DOUBLE + 90.0::DOUBLE), 9) AS weight FROM s")
def hier_shrinkage_weight(spark, sf):
    return W.shrinkage(W.hierarchy_sums(programs(spark, sf)), 25.0, 90.0).select("group_id", "program_id", r("weight", 9))


# --- scores of one-step forecasts: what the filter predicted of each observation

SCORED = f"{KAL}, f AS (SELECT k.series_id, k.t, s.y, k.pm AS mean, sqrt(k.pp + {R}::DOUBLE) AS sd FROM k JOIN series s USING (series_id, t) WHERE s.y IS NOT NULL AND k.t >= 30), g AS (SELECT *, mean - {Z95!r}::DOUBLE * sd AS lower, mean + {Z95!r}::DOUBLE * sd AS upper FROM f)"


def _scored(spark, sf):
    s = daily_revenue(spark, sf)
    f = K.kalman_filter(s, LEVEL).select("series_id", "t", F.element_at("predicted_mean", 1).alias("mean"), (F.element_at("predicted_cov", 1) + F.lit(R)).alias("var"))
    f = f.join(s.where("y is not null and t >= 30"), ["series_id", "t"]).withColumn("sd", F.sqrt("var"))
    return K.gaussian_interval(f, "mean", "var")


_IS = "upper - lower + CASE WHEN y < lower THEN 40.0::DOUBLE * (lower - y) ELSE 0 END + CASE WHEN y > upper THEN 40.0::DOUBLE * (y - upper) ELSE 0 END"


@query(f"""{SCORED} SELECT series_id, round(avg(abs(mean - y)), 6) AS mae, round(sqrt(avg((mean - y) * (mean - y))), 6) AS rmse, round(100.0::DOUBLE * avg(2.0::DOUBLE * abs(mean - y) / greatest(abs(mean) + abs(y), 1e-12)), 5) AS smape,
  round(avg(CASE WHEN y >= lower AND y <= upper THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(upper - lower), 6) AS mean_width, round(avg({_IS}), 5) AS interval_score_95 FROM g GROUP BY ALL""")
def mae_rmse_smape(spark, sf):
    a = W.accuracy(_scored(spark, sf), ["series_id"])
    return a.select("series_id", r("mae"), r("rmse"), r("smape", 5), r("coverage"), r("mean_width"), r("interval_score_95", 5))


@query(f"{SCORED} SELECT series_id, t, round({_IS}, 6) AS score FROM g")
def interval_score(spark, sf):
    return _scored(spark, sf).select("series_id", "t", F.round(W.interval_score("y", "lower", "upper", 0.05), 6).alias("score"))


@query(f"{SCORED} SELECT series_id, round(avg(0.5::DOUBLE * (ln(2 * pi() * greatest(sd * sd, 1e-10)) + (y - mean) * (y - mean) / greatest(sd * sd, 1e-10))), 6) AS nlpd FROM g GROUP BY ALL")
def nlpd(spark, sf):
    return W.nlpd(_scored(spark, sf), ["series_id"]).select("series_id", r("nlpd"))


_U = lambda lo, hi, a: f"{hi} - {lo} + CASE WHEN y < {lo} THEN {2 / a!r}::DOUBLE * ({lo} - y) ELSE 0 END + CASE WHEN y > {hi} THEN {2 / a!r}::DOUBLE * (y - {hi}) ELSE 0 END"
PATHS = f"paths AS (SELECT nation.n_nationkey AS target, d.i AS draw, n_regionkey / 3.0::DOUBLE - 0.5::DOUBLE AS y, {O.phi_inv(O.uniform(5, 'nation.n_nationkey', 'd.i'))} AS value FROM nation, (SELECT unnest(range(200)) AS i) d)"


@query(f"""WITH {PATHS}, q AS (SELECT target, y, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.025) AS q025, quantile_cont(value, 0.975) AS q975 FROM paths GROUP BY ALL)
  SELECT target, round((0.5::DOUBLE * abs(y - q50) + 0.1::DOUBLE * ({_U('q10', 'q90', 0.2)}) + 0.025::DOUBLE * ({_U('q025', 'q975', 0.05)})) / 0.625::DOUBLE, 6) AS wis FROM q""")
def wis(spark, sf):
    from ..functions.special import normal

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("target"), (F.col("n_regionkey") / 3.0 - 0.5).alias("y"))
    paths = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("value", normal(5, "target", "draw"))
    return W.weighted_interval_score(paths, ["target"]).select("target", r("wis"))


ORIGINS, CANDIDATES = (400, 800, 1200), (0.01, 0.05, 0.2)
_CAND = " UNION ALL ".join(f"""SELECT {q!r}::DOUBLE AS q, series_id, t, y, pm FROM (WITH RECURSIVE spans AS (SELECT DISTINCT series_id FROM series), {O.kalman(q, R, M0, P0)} SELECT k.series_id, k.t, s.y, k.pm FROM k JOIN series s USING (series_id, t))""" for q in CANDIDATES)


@query(f"""{SER}, c AS ({_CAND}), e AS (SELECT q, series_id, o.o AS origin, avg(abs(y - pm)) AS mae FROM c JOIN (SELECT unnest([400, 800, 1200]) AS o) o ON t >= o.o AND t < o.o + 30 WHERE y IS NOT NULL GROUP BY ALL),
  m AS (SELECT series_id, q, avg(mae) AS score FROM e GROUP BY ALL) SELECT series_id, arg_min(q, score) AS candidate, round(min(score), 6) AS score FROM m GROUP BY ALL""")
def rolling_origin_select(spark, sf):
    s = daily_revenue(spark, sf)
    origins = F.filter(F.array(*[F.when((F.col("t") >= o) & (F.col("t") < o + 30), F.lit(o)) for o in ORIGINS]), lambda x: x.isNotNull())
    out = None
    for q in CANDIDATES:
        f = K.kalman_filter(s, K.local_level(q, R, M0, P0)).select("series_id", "t", F.element_at("predicted_mean", 1).alias("mean"))
        e = f.join(s.where("y is not null"), ["series_id", "t"]).withColumn("origin", F.explode(origins)).groupBy("series_id", "origin").agg(F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mae")).withColumn("candidate", F.lit(q))
        out = e if out is None else out.unionByName(e)
    return W.best_candidate(out, ["series_id"], "mae").select("series_id", "candidate", r("score"))


@query(f"""WITH spec(series_id, train, test, period, level, trend, amplitude, noise) AS (VALUES
    ('monthly_easy', 24, 6, 12, 100.0::DOUBLE, 0.60::DOUBLE, 12.0::DOUBLE, 1.5::DOUBLE), ('monthly_medium', 24, 6, 12, 120.0, 0.80, 10.0, 5.0), ('monthly_hard', 24, 6, 12, 90.0, -0.30, 6.0, 9.0),
    ('weekly_easy', 104, 26, 52, 200.0, 0.15, 20.0, 4.0), ('weekly_medium', 104, 26, 52, 180.0, 0.10, 16.0, 9.0), ('weekly_hard', 104, 26, 52, 150.0, -0.05, 12.0, 16.0)),
  r AS (SELECT *, unnest(range(train + test))::INTEGER AS t FROM spec),
  m AS (SELECT *, level + trend * t + amplitude * sin(2.0::DOUBLE * pi() * t / period) AS mean FROM r)
  SELECT series_id, t, period, round(mean + noise * {O.phi_inv(O.uniform(20260802, 'series_id', 't'))}, 6) AS value, round(mean, 6) AS latent_mean, CASE WHEN t < train THEN 'train' ELSE 'test' END AS split FROM m""")
def study_generator(spark, sf):
    return study_series(spark).select("series_id", "t", "period", r("value"), r("latent_mean"), "split")


@query()
def drift_adjusted_seasonal_forecast(spark, sf):
    """The study's drift-adjusted seasonal model on its monthly series: drift out, standardise, fit, forecast, put back."""
    from ..operators import structural as T

    train = study_series(spark).where("split = 'train' and period = 12").select("series_id", "t", F.col("value").alias("y"))
    drift = W.cycle_drift(train, 12).select("series_id", (F.col("drift") / 12).alias("drift"))
    flat = train.join(drift, "series_id").withColumn("y", F.col("y") - F.col("drift") * F.col("t"))
    z = W.standardised(flat)
    centre = flat.groupBy("series_id").agg(F.avg("y").alias("c"), F.stddev_samp("y").alias("s"), F.first("drift").alias("drift"))
    prior = lambda v: T.InverseGammaPrior(3.0, v)
    fitted = T.fit(z.select("series_id", "t", F.col("z").alias("y")), T.SeasonalLocalLevel(12, prior(0.04), prior(0.015), prior(0.65), initial_level_variance=4.0, initial_seasonal_variance=1.0), chains=2, draws=200, warmup=100)
    paths = T.forecast_seasonal(fitted, 6).join(centre, "series_id")
    back = paths.withColumn("value", F.col("observation") * F.col("s") + F.col("c") + F.col("drift") * (23 + F.col("step")))
    return back.groupBy("series_id", "step").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"))


def flagship(spark, sf):
    """Daily revenue, local-level Kalman filter, 7-day forecast with 95 % intervals, and running totals."""
    return K.gaussian_interval(_forecast(spark, sf), "obs_mean", "obs_var")


