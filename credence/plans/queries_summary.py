"""Queries over draws in long form: posterior summaries, diagnostics, telemetry, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import summary as S
from ..sources.tables import event_draws, table
from . import oracle as O  # noqa: E741

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(name, digits=6):
    return F.round(name, digits).alias(name)


D = f"WITH {O.DRAWS}"


@query(f"{D} SELECT param, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value), 6) AS std_sample, count(*) AS n FROM draws GROUP BY param")
def posterior_mean_std(spark, sf):
    return S.mean_std(event_draws(spark, sf)).select("param", r("mean"), r("std"), r("std_sample"), "n")


@query(f"{D} SELECT param, round(quantile_cont(value, 0.05), 6) AS q_0_05, round(quantile_cont(value, 0.5), 6) AS q_0_5, round(quantile_cont(value, 0.95), 6) AS q_0_95 FROM draws GROUP BY param")
def path_quantiles(spark, sf):
    return S.quantiles(event_draws(spark, sf), (0.05, 0.5, 0.95)).select("param", r("q_0_05"), r("q_0_5"), r("q_0_95"))


@query(f"{D}, o AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY param) AS n FROM draws) SELECT param, round(value, 6) AS quantile FROM o WHERE i = floor(0.9::DOUBLE * (n - 1))")
def truncating_quantile(spark, sf):
    return S.truncating_quantile(event_draws(spark, sf), 0.9).select("param", r("quantile"))


@query(f"{D} SELECT param, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM draws GROUP BY param")
def equal_tailed_interval(spark, sf):
    return S.interval(event_draws(spark, sf), 0.95).select("param", r("lower"), r("upper"))


def _hdi_sql(steps: str) -> str:
    return f"""{D}, o AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS i, count(*) OVER (PARTITION BY param) AS n FROM draws),
  w AS (SELECT a.param, a.i, a.value AS lower, b.value AS upper FROM o a JOIN o b ON a.param = b.param AND b.i = a.i + {steps})
  SELECT param, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY upper - lower, i) AS k FROM w) WHERE k = 1"""


@query(_hdi_sql("ceil(0.94::DOUBLE * a.n)::BIGINT - 1"))
def hdi_94(spark, sf):
    return S.hdi(event_draws(spark, sf), 0.94).select("param", r("lower"), r("upper"))


@query(_hdi_sql("floor(0.95::DOUBLE * a.n)::BIGINT"))
def hdi_study_variant(spark, sf):
    return S.hdi(event_draws(spark, sf), 0.95, gap="floor").select("param", r("lower"), r("upper"))


@query(f"{D}, z AS {O.ranked('draws', 'param, chain, draw')} SELECT param, chain, draw, round(value, 6) AS value FROM z")
def rank_normalize(spark, sf):
    return S.rank_normalised(event_draws(spark, sf)).select("param", "chain", "draw", r("value"))


@query(f"{D}, {O.SPLIT.format(draws='draws')} SELECT param, half, count(*) AS n, round(avg(value), 6) AS mean FROM split GROUP BY ALL")
def split_chains(spark, sf):
    return S.split_chains(event_draws(spark, sf)).groupBy("param", "half").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


RHAT = f"""{D}, {O.SPLIT.format(draws='draws')}, ranked AS {O.ranked('split', 'param, half')}, med AS (SELECT param, quantile_cont(value, 0.5) AS m FROM split GROUP BY param),
  folded AS (SELECT s.param, half, abs(value - m) AS value FROM split s JOIN med USING (param)), rf AS {O.ranked('folded', 'param, half')}, a AS {O.r_hat('ranked')}, b AS {O.r_hat('rf')}"""


@query(f"{RHAT} SELECT a.param, round(greatest(a.r, b.r), 6) AS r_hat FROM a JOIN b USING (param)")
def split_rhat(spark, sf):
    return S.split_r_hat(event_draws(spark, sf)).select("param", r("r_hat"))


@query(f"{RHAT} SELECT a.param, round(b.r, 6) AS r_hat_folded FROM a JOIN b USING (param)")
def folded_rhat(spark, sf):
    return S.split_r_hat(event_draws(spark, sf), parts=True).select("param", r("r_hat_folded"))


@query(f"{D}, e AS {O.ess('draws')} SELECT param, round(ess, 3) AS ess FROM e")
def ess_plain(spark, sf):
    return S.ess(event_draws(spark, sf)).select("param", r("ess", 3))


@query(f"{D}, z AS {O.ranked('draws', 'param, chain, draw')}, e AS {O.ess('z')} SELECT param, round(ess, 3) AS ess_bulk FROM e")
def ess_bulk(spark, sf):
    return S.ess_bulk(event_draws(spark, sf)).select("param", r("ess_bulk", 3))


@query(f"""{D}, q AS (SELECT param, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM draws GROUP BY param),
  dl AS (SELECT d.param, chain, draw, CASE WHEN value <= lo THEN 1.0::DOUBLE ELSE 0 END AS value FROM draws d JOIN q USING (param)), dh AS (SELECT d.param, chain, draw, CASE WHEN value >= hi THEN 1.0::DOUBLE ELSE 0 END AS value FROM draws d JOIN q USING (param)),
  a AS {O.ess('dl')}, b AS {O.ess('dh')} SELECT a.param, round(least(a.ess, b.ess), 3) AS ess_tail FROM a JOIN b USING (param)""")
def ess_tail(spark, sf):
    return S.ess_tail(event_draws(spark, sf)).select("param", r("ess_tail", 3))


@query(f"{D}, e AS {O.ess('draws')}, s AS (SELECT param, stddev_samp(value) AS s FROM draws GROUP BY param) SELECT param, round(s / sqrt(ess), 6) AS mcse_mean FROM s JOIN e USING (param)")
def mcse(spark, sf):
    return S.mcse(event_draws(spark, sf)).select("param", r("mcse_mean"))


@query()
def diagnostics_table(spark, sf):
    return S.diagnostics(event_draws(spark, sf))


@query(f"{D} SELECT param, chain, count(*) AS n, round(min_by(value, draw), 6) AS first, round(max_by(value, draw), 6) AS last FROM draws GROUP BY ALL")
def samples_by_chain(spark, sf):
    return event_draws(spark, sf).groupBy("param", "chain").agg(F.count("*").alias("n"), F.round(F.min_by("value", "draw"), 6).alias("first"), F.round(F.max_by("value", "draw"), 6).alias("last"))


TEL = """t AS (SELECT (event_id % 4)::INTEGER AS chain, (event_id // 4) AS iter, (event_id // 4) < 100 AS is_warmup, user_id % 3 > 0 AS accepted, value / (1 + value) AS accept_prob, value / 10 - 2 AS energy_error, user_id % 97 = 0 AS divergent, 0.1::DOUBLE + (event_id % 7) / 100 AS step_size,
  (event_id % 15 + 1)::INTEGER AS num_leapfrog_steps, (event_id % 5)::INTEGER AS tree_depth FROM events)"""


def _telemetry(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    return e.select(
        (i % 4).cast("int").alias("chain"), F.floor(i / 4).alias("iter"), (F.floor(i / 4) < 100).alias("is_warmup"), (F.col("user_id") % 3 > 0).alias("accepted"), (F.col("value") / (1 + F.col("value"))).alias("accept_prob"), (F.col("value") / 10 - 2).alias("energy_error"),
        (F.col("user_id") % 97 == 0).alias("divergent"), (F.lit(0.1) + (i % 7) / 100).alias("step_size"), (i % 15 + 1).cast("int").alias("num_leapfrog_steps"), (i % 5).cast("int").alias("tree_depth"),
    )


@query(f"""WITH {TEL} SELECT chain, count(*) AS transitions, count(*) FILTER (WHERE is_warmup) AS warmup_transitions, count(*) FILTER (WHERE NOT is_warmup) AS draw_transitions, count(*) FILTER (WHERE NOT is_warmup AND divergent) AS divergences,
  count(*) FILTER (WHERE NOT is_warmup AND accepted) AS accepted, round(coalesce(avg(accept_prob) FILTER (WHERE NOT is_warmup), 0), 6) AS mean_accept_prob, round(avg(energy_error), 6) AS mean_energy_error, round(max(abs(energy_error)), 6) AS max_abs_energy_error,
  round(avg(step_size), 6) AS mean_step_size, max(tree_depth) AS max_tree_depth, sum(num_leapfrog_steps)::BIGINT AS leapfrog_steps FROM t GROUP BY chain""")
def transition_telemetry(spark, sf):
    t = S.transition_report(_telemetry(spark, sf))
    return t.select("chain", "transitions", "warmup_transitions", "draw_transitions", "divergences", "accepted", r("mean_accept_prob"), r("mean_energy_error"), r("max_abs_energy_error"), r("mean_step_size"), "max_tree_depth", "leapfrog_steps")


@query(f"WITH {TEL} SELECT chain, count(*) AS kept, sum(iter)::BIGINT AS iters FROM t WHERE iter >= 100 AND (iter + 1 - 100) % 5 = 0 GROUP BY chain")
def thinned_draws(spark, sf):
    return S.thinned(_telemetry(spark, sf), 100, 5).groupBy("chain").agg(F.count("*").alias("kept"), F.sum("iter").alias("iters"))


PATHS = f"paths AS (SELECT c.i::INTEGER AS chain, d.i::INTEGER AS draw, s.i::INTEGER AS step, n_regionkey AS group_id, n_nationkey AS program_id, {O.phi_inv(O.uniform(9, 'n_nationkey', 'c.i', 'd.i', 's.i'))} + n_regionkey AS observation FROM nation, (SELECT unnest(range(2)) AS i) c, (SELECT unnest(range(50)) AS i) d, (SELECT unnest(range(1, 5)) AS i) s)"


def _paths(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_id"), F.col("n_nationkey").alias("program_id"))
    for name, lo, hi in (("chain", 0, 1), ("draw", 0, 49), ("step", 1, 4)):
        n = n.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return n.withColumn("observation", special.normal(9, "program_id", "chain", "draw", "step") + F.col("group_id"))


@query(f"WITH {PATHS}, g AS (SELECT chain, draw, step, group_id, sum(observation) AS v FROM paths GROUP BY ALL) SELECT group_id, step, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS q90 FROM g GROUP BY ALL")
def group_rollup(spark, sf):
    g = S.rollup_paths(_paths(spark, sf)).where("group_id is not null")
    return g.groupBy("group_id", "step").agg(F.round(F.avg("observation"), 6).alias("mean"), F.round(F.percentile("observation", F.lit(0.9)), 6).alias("q90"))


@query(f"WITH {PATHS}, g AS (SELECT chain, draw, step, sum(observation) AS v FROM paths GROUP BY ALL) SELECT step, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS q90 FROM g GROUP BY ALL")
def total_rollup(spark, sf):
    g = S.rollup_paths(_paths(spark, sf)).where("group_id is null")
    return g.groupBy("step").agg(F.round(F.avg("observation"), 6).alias("mean"), F.round(F.percentile("observation", F.lit(0.9)), 6).alias("q90"))


@query(f"WITH {PATHS} SELECT program_id, step, round(avg(observation), 6) AS mean, round(quantile_cont(observation, 0.05), 6) AS lower, round(quantile_cont(observation, 0.95), 6) AS upper FROM paths GROUP BY ALL")
def program_path_summary(spark, sf):
    return _paths(spark, sf).groupBy("program_id", "step").agg(F.round(F.avg("observation"), 6).alias("mean"), F.round(F.percentile("observation", F.lit(0.05)), 6).alias("lower"), F.round(F.percentile("observation", F.lit(0.95)), 6).alias("upper"))


@query(f"WITH {PATHS} SELECT group_id, step, round(avg(v), 5) AS mean FROM (SELECT chain, draw, step, group_id, sum(exp(observation)) AS v FROM paths GROUP BY ALL) GROUP BY ALL")
def exp_before_aggregate(spark, sf):
    p = _paths(spark, sf).withColumn("value", F.exp("observation")).groupBy("chain", "draw", "step", "group_id").agg(F.sum("value").alias("v"))
    return p.groupBy("group_id", "step").agg(F.round(F.avg("v"), 5).alias("mean"))


@query(f"{D} SELECT chain, draw FROM (SELECT DISTINCT chain, draw FROM draws) ORDER BY {O.uniform(42, 'chain', 'draw')}, chain, draw LIMIT 20")
def draw_subsample(spark, sf):
    return S.draw_subsample(event_draws(spark, sf), 20)


# --- special functions and random numbers

P = "(l_discount * 9.0::DOUBLE + 0.05::DOUBLE)"


@query(f"SELECT l_returnflag, count(*) AS n, round(sum({O.phi_inv(P)}), 5) AS z, round(sum({O.ln_gamma('l_quantity')}), 3) AS lg, round(sum({O.softplus('(l_quantity - 25)')}), 4) AS sp, round(sum(ln({P} / (1 - {P}))), 5) AS lo, round(sum(ln(exp(l_tax) + exp(l_discount))), 5) AS lse FROM lineitem GROUP BY ALL")
def special_functions(spark, sf):
    p = F.col("l_discount") * 9.0 + 0.05
    s = lambda c, d: F.round(F.sum(c), d)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), s(special.inv_normal_cdf(p), 5).alias("z"), s(special.ln_gamma("l_quantity"), 3).alias("lg"), s(special.softplus(F.col("l_quantity") - 25), 4).alias("sp"),
        s(special.logit(p), 5).alias("lo"), s(special.log_sum_exp("l_tax", "l_discount"), 5).alias("lse"),
    )


@query(f"SELECT o_orderpriority, round(avg({O.uniform(3, 'o_orderkey')}), 9) AS u, round(avg({O.phi_inv(O.uniform(3, 'o_orderkey'))}), 6) AS z, round(avg(-ln(1 - {O.uniform(3, 'o_orderkey')}) / 2), 6) AS e FROM orders GROUP BY ALL")
def counter_rng(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.round(F.avg(special.uniform(3, "o_orderkey")), 9).alias("u"), F.round(F.avg(special.normal(3, "o_orderkey")), 6).alias("z"), F.round(F.avg(special.exponential(3, 2.0, "o_orderkey")), 6).alias("e"),
    )


SIG = "(1 / (1 + exp(-(l_discount * 10))))"


@query(f"SELECT l_linenumber, round(avg(exp(l_discount)), 7) AS e, round(avg({SIG}), 7) AS s, round(avg(-1 + 4 * {SIG}), 7) AS b, round(avg(4 * {SIG} * (1 - {SIG})), 7) AS d, round(avg(l_discount * 10), 7) AS back FROM lineitem GROUP BY ALL")
def transform_roundtrip(spark, sf):
    raw = F.col("l_discount") * 10
    b = special.transform("bounded", raw, -1, 3)
    a = lambda c, n: F.round(F.avg(c), 7).alias(n)
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(
        a(special.transform("exp", "l_discount"), "e"), a(special.transform("sigmoid", raw), "s"), a(b, "b"), a(special.derivative("bounded", raw, -1, 3), "d"), a(special.inverse("bounded", b, -1, 3), "back"),
    )


@query("SELECT round(max(levenshtein(n_name, 'GERMONY')), 0)::INTEGER AS far, min(levenshtein(n_name, 'GERMONY'))::INTEGER AS near, arg_min(n_name, levenshtein(n_name, 'GERMONY') * 1000 + n_nationkey) AS meant FROM nation")
def name_suggestion(spark, sf):
    d = F.levenshtein("n_name", F.lit("GERMONY"))
    return table(spark, sf, "nation").agg(F.max(d).alias("far"), F.min(d).alias("near"), F.min_by("n_name", d * 1000 + F.col("n_nationkey")).alias("meant"))
