"""Queries over declared models: densities, predictors, binding, sampling, predictive draws, fitted series models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import densities as L
from ..functions.special import exponential, normal
from ..operators import fits, panel
from ..operators import predictive as P
from ..operators import quality as V
from ..operators import samplers as H
from ..operators import series as W
from ..operators import structural as M
from ..operators import summary as S
from ..sources.tables import daily_revenue, regression_problem, shared_folder, table
from . import oracle as O  # noqa: E741
from .model import Model, ModelBuilder
from .queries_series import programs

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


LN = "0.9189385332046727::DOUBLE"
BY = ["l_returnflag"]


def _sum(df, value, by="l_returnflag", digits=3):
    return df.groupBy(by).agg(F.round(F.sum(value), digits).alias("logp"), F.count("*").alias("n"))


def _sum_sql(value: str, source: str = "lineitem", by: str = "l_returnflag") -> str:
    return f"SELECT {by}, round(sum({value}), 3) AS logp, count(*) AS n FROM {source} GROUP BY ALL"


@query(_sum_sql(f"-{LN} - ln(0.7::DOUBLE) - 0.5::DOUBLE * pow((l_extendedprice / 10000 - (0.3::DOUBLE + 0.08::DOUBLE * l_quantity)) / 0.7::DOUBLE, 2)"))
def logp_normal(spark, sf):
    return _sum(table(spark, sf, "lineitem"), L.normal(F.col("l_extendedprice") / 10000, F.lit(0.3) + 0.08 * F.col("l_quantity"), 0.7))


ETA = "(-1.0::DOUBLE + 2.0::DOUBLE * l_discount)"


@query(_sum_sql(f"CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END * {ETA} - {O.softplus(ETA)}"))
def logp_bernoulli(spark, sf):
    return _sum(table(spark, sf, "lineitem"), L.bernoulli_logit((F.col("l_linestatus") == "O").cast("double"), F.lit(-1.0) + 2.0 * F.col("l_discount")))


COUNTS = "(SELECT l_orderkey % 5 AS g, l_orderkey, count(*)::DOUBLE AS y, avg(l_discount) AS x FROM lineitem GROUP BY ALL)"
CETA = "(1.2::DOUBLE + 2.0::DOUBLE * x)"


def _counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("g"), "l_orderkey").agg(F.count("*").cast("double").alias("y"), F.avg("l_discount").alias("x"))


@query(_sum_sql(f"y * {CETA} - exp({CETA}) - {O.ln_gamma('(y + 1.0::DOUBLE)')}", COUNTS, "g"))
def logp_poisson(spark, sf):
    return _sum(_counts(spark, sf), L.poisson_log("y", F.lit(1.2) + 2.0 * F.col("x")), "g")


NB = f"ln(2.5::DOUBLE + exp({CETA}))"


@query(_sum_sql(f"{O.ln_gamma('(y + 2.5::DOUBLE)')} - {O.ln_gamma('2.5::DOUBLE')} - {O.ln_gamma('(y + 1.0::DOUBLE)')} + 2.5::DOUBLE * (ln(2.5::DOUBLE) - {NB}) + y * ({CETA} - {NB})", COUNTS, "g"))
def logp_negbinomial(spark, sf):
    return _sum(_counts(spark, sf), L.negative_binomial_log("y", F.lit(1.2) + 2.0 * F.col("x"), 2.5), "g")


@query("SELECT o_orderpriority, round(sum(0.2::DOUBLE - o_totalprice / 100000 * exp(0.2::DOUBLE)), 3) AS logp, count(*) AS n FROM orders GROUP BY ALL")
def logp_exponential(spark, sf):
    return _sum(table(spark, sf, "orders"), L.exponential_log(F.col("o_totalprice") / 100000, 0.2), "o_orderpriority")


@query(_sum_sql(f"-{LN} - ln(0.6::DOUBLE) - ln(l_extendedprice) - 0.5::DOUBLE * pow((ln(l_extendedprice) - 10.0::DOUBLE) / 0.6::DOUBLE, 2)"))
def logp_lognormal(spark, sf):
    return _sum(table(spark, sf, "lineitem"), L.log_normal("l_extendedprice", 10.0, 0.6))


X = "(l_discount + 0.05::DOUBLE)"
_lg = O.ln_gamma
PRIOR_SQL = {
    "normal": f"-{LN} - ln(2.0::DOUBLE) - 0.5::DOUBLE * pow(({X} - 0.1::DOUBLE) / 2.0::DOUBLE, 2)",
    "half_normal": f"0.5::DOUBLE * ln(2 / pi()) - ln(1.5::DOUBLE) - 0.5::DOUBLE * pow({X} / 1.5::DOUBLE, 2)",
    "exponential": f"ln(3.0::DOUBLE) - 3.0::DOUBLE * {X}",
    "log_normal": f"-{LN} - ln(0.8::DOUBLE) - ln({X}) - 0.5::DOUBLE * pow((ln({X}) + 2.0::DOUBLE) / 0.8::DOUBLE, 2)",
    "student_t": f"{_lg('2.5::DOUBLE')} - {_lg('2.0::DOUBLE')} - 0.5::DOUBLE * ln(4 * pi()) - ln(0.5::DOUBLE) - 2.5::DOUBLE * ln(1 + pow(({X} - 0.2::DOUBLE) / 0.5::DOUBLE, 2) / 4)",
    "uniform": "-ln(3.0::DOUBLE)",
    "gamma": f"2.0::DOUBLE * ln(4.0::DOUBLE) - {_lg('2.0::DOUBLE')} + ln({X}) - 4.0::DOUBLE * {X}",
    "beta": f"{_lg('7.0::DOUBLE')} - {_lg('2.0::DOUBLE')} - {_lg('5.0::DOUBLE')} + ln({X}) + 4.0::DOUBLE * ln(1 - {X})",
    "inverse_gamma": f"3.0::DOUBLE * ln(0.2::DOUBLE) - {_lg('3.0::DOUBLE')} - 4.0::DOUBLE * ln({X}) - 0.2::DOUBLE / {X}",
    "bernoulli": "CASE WHEN l_linenumber % 2 = 1 THEN ln(0.3::DOUBLE) ELSE ln(0.7::DOUBLE) END",
    "poisson": f"l_linenumber * ln(3.0::DOUBLE) - 3.0::DOUBLE - {_lg('(l_linenumber + 1.0::DOUBLE)')}",
}
PRIOR_ARGS = {
    "normal": (0.1, 2.0), "half_normal": (1.5,), "exponential": (3.0,), "log_normal": (-2.0, 0.8), "student_t": (4.0, 0.2, 0.5), "uniform": (-1.0, 2.0), "gamma": (2.0, 4.0), "beta": (2.0, 5.0),
    "inverse_gamma": (3.0, 0.2), "bernoulli": (0.3,), "poisson": (3.0,),
}


def _prior_query(name: str):
    def run(spark, sf):
        x = {"bernoulli": (F.col("l_linenumber") % 2).cast("double"), "poisson": F.col("l_linenumber").cast("double")}.get(name, F.col("l_discount") + 0.05)
        return _sum(table(spark, sf, "lineitem"), L.PRIORS[name](x, *PRIOR_ARGS[name]))

    run.__name__ = f"logp_prior_{name}"
    return run


for _name, _sql in PRIOR_SQL.items():
    query(_sum_sql(_sql))(_prior_query(_name))


@query("SELECT l_orderkey, l_linenumber, round(1.5::DOUBLE + 0.2::DOUBLE * l_quantity - 3.0::DOUBLE * l_discount + 0.25::DOUBLE * l_tax, 8) AS eta FROM lineitem")
def linear_predictor_fused(spark, sf):
    b = ModelBuilder()
    refs = [b.normal_prior(n, 0, 1) for n in ("a", "b1", "b2", "b3")]
    b.normal_likelihood("y", refs[0] + refs[1] * "l_quantity" + refs[2] * "l_discount" + refs[3] * "l_tax" + 0.5, 1.0, "l_extendedprice")
    m = b.compile()
    values = {"a": 1.0, "b1": 0.2, "b2": -3.0, "b3": 0.25}
    eta = m.predictor(m.likelihoods[0], {k: F.lit(v) for k, v in values.items()})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(eta, 8).alias("eta"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * (1.0::DOUBLE / i))), 5) AS eta FROM embeddings")
def matvec_predictor(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    b = ModelBuilder()
    b.normal_likelihood("y", b.vector_normal_prior("beta", 64) @ "x", 1.0, "y")
    m = b.compile()
    eta = m.predictor(m.likelihoods[0], {"beta": F.array(*[F.lit(1.0 / i) for i in range(1, 65)])})
    return e.select("vec_id", F.round(eta, 5).alias("eta"))


@query(f"SELECT i::BIGINT AS sample, round(1.0::DOUBLE + 2.0::DOUBLE * {O.phi_inv(O.uniform(11, chr(39) + 'mu' + chr(39), 'i'))}, 6) AS mu, round(abs({O.phi_inv(O.uniform(11, chr(39) + 'tau' + chr(39), 'i'))}) * 0.5::DOUBLE, 6) AS tau, round(-ln(1 - {O.uniform(11, chr(39) + 'rate' + chr(39), 'i')}) / 3, 6) AS rate FROM (SELECT unnest(range(500)) AS i)")
def prior_predictive_normal(spark, sf):
    z = lambda n: normal(11, F.lit(n), "sample")
    return spark.range(500).withColumnRenamed("id", "sample").select("sample", F.round(1.0 + 2.0 * z("mu"), 6).alias("mu"), F.round(F.abs(z("tau")) * 0.5, 6).alias("tau"), F.round(exponential(11, 3.0, F.lit("rate"), "sample"), 6).alias("rate"))


@query(f"SELECT n_nationkey, round(n_regionkey + exp({O.phi_inv(O.uniform(12, 'n_regionkey'))}) * {O.phi_inv(O.uniform(13, 'n_nationkey'))}, 6) AS value FROM nation")
def noncentered_rebuild(spark, sf):
    n = table(spark, sf, "nation").withColumn("mu", F.col("n_regionkey").cast("double")).withColumn("sigma", F.exp(normal(12, "n_regionkey"))).withColumn("raw", normal(13, "n_nationkey"))
    return n.select("n_nationkey", F.round(F.col("mu") + F.col("sigma") * F.col("raw"), 6).alias("value"))


def regression_model() -> Model:
    b = ModelBuilder()
    alpha, beta, sigma = b.normal_prior("alpha", 0, 10), b.normal_prior("beta", 0, 10), b.half_normal_prior("sigma", 5)
    b.normal_likelihood("y", alpha + beta * "x", sigma, "y")
    return b.compile()


def _lines(spark, sf):
    """A regression for each return flag: price in 10,000 on quantity in 10."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset_id"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"))
    return rows


def _fixed_draws(spark):
    """Draws that SQL can repeat: alpha and beta near 0 and 1.5, sigma near 1.5."""
    grid = spark.range(10).select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("dataset_id"), (F.col("id") % 2).cast("int").alias("chain"), F.floor(F.col("id") / 2).cast("int").alias("draw"))
    values = {"alpha": 0.1 * normal(14, F.lit("alpha"), "chain", "draw"), "beta": 1.5 + 0.1 * normal(14, F.lit("beta"), "chain", "draw"), "sigma": F.exp(0.4 + 0.1 * normal(14, F.lit("sigma"), "chain", "draw"))}
    one = F.array(*[F.struct(F.lit(k).alias("param"), F.lit(None).cast("int").alias("idx"), v.alias("value")) for k, v in values.items()])
    return grid.select("*", F.explode(one).alias("x")).select("dataset_id", "chain", "draw", "x.*")


_z = lambda n: O.phi_inv(O.uniform(14, f"'{n}'", "chain", "draw"))
FIXED = f"d AS (SELECT chain, draw, 0.1::DOUBLE * {_z('alpha')} AS alpha, 1.5::DOUBLE + 0.1::DOUBLE * {_z('beta')} AS beta, exp(0.4::DOUBLE + 0.1::DOUBLE * {_z('sigma')}) AS sigma FROM (SELECT (i % 2)::INTEGER AS chain, (i // 2)::INTEGER AS draw FROM (SELECT unnest(range(10)) AS i)))"
_LL = f"-{LN} - ln(sigma) - 0.5::DOUBLE * pow((l_extendedprice / 10000 - (alpha + beta * (l_quantity / 10))) / sigma, 2)"


@query(f"WITH {FIXED} SELECT l_returnflag AS dataset_id, chain, draw, count(*) AS n, round(sum({_LL}), 3) AS logp, round(min({_LL}), 5) AS worst FROM lineitem, d GROUP BY ALL")
def pointwise_loglik(spark, sf):
    ll = P.pointwise_log_likelihood(_fixed_draws(spark), _lines(spark, sf), regression_model())
    return ll.groupBy("dataset_id", "chain", "draw").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("logp"), F.round(F.min("value"), 5).alias("worst"))


@query("SELECT l_returnflag AS dataset_id, count(*) AS n_obs, 0::BIGINT AS finite_y, 0::BIGINT AS finite_x FROM lineitem GROUP BY ALL")
def batch_bind_validation(spark, sf):
    m = regression_model()
    return m.checks(m.bind(_lines(spark, sf), strict=False))


@query("SELECT l_returnflag AS dataset_id, count(*) AS n, round(sum(l_quantity / 10), 4) AS sx, round(sum((l_quantity / 10) * (l_quantity / 10)), 4) AS sxx, round(sum((l_quantity / 10) * (l_extendedprice / 10000)), 4) AS sxy, round(sum((l_extendedprice / 10000) * (l_extendedprice / 10000)), 4) AS syy FROM lineitem GROUP BY ALL")
def gaussian_sufficient_stats(spark, sf):
    m = regression_model()
    s = m.gaussian_stats(m.bind(_lines(spark, sf), strict=False))
    (mx, my), centred, n = (F.get("m0", F.lit(k)) for k in (0, 1)), [F.get("s0", F.lit(k)) for k in range(3)], F.col("n")  # order: xx, xy, yy
    raw = [c + n * a * b for c, a, b in zip(centred, (mx, mx, my), (mx, my, my))]
    return s.select("dataset_id", "n", F.round(n * mx, 4).alias("sx"), *[F.round(c, 4).alias(name) for c, name in zip(raw, ("sxx", "sxy", "syy"))])


@query(f"SELECT (i % 3)::VARCHAR AS dataset_id, (i // 3) / 10.0::DOUBLE AS x, round({O.phi_inv(O.uniform(15, 'i'))}, 6) AS y FROM (SELECT unnest(range(60)) AS i)")
def shared_inputs_bind(spark, sf):
    shared = spark.range(20).select(F.col("id").alias("row_idx"), (F.col("id") / 10.0).alias("x"))
    own = spark.range(60).select((F.col("id") % 3).cast("string").alias("dataset_id"), F.floor(F.col("id") / 3).alias("row_idx"), normal(15, "id").alias("y"))
    return regression_model().bind(own, shared).select("dataset_id", "x", r("y"))


@query(f"SELECT (i % 3)::VARCHAR AS dataset_id, (i // 3) / 5.0::DOUBLE AS x, round({O.phi_inv(O.uniform(15, 'i // 3'))}, 6) AS y FROM (SELECT unnest(range(60)) AS i)")
def bind_overrides(spark, sf):
    """Defaults x and y by row; the datasets' own x takes the place of the default."""
    defaults = spark.range(20).select(F.col("id").alias("row_idx"), (F.col("id") / 10.0).alias("x"), normal(15, "id").alias("y"))
    own = spark.range(60).select((F.col("id") % 3).cast("string").alias("dataset_id"), F.floor(F.col("id") / 3).alias("row_idx")).withColumn("x", F.col("row_idx") / 5.0)
    return regression_model().bind(own, defaults, override=True).select("dataset_id", "x", r("y"))


@query()
def model_artifact(spark, sf):
    m = Model.from_json(regression_model().to_json())
    return spark.createDataFrame([(m.to_json(), ",".join(m.param_names), ",".join(m.required_keys), m.schema.simpleString())], "artifact string, params string, required string, data_schema string")


@query()
def nuts_regression(spark, sf):
    draws = H.sample(regression_model(), _lines(spark, sf), chains=2, draws=300, warmup=300).persist()  # read for each summary
    return S.diagnostics(draws, ["dataset_id", "param"])


_EXACT = """s AS (SELECT l_returnflag AS dataset_id, count(*) + 1 AS n, sum(l_quantity / 10) AS sx, sum(pow(l_quantity / 10, 2)) + 1 AS sxx, sum(l_extendedprice / 10000) AS sy,
    sum((l_quantity / 10) * (l_extendedprice / 10000)) AS sxy FROM lineitem GROUP BY ALL),
  x AS (SELECT dataset_id, unnest(['alpha', 'beta']) AS param, unnest([(sxx * sy - sx * sxy) / (n * sxx - sx * sx), (n * sxy - sx * sy) / (n * sxx - sx * sx)]) AS exact_mean,
    unnest([sqrt(sxx / (n * sxx - sx * sx)), sqrt(n / (n * sxx - sx * sx))]) AS exact_sd FROM s)"""


def known_noise_model() -> Model:
    """A regression whose posterior is known exactly: noise and priors of deviation 1."""
    b = ModelBuilder()
    b.normal_likelihood("y", b.normal_prior("alpha", 0, 1) + b.normal_prior("beta", 0, 1) * "x", 1.0, "y")
    return b.compile()


def _exact(spark, sf):
    return V.exact_marginals(_lines(spark, sf), [F.lit(1.0), "x"], "y", ["alpha", "beta"])


@query(f"WITH {_EXACT} SELECT dataset_id, param, round(exact_mean, 7) AS exact_mean, round(exact_sd, 9) AS exact_sd FROM x")
def exact_marginals(spark, sf):
    return _exact(spark, sf).select("dataset_id", "param", r("exact_mean", 7), r("exact_sd", 9))


@query(f"""WITH {FIXED}, {_EXACT}, m AS (SELECT param, avg(v) AS mean, stddev_samp(v) AS std FROM (SELECT 'alpha' AS param, alpha AS v FROM d UNION ALL SELECT 'beta', beta FROM d) GROUP BY param),
  e AS (SELECT dataset_id, count(*) AS params, sqrt(avg(pow(mean - exact_mean, 2))) AS err, sqrt(avg(pow((mean - exact_mean) / exact_sd, 2))) AS units, sqrt(avg(pow(std / exact_sd - 1, 2))) AS spread FROM m JOIN x USING (param) GROUP BY ALL)
  SELECT dataset_id, params, round(err, 6) AS mean_rmse_vs_exact_posterior, round(units, 3) AS mean_rmse_exact_posterior_sd_units, round(spread, 3) AS sd_relative_rmse_vs_exact_posterior FROM e""")
def posterior_errors(spark, sf):
    summary = S.mean_std(_fixed_draws(spark), ["dataset_id", "param"]).drop("std").withColumnRenamed("std_sample", "std")
    e = V.posterior_errors(summary, _exact(spark, sf))
    return e.select("dataset_id", "params", r("mean_rmse_vs_exact_posterior"), r("mean_rmse_exact_posterior_sd_units", 3), r("sd_relative_rmse_vs_exact_posterior", 3))


@query()
def nuts_quality_gate(spark, sf):
    """A verdict on the sampler's draws for each dataset, at 4 chains of 1000 draws after 500 of warm-up."""
    rows, options = _lines(spark, sf), {"chains": 4, "draws": 1000, "warmup": 500}
    told = S.transition_report(H.sample(known_noise_model(), rows, what="transitions", **options), ["dataset_id"])
    diagnosed = S.diagnostics(H.sample(known_noise_model(), rows, **options), ["dataset_id", "param"])
    return V.quality_gate(V.posterior_quality(diagnosed, _exact(spark, sf), told)).withColumn("failures", F.concat_ws(",", "failures"))


@query()
def hmc_regression(spark, sf):
    draws = H.sample(regression_model(), _lines(spark, sf), chains=2, draws=300, warmup=300, sampler="hmc").persist()
    return S.diagnostics(draws, ["dataset_id", "param"])


@query()
def nuts_telemetry(spark, sf):
    t = H.sample(regression_model(), _lines(spark, sf), chains=2, draws=200, warmup=200, what="transitions")
    return S.transition_report(t, ["dataset_id", "chain"])


def logistic_model() -> Model:
    b = ModelBuilder()
    b.bernoulli_logit_likelihood("flag", b.normal_prior("a", 0, 2) + b.normal_prior("b", 0, 2) * "x", "y")
    return b.compile()


@query()
def nuts_logistic(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = labels.join(docs, "doc_id").select((F.log(F.col("n_chars") + 1.0) - 7).alias("x"), F.col("quality").cast("double").alias("y"))
    return H.sample(logistic_model(), rows, chains=2, draws=200, warmup=200).groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def counts_model(kind: str) -> Model:
    b = ModelBuilder()
    eta = b.normal_prior("a", 0, 2) + b.normal_prior("b", 0, 2) * "x"
    if kind == "poisson":
        b.poisson_log_likelihood("n", eta, "y")
    else:
        b.negative_binomial_likelihood("n", eta, b.gamma_prior("alpha", 2, 0.1), "y")
    return b.compile()


@query()
def nuts_counts_batch(spark, sf):
    """Poisson and negative-binomial models of lines per order, as one batch of different models."""
    rows = _counts(spark, sf).select("x", "y")
    return H.sample_many({"poisson": (counts_model("poisson"), rows), "negative_binomial": (counts_model("nb"), rows)}, draws=100, warmup=100).groupBy("model_id", "param").agg(F.avg("value").alias("mean"))


@query()
def nuts_eight_schools(spark, sf):
    """Non-centred hierarchy: one effect for each school around a population mean."""
    y, sigma = (28, 8, -3, 7, -1, 1, 18, 12), (15, 10, 16, 11, 9, 11, 10, 18)  # fixed values: the eight schools
    b = ModelBuilder()
    mu, tau = b.normal_prior("mu", 0, 5), b.half_normal_prior("tau", 5)
    for i, s in enumerate(sigma):
        theta = b.normal_prior(f"theta{i}", mu, tau)
        b.normal_likelihood(f"school{i}", theta + 0.0, float(s), f"y{i}")
    rows = spark.createDataFrame([tuple(map(float, y))], ", ".join(f"y{i} double" for i in range(8)))
    return S.mean_std(H.sample(b.compile(), rows, chains=2, draws=300, warmup=300))


@query()
def batch_sample(spark, sf):
    """One regression for each supplier, in one plan."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("dataset_id"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    d = H.sample(regression_model(), rows, chains=1, draws=100, warmup=150)
    return d.groupBy("dataset_id", "param").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


@query()
def matrix_regression(spark, sf):
    b = ModelBuilder()
    b.normal_likelihood("y", b.normal_prior("a", 0, 5) + b.vector_normal_prior("beta", 8) @ "x", b.half_normal_prior("sigma", 2), "y")
    return S.mean_std(H.sample(b.compile(), regression_problem(spark, 2000, 8), chains=2, draws=200, warmup=200))


@query()
def posterior_predictive(spark, sf):
    return P.posterior_predictive(_fixed_draws(spark), _lines(spark, sf), regression_model(), n_samples=4).groupBy("dataset_id", "likelihood", "sample").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


@query()
def prior_predictive(spark, sf):
    rows = table(spark, sf, "nation").select(F.lit("0").alias("dataset_id"), F.col("n_nationkey").cast("long").alias("row_idx"), F.col("n_regionkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return P.prior_predictive(rows, regression_model(), 50).groupBy("row_idx").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query()
def prior_draws_discrete(spark, sf):
    b = ModelBuilder()
    b.bernoulli_prior("flip", 0.3)
    b.poisson_prior("count", 2.5)
    b.normal_prior("x", b.normal_prior("mu", 0, 1), b.exponential_prior("s", 1))
    d = P.prior_draws(spark, b.compile(), 300)
    return d.select(*[F.avg(c).alias(c) for c in ("flip", "count", "mu", "s", "x")])


@query()
def export_groups(spark, sf):
    """A fit written as Parquet groups and read again."""
    from pyspark.errors import AnalysisException

    path = f"{shared_folder(spark)}/fit-{np.random.default_rng().integers(1 << 60):x}"
    m, rows = regression_model(), _lines(spark, sf)
    draws = H.sample(m, rows, chains=2, draws=50, warmup=100)
    told = H.sample(m, rows, chains=2, draws=50, warmup=100, what="transitions")
    out = None
    for g in P.export(path, draws, told, rows):
        try:
            one = spark.read.parquet(f"{path}/{g}").agg(F.count("*").alias("rows")).select(F.lit(g).alias("group"), "rows")
        except AnalysisException as e:
            raise RuntimeError(f"group {g} can't be read") from e
        out = one if out is None else out.union(one)
    return out


PRIOR = M.InverseGammaPrior(3.0, 0.5)


def _revenue(spark, sf):
    """The whole series of daily revenue; days without lines have none."""
    return daily_revenue(spark, sf).fillna(0.0, ["y"])


def _path_summary(paths):
    return paths.groupBy("series_id", "step").agg(F.avg("observation").alias("mean"), F.percentile("observation", F.lit(0.025)).alias("lower"), F.percentile("observation", F.lit(0.975)).alias("upper"), F.avg("cumulative").alias("cumulative"))


@query()
def gibbs_local_level(spark, sf):
    return _path_summary(M.forecast_local_level(M.fit(_revenue(spark, sf), M.LocalLevel(PRIOR, PRIOR), chains=2, draws=200, warmup=100), 7))


@query()
def gibbs_trend(spark, sf):
    return _path_summary(M.forecast_trend(M.fit(_revenue(spark, sf), M.LocalLinearTrend(PRIOR, M.InverseGammaPrior(3.0, 0.01), PRIOR), chains=2, draws=100, warmup=50), 7))


@query()
def gibbs_seasonal(spark, sf):
    return _path_summary(M.forecast_seasonal(M.fit(_revenue(spark, sf), M.SeasonalLocalLevel(7, PRIOR, PRIOR, PRIOR), chains=2, draws=100, warmup=50), 7))


def weekly_revenue(spark, sf):
    """(series_id, t, y): revenue of all lines in millions by week from Monday, t in weeks; weeks without lines are null."""
    weeks = table(spark, sf, "lineitem").groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("week")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("y"))
    span = weeks.agg(F.min("week").alias("first"), F.max("week").alias("end")).where("first IS NOT NULL")
    grid = span.select("first", F.explode(F.sequence("first", "end", F.expr("interval 7 days"))).alias("week"))
    return grid.join(weeks, "week", "left").select(F.lit("all").alias("series_id"), F.floor(F.datediff("week", "first") / 7).cast("int").alias("t"), "y")


def yearly_season(series, draws=1000, warmup=500):
    """Four chains of a seasonal level with a period of 52 weeks."""
    return M.fit(series, M.SeasonalLocalLevel(52, PRIOR, PRIOR, PRIOR, initial_level_variance=1e4), chains=4, draws=draws, warmup=warmup)


@query()
def gibbs_yearly_season(spark, sf):
    """The next 26 weeks of all weekly revenue, by the season of the year."""
    return _path_summary(M.forecast_seasonal(yearly_season(weekly_revenue(spark, sf), 100, 50), 26))


@query(f"WITH {O.SERIES} SELECT series_id, 2 AS chains, 4 AS draws, count(*) AS time_count, count(y) AS observed_count, 6::BIGINT AS warmup, 2::BIGINT AS thin, 42::BIGINT AS seed, NULL::BIGINT AS period, NULL::BIGINT AS \"order\", 'gibbs' AS inference_method FROM series GROUP BY ALL")
def series_fit_metadata(spark, sf):
    s = daily_revenue(spark, sf)
    return fits.metadata(M.fit(s, M.LocalLevel(PRIOR, PRIOR), chains=2, draws=4, warmup=6, thin=2), s, warmup=6, thin=2)


@query()
def batch_telemetry(spark, sf):
    """Acceptance and divergences of one regression for each return flag, with its place in the batch."""
    return fits.batch_report(H.sample(regression_model(), _lines(spark, sf), chains=2, draws=100, warmup=100, what="transitions"))


@query()
def gibbs_hierarchy(spark, sf):
    p = programs(spark, sf)
    fitted = M.HierarchicalMean(M.InverseGammaPrior(3, 50), M.InverseGammaPrior(3, 50), M.InverseGammaPrior(3, 500), 150.0, 10000.0).fit(p, chains=2, draws=100, warmup=100)
    return fitted.groupBy("param", "id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


@query()
def hierarchy_forecast_rollup(spark, sf):
    p = programs(spark, sf)
    fitted = M.HierarchicalMean(M.InverseGammaPrior(3, 50), M.InverseGammaPrior(3, 50), M.InverseGammaPrior(3, 500), 150.0, 10000.0).fit(p, chains=2, draws=50, warmup=50)
    rolled = S.rollup_paths(M.forecast_hierarchy(fitted, p, 3))
    return rolled.groupBy("group_id", "step").agg(F.avg("observation").alias("mean"), F.percentile("observation", F.lit(0.9)).alias("q90"))


@query()
def ar_forecast_paths(spark, sf):
    s = daily_revenue(spark, sf).fillna(0.0, ["y"])
    drawn = M.draw_autoregression(W.ar_posterior(s, 3), 3, chains=2, draws=200)
    return _path_summary(M.forecast_autoregression(drawn, W.last_values(s, 3), 7))


@query()
def fixed_effects_panel(spark, sf):
    """Price on one effect for each part size and each line number, from sums alone."""
    rows = table(spark, sf, "lineitem").select(F.lit("all").alias("series_id"), "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    hot = W.one_hot(rows, "l_linenumber", [1, 2, 3, 4, 5, 6, 7])
    xs = [*[f"l_linenumber_{k}" for k in range(1, 8)], "l_quantity"]
    return W.nig_posterior(W.gaussian_sums(hot, xs, "y", ["series_id"]), 8, np.zeros(8), 0.01 * np.eye(8), 2.0, 1.0)


@query("""WITH rows AS (SELECT l_returnflag AS g, l_suppkey AS a, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
 s AS (SELECT g, a, count(*) / 225.0::DOUBLE + 1 / 400.0::DOUBLE AS d, sum(x) / 225.0::DOUBLE AS x, sum(y) / 225.0::DOUBLE AS b FROM rows GROUP BY ALL),
 t AS (SELECT g, sum(x * x) / 225.0::DOUBLE + 1 / 25.0::DOUBLE AS xx, sum(x * y) / 225.0::DOUBLE AS xy FROM rows GROUP BY ALL),
 u AS (SELECT g, sum(x * x / d) AS xx, sum(x * b / d) AS xy FROM s GROUP BY ALL),
 r AS (SELECT t.g, t.xx - u.xx AS p, (t.xy - u.xy) / (t.xx - u.xx) AS slope FROM t JOIN u ON t.g = u.g)
 SELECT g AS l_returnflag, 'l_suppkey' AS term, a::VARCHAR AS level, round((b - x * slope) / d, 6) AS mean, round(sqrt(1 / d + (x / d) * (x / d) / p), 6) AS sd FROM s JOIN r USING (g)
 UNION ALL SELECT g, 'l_quantity', NULL, round(slope, 6), round(sqrt(1 / p), 6) FROM r""")
def supplier_effects(spark, sf):
    """Price on an effect for each supplier and a slope, for each return flag: suppliers are eliminated one by one."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return panel.panel_effects(rows, {"l_suppkey": 20.0}, {"l_quantity": 5.0}, "y", 15.0, by="l_returnflag").select("l_returnflag", "term", "level", r("mean"), r("sd"))


PANEL = {"l_suppkey": 20.0, "week": 10.0, "l_quantity": 50.0, "l_linenumber": 20.0, "l_linestatus": 30.0}, {"trend": 20.0, "x_sin": 20.0, "x_cos": 20.0}


def panel_rows(spark, sf):
    """Lines with their week, quantity as a level, trend and a yearly wave, as one panel."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    angle = 2 * F.pi() * day / 365.25
    return table(spark, sf, "lineitem").select(
        F.lit("all").alias("series_id"), "l_suppkey", F.weekofyear("l_shipdate").alias("week"), F.col("l_quantity").cast("int").alias("l_quantity"), "l_linenumber", "l_linestatus",
        (day / 2600).alias("trend"), F.sin(angle).alias("x_sin"), F.cos(angle).alias("x_cos"), (F.col("l_extendedprice") / 1000).alias("y"),
    )


@query()
def panel_indicators(spark, sf):
    """Effects of every supplier, week, quantity, line number and status, and the slopes: no indicator is a column."""
    return panel.panel_effects(panel_rows(spark, sf), *PANEL, "y", 15.0)


__all__ = ["ORACLES", "QUERIES", "T", "regression_model"]
