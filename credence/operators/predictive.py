"""Prior and posterior predictive draws, pointwise log-likelihood, and export of a fit as tables."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import bernoulli, exponential, normal, sigmoid, split_mix
from ..plans.model import InferenceError, Model
from .summary import draw_subsample


def wide(draws: DataFrame, model: Model) -> DataFrame:
    """(dataset_id, chain, draw, one column for each parameter; an array for a vector), by one aggregate."""
    aggs = []
    for p in model.priors:
        if p.size is None:
            aggs.append(F.max(F.when(F.col("param") == p.name, F.col("value"))).alias(p.name))
        else:
            mine = F.collect_list(F.when(F.col("param").startswith(f"{p.name}["), F.struct("idx", "value")))
            aggs.append(F.transform(F.array_sort(mine), lambda x: x["value"]).alias(p.name))
    return draws.groupBy("dataset_id", "chain", "draw").agg(*aggs)


def _over_rows(draws: DataFrame, bound: DataFrame, model: Model) -> DataFrame:
    params = wide(draws, model)
    renamed = params.select("dataset_id", "chain", "draw", *[F.col(p.name).alias(f"param${p.name}") for p in model.priors])
    return bound.join(renamed, "dataset_id")


def _params(model: Model) -> dict:
    return {p.name: F.col(f"param${p.name}") for p in model.priors}


def pointwise_log_likelihood(draws: DataFrame, bound: DataFrame, model: Model) -> DataFrame:
    """(dataset_id, likelihood, chain, draw, row_idx, value); ``bound`` has row_idx beside the needed columns."""
    rows = _over_rows(draws, bound, model)
    one = [F.struct(F.lit(x.name).alias("likelihood"), model.log_likelihood(x, _params(model)).alias("value")) for x in model.likelihoods]
    return rows.select("dataset_id", "chain", "draw", "row_idx", F.explode(F.array(*one)).alias("x")).select("dataset_id", "x.likelihood", "chain", "draw", "row_idx", "x.value")


def _count(kind: str, mu: float, scale: float, rng: np.random.Generator) -> float:
    if kind == "poisson":
        return float(rng.poisson(min(mu, 1e15)))
    return float(rng.poisson(min(rng.gamma(scale, mu / scale), 1e15)))  # gamma mixture of Poissons


def simulate(rows: DataFrame, model: Model, seed: int, sample: str) -> DataFrame:
    """A draw of every likelihood for each row; the random key of a value is its (dataset, sample, row).

    Counts need a generator each; all else is Columns."""
    out = None
    for x in model.likelihoods:
        scale = x.scale
        sc = F.lit(1.0) if scale is None else F.col(f"param${scale}") if isinstance(scale, str) else F.lit(float(scale))
        have = rows.select("dataset_id", F.lit(x.name).alias("likelihood"), F.col(sample).cast("long").alias("sample"), "row_idx", model.predictor(x, _params(model)).alias("eta"), sc.alias("scale"))
        key = (F.lit(x.name), "dataset_id", "sample", "row_idx")
        if x.kind in ("poisson", "negative_binomial"):
            got = have.repartition("row_idx").mapInPandas(_counts(x.kind, seed), "dataset_id string, likelihood string, sample long, row_idx long, value double")
        else:
            eta = F.col("eta")
            value = {
                "normal": lambda: eta + F.col("scale") * normal(seed, *key), "log_normal": lambda: F.exp(eta + F.col("scale") * normal(seed, *key)),  # noqa: B023
                "bernoulli": lambda: bernoulli(seed, sigmoid(eta), *key), "exponential": lambda: exponential(seed, F.exp(eta), *key),  # noqa: B023
            }[x.kind]()
            got = have.select("dataset_id", "likelihood", "sample", "row_idx", value.alias("value"))
        out = got if out is None else out.union(got)
    return out


def _counts(kind: str, seed: int):
    def run(batches):
        bits = np.random.Philox(key=[0, 0])
        rng, fresh = np.random.Generator(bits), bits.state
        for pdf in batches:
            own = {d: zlib.crc32(str(d).encode()) for d in pdf["dataset_id"].unique()}
            mus, values = np.exp(np.minimum(pdf["eta"].to_numpy(float), 700)).tolist(), []
            for d, name, s, i, mu, c in zip(pdf["dataset_id"], pdf["likelihood"], pdf["sample"].tolist(), pdf["row_idx"].tolist(), mus, pdf["scale"].tolist()):
                stream = split_mix(split_mix(seed, s, own[d]), i, zlib.crc32(name.encode()))
                fresh["state"]["key"][:] = stream, split_mix(stream, i, s & (1 << 64) - 1)
                bits.state = fresh
                values.append(_count(kind, mu, c, rng))
            yield pdf[["dataset_id", "likelihood", "sample", "row_idx"]].assign(value=values)

    return run


def posterior_predictive(draws: DataFrame, bound: DataFrame, model: Model, n_samples: int | None = None, seed: int = 42) -> DataFrame:
    """Simulated responses for ``n_samples`` draws (all without it), taken without replacement and in order.

    ``sample`` is the chain times 2^32 plus the draw."""
    if n_samples is not None:
        kept = draw_subsample(draws, n_samples, seed)
        draws = draws.join(F.broadcast(kept), ["chain", "draw"])  # n_samples rows
    params = _over_rows(draws, bound, model).withColumn("sample", F.shiftleft(F.col("chain").cast("long"), 32) + F.col("draw"))
    return simulate(params, model, seed, "sample")


def prior_draws(spark: SparkSession, model: Model, n_samples: int = 500, seed: int = 42) -> DataFrame:
    """(sample, one column for each parameter) from the priors, discrete ones too."""
    if n_samples < 1:
        raise InferenceError("n_samples must be 1 or more")
    kind = ", ".join(f"`{p.name}` {'array<double>' if p.size else 'double'}" for p in model.priors)

    def run(batches):
        for pdf in batches:
            rows = []
            for s in pdf["id"]:
                rng, x = np.random.Generator(np.random.Philox(key=[seed, int(s)])), {}
                for p in model.priors:
                    a = [x[v] if isinstance(v, str) else v for v in p.args]
                    n = p.size or 1
                    v = {
                        "normal": lambda: rng.normal(a[0], a[1], n), "half_normal": lambda: np.abs(rng.normal(0, a[0], n)), "exponential": lambda: rng.exponential(1 / a[0], n), "log_normal": lambda: rng.lognormal(a[0], a[1], n),
                        "student_t": lambda: a[1] + a[2] * rng.standard_t(a[0], n), "uniform": lambda: rng.uniform(a[0], a[1], n), "gamma": lambda: rng.gamma(a[0], 1 / a[1], n), "beta": lambda: rng.beta(a[0], a[1], n),
                        "bernoulli": lambda: (rng.random(n) < a[0]).astype(float), "poisson": lambda: rng.poisson(a[0], n).astype(float),
                    }[p.kind]()  # noqa: B023
                    x[p.name] = v if p.size else float(v[0])
                rows.append((int(s), *x.values()))
            yield pd.DataFrame(rows, columns=["sample", *[p.name for p in model.priors]])

    return spark.range(n_samples).mapInPandas(run, f"sample long, {kind}")


def prior_predictive(bound: DataFrame, model: Model, n_samples: int = 500, seed: int = 42) -> DataFrame:
    """Simulated responses under the prior, for every row of ``bound``; parameters are a small table."""
    params = prior_draws(bound.sparkSession, model, n_samples, seed)
    params = params.select("sample", *[F.col(p.name).alias(f"param${p.name}") for p in model.priors])
    rows = bound.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1)))).join(params, F.col("k") == F.col("sample"))
    return simulate(rows, model, seed, "sample")


def export(path: str, draws: DataFrame, transitions: DataFrame | None = None, observed: DataFrame | None = None, log_likelihood: DataFrame | None = None, predictive: DataFrame | None = None) -> list[str]:
    """Write a fit as Parquet groups under ``path``: posterior, sample_stats (after warm-up),
    observed_data, log_likelihood, posterior_predictive.  Returns the groups written."""
    stats = None if transitions is None else transitions.where("not is_warmup").select("dataset_id", "chain", "iter", "step_size", F.col("divergent").alias("diverging"))
    groups = {"posterior": draws, "sample_stats": stats, "observed_data": observed, "log_likelihood": log_likelihood, "posterior_predictive": predictive}
    for name, df in groups.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    return [k for k, v in groups.items() if v is not None]
