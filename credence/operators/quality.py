"""What draws of a regression are worth: errors against the exact posterior, and a gate before times are compared.

With known noise and independent normal priors the posterior of the coefficients is normal in closed form,
from the sums of one aggregate.  Its marginals are joined with the draws' summaries by dataset and parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import gaussian_sums, nig_posterior


@dataclass(frozen=True)
class Thresholds:
    """Bounds that a fit has to keep; fixed values of the gate, any of which may be given anew."""

    rhat_rank_max: float = 1.01
    divergences: int = 0
    ess_bulk_min: float = 400.0
    mean_rmse_exact_posterior_sd_units: float = 0.2
    sd_relative_rmse_vs_exact_posterior: float = 0.15


def exact_marginals(rows: DataFrame, xs: list[Column | str], y: Column | str, params: list[str], noise: float = 1.0, prior: float = 1.0, by: str = "dataset_id") -> DataFrame:
    """(by, param, exact_mean, exact_sd) of each coefficient of each dataset, for noise of this deviation and N(0, prior²)."""
    k, names, ratio = len(xs), list(params), (noise / prior) ** 2
    if len(names) != k:
        raise ValueError("a parameter for each predictor is needed")
    solved = nig_posterior(gaussian_sums(rows, xs, y, [by]), k, np.zeros(k), ratio * np.eye(k), 1.0, 1.0, by)

    def marginals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sds = [noise * np.sqrt(np.diag(np.linalg.inv(np.asarray(p).reshape(k, k)))) for p in pdf["prec"]]
            yield pd.DataFrame({by: np.repeat(pdf[by].to_numpy(), k), "param": names * len(pdf), "exact_mean": np.concatenate(pdf["coef"].tolist()), "exact_sd": np.concatenate(sds)})

    return solved.mapInPandas(marginals, f"{by} string, param string, exact_mean double, exact_sd double")


def posterior_errors(summary: DataFrame, exact: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Root mean squares over a dataset's parameters, from their ``mean`` and ``std`` (divisor n - 1).

    Parameters without an exact marginal play no part."""
    e = F.col("mean") - F.col("exact_mean")
    rms = lambda c: F.sqrt(F.avg(c * c))
    return summary.join(exact, [by, "param"]).groupBy(by).agg(
        F.count("*").alias("params"), rms(e).alias("mean_rmse_vs_exact_posterior"), rms(e / F.col("exact_sd")).alias("mean_rmse_exact_posterior_sd_units"),
        rms(F.col("std") / F.col("exact_sd") - 1).alias("sd_relative_rmse_vs_exact_posterior"),
    )


def posterior_quality(diagnosed: DataFrame, exact: DataFrame, divergences: DataFrame, by: str = "dataset_id") -> DataFrame:
    """:func:`posterior_errors` with the diagnostics' extremes and each dataset's number of divergences (0 where it has none)."""
    worst = diagnosed.groupBy(by).agg(F.avg("ess_bulk").alias("ess_bulk_mean"), F.min("ess_bulk").alias("ess_bulk_min"), F.max("r_hat").alias("rhat_rank_max"))
    out = worst.join(posterior_errors(diagnosed, exact, by), by).join(divergences.select(by, "divergences"), by, "left")
    return out.withColumn("divergences", F.coalesce("divergences", F.lit(0)).cast("long"))


def quality_gate(quality: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``quality`` with ``failures`` (names of the bounds that are broken, in the order of the bounds) and ``passed``.

    A measure that is null or not a number breaks its bound.  Passing is needed before times are compared,
    and doesn't suffice."""
    t = thresholds
    bad = {name: ~F.coalesce((F.col(name) <= F.lit(getattr(t, name))) & ~F.isnan(F.col(name).cast("double")), F.lit(False)) for name in ("rhat_rank_max", "divergences")}
    bad["ess_bulk_min"] = ~F.coalesce((F.col("ess_bulk_min") >= F.lit(t.ess_bulk_min)) & ~F.isnan("ess_bulk_min"), F.lit(False))
    for name in ("mean_rmse_exact_posterior_sd_units", "sd_relative_rmse_vs_exact_posterior"):
        bad[name] = ~F.coalesce((F.col(name) <= F.lit(getattr(t, name))) & ~F.isnan(name), F.lit(False))
    failures = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in bad.items()]))
    return quality.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
