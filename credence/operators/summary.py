"""Summaries of draws in long form: ``(..., chain, draw, param, value)``.

Every function groups by ``by`` (``["param"]`` unless told otherwise), so one plan serves any number
of datasets and parameters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import inv_normal_cdf, uniform

BY = ("param",)


def mean_std(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Posterior mean, and standard deviations with divisors n (``std``) and n - 1 (``std_sample``)."""
    return draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.stddev_samp("value").alias("std_sample"), F.count("*").alias("n"))


#: Rows that a cell of a parameter's range holds on average; cells, not parameters, are sorted in one task.
CELL = 2000


def _with(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of ``found``, which has one row for each ``keys``; null keys meet."""
    found = found.withColumnsRenamed({k: f"{k}$" for k in keys})
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[f"{k}$"]) for k in keys])
    return rows.join(found, on).drop(*[f"{k}$" for k in keys])


def _celled(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """``draws`` with the cell of their value, the rows of the group in lower cells (``below``), in all (``n``) and with a value (``seen``).

    Cells cut a group's range evenly, so they rise with values and equal values share one; they follow from
    counts and extremes alone, which don't depend on the order of rows.  A range without a finite width is one cell."""
    span = draws.groupBy(*by).agg(F.min("value").alias("least$"), F.max("value").alias("most$"), F.ceil(F.count("*") / CELL).alias("cells$"))
    share = F.try_divide(F.col("value") - F.col("least$"), F.col("most$") - F.col("least$"))
    cell = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * F.col("cells$")), F.col("cells$") - 1)
    rows = _with(draws, span, by).withColumn("cell", cell).drop("least$", "most$", "cells$")
    every = Window.partitionBy(*by)
    counts = rows.groupBy(*by, "cell").agg(F.count("*").alias("here$"), F.count("value").alias("seen$"))
    counts = counts.select(*by, "cell", (F.sum("here$").over(every.orderBy("cell")) - F.col("here$")).alias("below"), F.sum("here$").over(every).alias("n"), F.sum("seen$").over(every).alias("seen"))
    return _with(rows, counts, [*by, "cell"])


def _placed(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """``draws`` with their place from 0 in the order of values (``place``) and their group's number of rows (``n``)."""
    order = Window.partitionBy(*by, "cell").orderBy("value")
    return _celled(draws, by).withColumn("place", F.col("below") + F.row_number().over(order) - 1).drop("cell", "below")


def quantiles(draws: DataFrame, probs: Sequence[float], by: Sequence[str] = BY) -> DataFrame:
    """Linearly interpolated quantiles, one column ``q_<prob>`` each; null values are left out."""
    at = {p: F.lit(float(p)) * (F.col("seen") - 1) for p in probs}
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    # null values come first; of a group without others, one stays
    near = _placed(draws, by).withColumn("place", F.col("place") - (F.col("n") - F.col("seen"))).where(F.col("place").isin(*ends))
    out = []
    for p, x in at.items():
        low, high = (F.max(F.when(F.col("place") == f(x), F.col("value"))) for f in (F.floor, F.ceil))
        share = F.max(x - F.floor(x))
        out.append(F.when(low == high, low).otherwise((1 - share) * low + share * high).alias(f"q_{p:g}".replace(".", "_")))
    return near.groupBy(*by).agg(*out)


def truncating_quantile(draws: DataFrame, p: float, by: Sequence[str] = BY) -> DataFrame:
    """The order statistic ``floor(p (n - 1))``, without interpolation."""
    return _placed(draws, by).where(F.col("place") == F.floor(F.lit(p) * (F.col("n") - 1))).select(*by, F.col("value").alias("quantile"))


def interval(draws: DataFrame, level: float = 0.95, by: Sequence[str] = BY) -> DataFrame:
    """Equal-tailed interval."""
    tail = (1 - level) / 2
    return quantiles(draws, (tail, 1 - tail), by).toDF(*by, "lower", "upper")


def hdi(draws: DataFrame, prob: float = 0.94, by: Sequence[str] = BY, gap: str = "ceil") -> DataFrame:
    """Shortest interval that holds ``ceil(prob n)`` draws; with ``gap="floor"``, the variant that
    spans ``floor(prob n)`` steps.  The lowest of equally short ones."""
    ranked = _placed(draws, by).withColumn("i", F.col("place") + 1)
    steps = F.least(F.greatest(F.ceil(F.lit(prob) * F.col("n")), F.lit(1)), F.col("n")) - 1 if gap == "ceil" else F.floor(F.lit(prob) * F.col("n"))
    ranked = ranked.withColumn("steps", steps.cast("long")).select(*by, "i", "value", "steps")
    ends = ranked.select(*by, (F.col("i") - F.col("steps")).alias("i"), F.col("value").alias("upper"))
    spans = ranked.join(ends, [*by, "i"]).withColumn("width", F.col("upper") - F.col("value"))
    best = F.min_by(F.struct(F.col("value").alias("lower"), "upper"), F.struct("width", "i"))
    return spans.groupBy(*by).agg(best.alias("b")).select(*by, "b.lower", "b.upper")


def split_chains(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """First and last ``floor(n / 2)`` draws of each chain as chains of their own (``half``), with
    draws counted from 0 (``t``) and their number (``n``)."""
    chain = Window.partitionBy(*by, "chain")
    numbered = draws.withColumn("place", F.row_number().over(chain.orderBy("draw")) - 1).withColumn("len", F.count("*").over(chain))
    numbered = numbered.withColumn("n", F.floor(F.col("len") / 2)).where((F.col("place") < F.col("n")) | (F.col("place") >= F.col("len") - F.col("n")))
    late = F.col("place") >= F.col("len") - F.col("n")
    return numbered.select(*by, (F.col("chain") * 2 + late.cast("int")).alias("half"), (F.col("place") - F.when(late, F.col("len") - F.col("n")).otherwise(0)).alias("t"), "n", "value")


def rank_normalised(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Values replaced by normal scores of their ranks, ties averaged: Φ⁻¹((r - 3/8) / (N + 1/4))."""
    cell = Window.partitionBy(*by, "cell")
    rank = F.col("below") + F.rank().over(cell.orderBy("value"))
    ties = F.count("*").over(cell.orderBy("value").rangeBetween(Window.currentRow, Window.currentRow))
    score = inv_normal_cdf((rank + (ties - 1) / 2 - 0.375) / (F.col("n") + 0.25))
    names = draws.columns
    return _celled(draws.withColumnsRenamed({"n": "n$"}), by).withColumn("value", score).drop("cell", "below", "n", "seen").withColumnsRenamed({"n$": "n"}).select(*names)


def _r_hat(split: DataFrame, by: Sequence[str]) -> DataFrame:
    chains = split.groupBy(*by, "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("k"))
    got = chains.groupBy(*by).agg(F.avg("v").alias("w"), (F.first("k") * F.var_samp("m")).alias("b"), F.first("k").alias("n"))
    total = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b") / F.col("n")
    value = F.when((F.col("w") < 1e-30) & (F.col("b") < 1e-30), F.lit(float("nan"))).when(F.col("w") < 1e-30, F.lit(float("inf"))).otherwise(F.sqrt(total / F.col("w")))
    return got.select(*by, value.alias("r_hat"))


def split_r_hat(draws: DataFrame, by: Sequence[str] = BY, parts: bool = False) -> DataFrame:
    """The larger of the rank-normalised and the folded split R-hat; with ``parts``, both too."""
    split = split_chains(draws, by).drop("n")
    middle = quantiles(split, (0.5,), by)
    folded = _with(split, middle, by).withColumn("value", F.abs(F.col("value") - F.col("q_0_5"))).drop("q_0_5")
    one = _r_hat(rank_normalised(split, by), by).withColumnRenamed("r_hat", "r_hat_rank")
    two = _r_hat(rank_normalised(folded, by), by).withColumnRenamed("r_hat", "r_hat_folded")
    both = one.join(two, list(by)).withColumn("r_hat", F.greatest("r_hat_rank", "r_hat_folded"))
    return both if parts else both.select(*by, "r_hat")


def _autocovariance(pdf: pd.DataFrame) -> np.ndarray:
    x = pdf.sort_values("t")["value"].to_numpy()
    x = x - x.mean()
    size = 1 << int(2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, size)
    return np.fft.irfft(f * f.conj(), size)[: len(x)] / len(x)


def ess(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Effective sample size of the values as they are: split chains, V-hat-plus, Geyer's initial
    monotone sequence.

    One split chain is one group; its autocovariances come from a Fourier transform and leave it added up
    by pairs of lags (0 alone has the correlation 1); all else is aggregates over pairs, and a window over
    those of a sequence that haven't ended it."""
    split = split_chains(draws, by)
    chains = split.groupBy(*by, "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("k"))
    stats = chains.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b_n"), F.first("k").alias("n"), F.count("*").alias("m"))
    stats = stats.withColumn("var_plus", (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b_n"))

    kinds = {f.name: f.dataType.simpleString() for f in split.schema}
    keys = ", ".join(f"{b} {kinds[b]}" for b in by)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _autocovariance(pdf[["t", "value"]])
        got[:1] = 0
        got = got[: len(got) // 2 * 2].reshape(-1, 2).sum(1)
        return pd.DataFrame({b: [pdf[b].iloc[0]] * len(got) for b in by} | {"pair": np.arange(len(got)), "gamma": got})

    gammas = split.drop("n").groupBy(*by, "half").applyInPandas(pairs, f"{keys}, pair long, gamma double")
    tasks = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mean_gamma = gammas.repartition(tasks, *by, "pair").groupBy(*by, "pair").agg(F.avg("gamma").alias("gamma")).join(stats, list(by))
    lags = F.when(F.col("pair") == 0, F.lit(1)).otherwise(F.lit(2))
    kept = mean_gamma.select(*by, "pair", (2 - F.try_divide(lags * F.col("w") - F.col("gamma"), F.col("var_plus"))).alias("p"))
    bad = F.col("p").isNull() | (F.col("p") < 0) | F.isnan("p") | (F.abs("p") == float("inf"))
    end = kept.where(bad).groupBy(*by).agg(F.min("pair").alias("end"))
    so_far = Window.partitionBy(*by).orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.join(end, list(by), "left").where(F.col("end").isNull() | (F.col("pair") < F.col("end"))).withColumn("low", F.min("p").over(so_far))
    sums = kept.groupBy(*by).agg(F.sum("low").alias("s"))
    total = F.col("m") * F.col("n")
    tau = F.greatest(-1 + 2 * F.coalesce(F.col("s"), F.lit(0.0)), 1 / F.log10(total.cast("double")))
    value = F.when((F.col("w") < 1e-30) | (F.col("n") < 3) | (F.col("m") < 2), F.lit(float("nan"))).otherwise(total / tau)
    return stats.join(sums, list(by), "left").select(*by, value.alias("ess"))


def ess_bulk(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """ESS of the rank-normalised draws (ranks are taken before chains are split)."""
    return ess(rank_normalised(draws, by), by).withColumnRenamed("ess", "ess_bulk")


def ess_tail(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The smaller ESS of the indicators of the lower and the upper 5 %."""
    rows = _with(draws, quantiles(draws, (0.05, 0.95), by), by)
    low, high = (rows.withColumn("value", x.cast("double")).drop("q_0_05", "q_0_95") for x in (F.col("value") <= F.col("q_0_05"), F.col("value") >= F.col("q_0_95")))
    both = ess(low, by).join(ess(high, by).withColumnRenamed("ess", "high"), list(by))
    return both.select(*by, F.least("ess", "high").alias("ess_tail"))


def mcse(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Monte Carlo standard error of the mean: sample deviation over the root of the plain ESS."""
    spread = draws.groupBy(*by).agg(F.stddev_samp("value").alias("s"))
    return spread.join(ess(draws, by), list(by)).select(*by, (F.col("s") / F.sqrt("ess")).alias("mcse_mean"))


def diagnostics(draws: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """mean, std (n - 1), 94 % HDI, bulk and tail ESS, R-hat and MCSE, with what they warn of."""
    by = list(by)
    out = draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = out.join(hdi(draws, 0.94, by).withColumnsRenamed({"lower": "hdi_3", "upper": "hdi_97"}), by)
    out = out.join(ess_bulk(draws, by), by).join(ess_tail(draws, by), by).join(split_r_hat(draws, by), by).join(mcse(draws, by), by)
    warn = F.filter(F.array(F.when(F.col("r_hat") > 1.01, F.lit("r_hat")), F.when(F.least("ess_bulk", "ess_tail") < 400, F.lit("ess"))), lambda x: x.isNotNull())
    return out.withColumn("warnings", F.concat_ws(",", warn))


def transition_report(transitions: DataFrame, by: Sequence[str] = ("chain",)) -> DataFrame:
    """Sampler telemetry: acceptance and divergences after warm-up; energy, step size and leapfrog steps over all."""
    after = ~F.col("is_warmup")
    return transitions.groupBy(*by).agg(
        F.count("*").alias("transitions"), F.sum(F.col("is_warmup").cast("long")).alias("warmup_transitions"), F.sum(after.cast("long")).alias("draw_transitions"),
        F.sum((after & F.col("divergent")).cast("long")).alias("divergences"), F.sum((after & F.col("accepted")).cast("long")).alias("accepted"),
        F.coalesce(F.avg(F.when(after, F.col("accept_prob"))), F.lit(0.0)).alias("mean_accept_prob"), F.avg("energy_error").alias("mean_energy_error"),
        F.max(F.abs("energy_error")).alias("max_abs_energy_error"), F.avg("step_size").alias("mean_step_size"), F.max("tree_depth").alias("max_tree_depth"), F.sum("num_leapfrog_steps").alias("leapfrog_steps"),
    )


def thinned(draws: DataFrame, warmup: int, thin: int) -> DataFrame:
    """Draws that stay of iterations counted from 0 in ``iter``."""
    return draws.where((F.col("iter") >= warmup) & ((F.col("iter") + 1 - warmup) % thin == 0))


def rollup_paths(paths: DataFrame, group: str = "group_id", value: str = "observation") -> DataFrame:
    """Sums over programs within (chain, draw, step): for each group, and in total (null group)."""
    groups = paths.groupBy("chain", "draw", "step", group).agg(F.sum(value).alias(value))
    return groups.rollup("chain", "draw", "step", group).agg(F.sum(value).alias(value), F.grouping_id().alias("level")).where("level <= 1").drop("level")


def draw_subsample(draws: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` (chain, draw) pairs without replacement, by md5 of seed and pair, in order; all where there are fewer."""
    pairs = draws.select("chain", "draw").distinct()
    return pairs.orderBy(uniform(seed, "chain", "draw"), "chain", "draw").limit(n).orderBy("chain", "draw")


def format_table(diagnosed: DataFrame, digits: int = 3, divergences: int = 0) -> str:
    """A text table of :func:`diagnostics` (or of any small summary), with a line for each warning and for divergences."""
    rows = diagnosed.orderBy(*diagnosed.columns[:1]).toPandas()
    text = rows.round(digits).to_string(index=False)
    if "warnings" in rows:
        said = {"r_hat": "R-hat is above 1.01", "ess": "the effective sample size is below 400"}
        for _, r in rows.iterrows():
            text += "".join(f"\nWarning: {r.iloc[0]}: {said[w]}" for w in r["warnings"].split(",") if w)
    if divergences:
        text += f"\nWarning: {divergences} transitions diverged after warm-up"
    return text
