"""What a fit tells of itself: getters, metadata, labels, export, and the report of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import InferenceError

#: What the spread of a forecast covers, and what its limits are.
FIXED_PARAMETERS, INTEGRATED, INTERVAL = "conditional_fixed_parameters", "parameter_integrated_posterior_predictive", "pointwise_equal_tailed"
KEYS = ("series_id", "chain", "draw")


def _placed(name: str):
    return lambda x, i: F.struct(F.lit(name).alias("param"), i.cast("int").alias("idx"), x.alias("value"))


def samples(fitted: DataFrame) -> DataFrame:
    """(series_id, chain, draw, param, idx, value) of the draws of a series model: its columns, a standard
    deviation ``*_sd`` beside every ``*_variance``, and one row for each place of an array."""
    parts = []
    for name, kind in fitted.dtypes:
        if name in KEYS:
            continue
        if kind.startswith("array"):
            parts.append(F.transform(F.col(name), _placed(name)))
            continue
        one = {name: F.col(name)} | ({f"{name.removesuffix('_variance')}_sd": F.sqrt(name)} if name.endswith("_variance") else {})
        parts.append(F.array(*[F.struct(F.lit(n).alias("param"), F.lit(None).cast("int").alias("idx"), v.cast("double").alias("value")) for n, v in one.items()]))
    return fitted.select(*KEYS, F.explode(F.concat(*parts)).alias("x")).select(*KEYS, "x.*")


def metadata(fitted: DataFrame, series: DataFrame, warmup: int = 0, thin: int = 1, seed: int = 42, period: int | None = None, order: int | None = None, method: str = "gibbs") -> DataFrame:
    """A row for each series: chains, draws, time_count, observed_count, and what the fit was asked for.

    Values that are null or NaN are times without an observation."""
    seen = F.count(F.when(~F.isnan("y"), F.col("y")))
    times = series.groupBy("series_id").agg(F.count("*").alias("time_count"), seen.alias("observed_count"))
    runs = fitted.groupBy("series_id").agg((F.max("chain") + 1).alias("chains"), (F.max("draw") + 1).alias("draws"))
    given = {"warmup": warmup, "thin": thin, "seed": seed, "period": period, "order": order}
    asked = [F.lit(v).cast("long").alias(k) for k, v in given.items()]
    return runs.join(times, "series_id").select("series_id", "chains", "draws", "time_count", "observed_count", *asked, F.lit(method).alias("inference_method"))


def intervals(paths: DataFrame, value: str = "observation", level: float = 0.95, integrated: bool = True) -> DataFrame:
    """Mean and pointwise limits of forecast paths by series and step, labelled with what they cover."""
    if not 0 < level < 1:
        raise InferenceError("level must lie between 0 and 1")
    ends = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    got = paths.groupBy("series_id", "step").agg(F.avg(value).alias("mean"), ends.alias("ends"))
    labels = (F.lit(INTEGRATED if integrated else FIXED_PARAMETERS).alias("uncertainty_kind"), F.lit(INTERVAL).alias("interval_kind"))
    return got.select("series_id", "step", "mean", F.col("ends")[0].alias("lower"), F.col("ends")[1].alias("upper"), F.lit(float(level)).alias("level"), *labels)


def export_series(path: str, fitted: DataFrame, series: DataFrame) -> list[str]:
    """Write a series fit as Parquet groups under ``path``: posterior (long) and observed_data."""
    groups = {"posterior": samples(fitted), "observed_data": series.select("series_id", "t", "y")}
    for name, df in groups.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(groups)


def batch_report(transitions: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A row for each dataset of a batch: place in the batch, chains, draws, acceptance and divergences.

    ``index`` (dataset_id, dataset_index) gives the places, as the data may; without it datasets are in
    the order of their ids.  ``place_from_end`` is -1 for the last.  Acceptance and divergences are of
    draws after warm-up, the arrays by chain."""
    after = ~F.col("is_warmup")
    rate = F.avg(F.when(after, F.col("accept_prob"))).alias("rate")
    chains = transitions.groupBy("dataset_id", "chain").agg(rate, F.sum((after & F.col("divergent")).cast("long")).alias("wild"), F.sum(after.cast("long")).alias("draws"))
    by_chain = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("chain", c))), lambda x: x[c])  # noqa: E731  few chains
    got = chains.groupBy("dataset_id").agg(
        F.count("*").alias("chains"), F.max("draws").alias("draws"), F.avg("rate").alias("accept_rate"), by_chain("rate").alias("accept_rates"),
        F.sum("wild").alias("divergences"), by_chain("wild").alias("divergences_per_chain"),
    )
    if index is None:
        index = got.select("dataset_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dataset_id")) - 1).alias("dataset_index"))
    else:
        index = index.groupBy("dataset_id").agg(F.min("dataset_index").cast("long").alias("dataset_index"))
    size = index.agg(F.count("*").alias("size"))
    placed = got.join(index, "dataset_id").join(F.broadcast(size))  # one row
    return placed.withColumn("place_from_end", (F.col("dataset_index") - F.col("size")).cast("long")).drop("size")
