"""Sources: tables, series built from them, CSV series, and synthetic generators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import normal, uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_csv(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A study series: date, value, latent_mean, split; only the rows of ``split`` if given."""
    df = spark.read.csv(path, header=True, schema="date date, value double, latent_mean double, split string")
    df = df.where(F.col("split") == split) if split else df
    return df.withColumn("t", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, y): revenue in units of 100,000 by day for each return flag, t in days; days without lines are null."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    days = lines.groupBy(F.col("l_returnflag").alias("series_id"), "day").agg((F.sum("r") / 100000.0).alias("y"))
    spans = days.groupBy("series_id").agg(F.min("day").alias("first"), F.max("day").alias("end"))
    grid = spans.select("series_id", "first", F.explode(F.sequence("first", "end")).alias("day"))
    return grid.join(days, ["series_id", "day"], "left").select("series_id", F.datediff("day", "first").alias("t"), "y")


def event_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws in long form from the events: param is the event type, four chains by id, cut to equal lengths."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("param"), (F.col("event_id") % 4).cast("int").alias("chain"), "event_id", "value")
    draws = events.withColumn("draw", F.row_number().over(Window.partitionBy("param", "chain").orderBy("event_id")) - 1)
    size = draws.groupBy("param", "chain").agg(F.count("*").alias("n")).groupBy("param").agg(F.min("n").alias("n"))
    return draws.join(size, "param").where("draw < n").select("param", "chain", "draw", "value")


def study_series(spark: SparkSession, seed: int = 20260802) -> DataFrame:
    """Six synthetic series (monthly and weekly; easy, medium, hard): level, trend, one yearly cycle and noise.

    t counts from 0; the last 6 months or 26 weeks have split 'test'."""
    specs = [
        ("monthly_easy", 24, 6, 12, 100.0, 0.60, 12.0, 1.5), ("monthly_medium", 24, 6, 12, 120.0, 0.80, 10.0, 5.0), ("monthly_hard", 24, 6, 12, 90.0, -0.30, 6.0, 9.0),
        ("weekly_easy", 104, 26, 52, 200.0, 0.15, 20.0, 4.0), ("weekly_medium", 104, 26, 52, 180.0, 0.10, 16.0, 9.0), ("weekly_hard", 104, 26, 52, 150.0, -0.05, 12.0, 16.0),
    ]
    spec = spark.createDataFrame(specs, "series_id string, train int, test int, period int, level double, trend double, amplitude double, noise double")
    rows = spec.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("train") + F.col("test") - 1)))
    mean = F.col("level") + F.col("trend") * F.col("t") + F.col("amplitude") * F.sin(F.lit(2.0) * F.pi() * F.col("t") / F.col("period"))
    rows = rows.withColumn("latent_mean", mean).withColumn("value", mean + F.col("noise") * normal(seed, "series_id", "t"))
    return rows.select("series_id", "t", "period", "value", "latent_mean", F.when(F.col("t") < F.col("train"), "train").otherwise("test").alias("split"))


def regression_problem(spark: SparkSession, n: int, p: int, seed: int = 20260802, sigma: float = 1.0) -> DataFrame:
    """(row_idx, x array, y): standard normal predictors, coefficients alternating in sign and falling in size."""
    rows = spark.range(n).withColumnRenamed("id", "row_idx")
    x = F.array(*[normal(seed, F.lit(f"x{j}"), "row_idx") for j in range(p)])
    beta = F.array(*[F.lit((-1.0) ** j / (1 + j / 4)) for j in range(p)])
    mean = F.aggregate(F.zip_with("x", beta, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("x", x).withColumn("y", mean + F.lit(sigma) * normal(seed, F.lit("noise"), "row_idx"))


__all__ = ["daily_revenue", "event_draws", "regression_problem", "series_csv", "study_series", "table", "uniform"]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="credence-")
