"""Panels with fixed effects: a Gaussian regression on many indicators and a few slopes, from sums alone.

An indicator's column is never made.  What the normal equations need of indicators are counts of levels, of
pairs of levels, and sums of slopes and response by level: grouping sets of one aggregate, but for the largest
factor, whose rows are dealt out by level and summed there.  That factor's levels are coupled with others but not
among themselves, so they are eliminated first, each on its own row, and found again from the solution of the
rest; only the rest's matrix is dense.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import InferenceError

RESPONSE = "y"

#: Parameters besides the eliminated factor's that one dense matrix may have.
MOST_DENSE = 4000


def _key(term: int, level=None):
    """A parameter's name: its term's number, and for an indicator its level; a null level is a level."""
    return F.lit(f"{term}:") if level is None else F.concat(F.lit(f"{term}:"), level)


def _spelled(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _finite(column: str):
    value = F.col(column).cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"a panel needs finite values: {column}"))).otherwise(value).cast("double")


def _eliminated(weight: float, kinds: str, by: str):
    """Sums of products that the eliminated levels leave in the rest's equations, added up in each task."""

    def flush(held):
        for key, (index, total) in held.items():
            names = np.array(list(index), object)
            i, j = np.nonzero(total)
            yield pd.DataFrame({by: [key] * len(i), "i": names[i], "j": names[j], "v": -total[i, j]})

    def run(frames):
        held: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                key = None if pd.isna(key) else key
                index, total = held.get(key, ({}, np.zeros((0, 0))))
                at = [np.array([index.setdefault(n, len(index)) for n in names]) for names in part["names"]]
                rows = np.zeros((len(part), len(index)))
                for r, columns, values in zip(rows, at, part["sums"]):
                    r[columns] = values
                rows *= weight
                grown = (rows / part["d"].to_numpy()[:, None]).T @ rows
                grown[: len(total), : len(total)] += total
                held[key] = (index, grown)
            if sum(t.size for _, t in held.values()) > MOST_DENSE**2:
                yield from flush(held)
                held = {}
        yield from flush(held)

    return run, f"{by} {kinds}, i string, j string, v double"


def panel_effects(rows: DataFrame, factors: Mapping[str, float], slopes: Mapping[str, float], y: str, sigma: float, by: str = "series_id", eliminate: str | None = None, buckets: int = 64) -> DataFrame:
    """Exact posterior (by, term, level, mean, sd) of ``y ~ N(sum of effects + slopes, sigma)`` for each ``by``.

    ``factors`` and ``slopes`` give each term the deviation of its N(0, .) prior.  Every level that occurs has an
    effect; ``eliminate`` (by default the first factor) may have any number of levels, all others together with
    the slopes at most ``MOST_DENSE``.  A null level is a level, a null ``by`` a group; a null or infinite
    slope or response is an error; repeated rows count each; an empty table has no effects."""
    if not factors or not sigma > 0 or min([*factors.values(), *slopes.values()]) <= 0:
        raise InferenceError("a panel needs a factor and positive deviations")
    first = eliminate or next(iter(factors))
    others = [f for f in factors if f != first]
    terms = [*others, *slopes]
    spreads, weight = [*(factors[f] for f in others), *slopes.values()], 1 / sigma**2
    kind = rows.schema[by].dataType.simpleString()
    levels, sums = {f: f"level_{i}" for i, f in enumerate([first, *others])}, {x: f"sum_{i}" for i, x in enumerate([*slopes, RESPONSE])}
    wide = rows.select(F.col(by).alias("g"), *[_spelled(f).alias(c) for f, c in levels.items()], *[_finite(y if x is RESPONSE else x).alias(c) for x, c in sums.items()])

    names = list(levels.values())[1:]
    sets = [["g", a] for a in names] + [["g", a, b] for k, a in enumerate(names) for b in names[k + 1 :]]
    counted = wide.groupingSets([[F.col(c) for c in s] for s in sets], "g", *names).agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in sums.values()]) if names else None
    # levels of a factor that a set leaves out are null; a null level itself is spelled
    entry = lambda i, j, v: F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    at = {f: _key(k, F.col(levels[f])) for k, f in enumerate(others)}
    slope = {x: _key(len(others) + k) if x is not RESPONSE else F.lit(RESPONSE) for k, x in enumerate(sums)}
    of_level = lambda i: [entry(i, slope[x], F.col(c)) for x, c in sums.items()]
    n, here = F.col("n"), {f: F.col(c).isNotNull() for f, c in levels.items()}
    alone = lambda f: reduce(lambda a, b: a & b, [~here[o] for o in others if o != f], here[f])
    nothing = F.array().cast("array<struct<i:string,j:string,v:double>>")

    # the eliminated factor: a row for each level, with its sums by parameter of the rest; its rows are dealt out by
    # level once, as they hardly meet before, and all sums are made there
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = wide.repartition(tasks, "g", levels[first])
    each = F.array(*[entry(F.lit(""), slope[x], F.col(c)) for x, c in sums.items()], entry(F.lit(""), F.lit("n"), F.lit(1.0)), *[entry(F.lit(""), at[f], F.lit(1.0)) for f in others])
    own = parted.select("g", F.col(levels[first]).alias("level"), F.explode(each).alias("e"))
    own = own.groupBy("g", "level", "e.j").agg(F.sum("e.v").alias("v"))
    own = own.groupBy("g", "level").agg(F.max(F.when(F.col("j") == "n", F.col("v"))).alias("n"), F.collect_list(F.when(F.col("j") != "n", F.struct("j", "v"))).alias("e"))
    own = own.select("g", "level", (n * weight + 1 / factors[first] ** 2).alias("d"), F.col("e.j").alias("names"), F.col("e.v").alias("sums"))

    # the rest: counts and sums of its levels, products of slopes and response
    told = F.when(F.lit(False), nothing)
    for k, f in enumerate(others):
        told = told.when(alone(f), F.array(entry(at[f], at[f], n), *of_level(at[f]), *[entry(slope[x], at[f], F.col(c)) for x, c in sums.items() if x is not RESPONSE]))
        for o in others[k + 1 :]:
            told = told.when(here[f] & here[o], F.array(entry(at[f], at[o], n), entry(at[o], at[f], n)))
    rest = counted.select("g", F.explode(told).alias("e")).select("g", "e.*") if names else None
    pairs = [(a, b) for a in sums for b in sums]
    dense = wide.groupBy("g").agg(*[F.sum(F.col(sums[a]) * F.col(sums[b])).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    dense = dense.select("g", F.explode(F.array(*[entry(slope[a], slope[b], F.col(f"p{k}")) for k, (a, b) in enumerate(pairs)])).alias("e")).select("g", "e.*")
    run, shape = _eliminated(weight, kind, "g")
    equations = (dense if rest is None else rest.unionByName(dense)).withColumn("v", F.col("v") * weight).unionByName(own.select("g", "d", "names", "sums").mapInPandas(run, shape))
    equations = equations.where(F.col("i") != RESPONSE).groupBy("g", "i", "j").agg(F.sum("v").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(pdf["i"].to_numpy(str))
        if len(found) > MOST_DENSE:
            raise InferenceError(f"{len(found)} parameters besides those of {first}; the limit is {MOST_DENSE}")
        index = {p: k for k, p in enumerate(found)}
        a = np.diag([spreads[int(p.split(":", 1)[0])] ** -2.0 for p in found])
        b = np.zeros(len(found))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
            if j == RESPONSE:
                b[index[i]] += v
            else:
                a[index[i], index[j]] += v
        covariance = np.linalg.inv((a + a.T) / 2)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "names": [found.tolist()], "mean": [covariance @ b], "covariance": [covariance.ravel()]})

    solved = equations.groupBy("g").applyInPandas(solve, f"g {kind}, names array<string>, mean array<double>, covariance array<double>")

    def back(own: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
        if own.empty:  # a bucket without levels; a row without one is left out below, as Arrow takes no frame without rows
            return pd.DataFrame({"g": [None], "level": [None], "mean": [0.0], "sd": [0.0]})
        found, mean, covariance = ([], np.zeros(0), np.zeros((0, 0))) if solved.empty else (solved["names"].iloc[0], solved["mean"].iloc[0], solved["covariance"].iloc[0].reshape(-1, len(solved["names"].iloc[0])))
        index = {**{p: k for k, p in enumerate(found)}, RESPONSE: len(found)}
        means, spread = [], []
        for a in range(0, len(own), 1000):
            part = own.iloc[a : a + 1000]
            rows, d = np.zeros((len(part), len(index))), part["d"].to_numpy()
            for r, names, values in zip(rows, part["names"], part["sums"]):
                r[[index[p] for p in names]] = values
            rows *= weight / d[:, None]
            means.append(rows[:, -1] - rows[:, :-1] @ mean)
            spread.append(np.sqrt(1 / d + np.einsum("ij,jk,ik->i", rows[:, :-1], covariance, rows[:, :-1], optimize=True)))
        return pd.DataFrame({"g": own["g"].to_numpy(object), "level": own["level"].to_numpy(object), "mean": np.concatenate(means), "sd": np.concatenate(spread)})

    bucket = F.pmod(F.xxhash64("level"), F.lit(buckets))
    dealt = solved.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")))
    if not terms:
        dealt = dealt.where(F.lit(False))
    one = own.withColumn("bucket", bucket).groupBy("g", "bucket").cogroup(dealt.groupBy("g", "bucket")).applyInPandas(back, f"g {kind}, level string, mean double, sd double")
    one = one.where(F.col("level").isNotNull()).select("g", F.lit(first).alias("term"), "level", "mean", "sd")
    spread = F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.sqrt(F.element_at("covariance", (k - 1) * F.size("names") + k)))
    two = solved.select("g", F.explode(F.arrays_zip("names", "mean", spread.alias("sd"))).alias("e")).select("g", "e.*")
    number = F.substring_index("names", ":", 1)
    two = two.select("g", F.element_at(F.array(*map(F.lit, terms)), number.cast("int") + 1).alias("term"), F.expr("substring(names, instr(names, ':') + 1)").alias("level"), "mean", "sd") if terms else None
    out = one if two is None else one.unionByName(two)
    return out.select(F.col("g").alias(by), "term", F.when(F.col("level") != "", F.expr("substring(level, 2)")).alias("level"), "mean", "sd")
