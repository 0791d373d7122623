"""Mixing sources to target weights by Pareto order sampling.

A source that must give ``r`` times its own words gives ``floor(r)`` whole copies of every document
for certain; the rest is a sample without replacement in which a document's inclusion probability is in
proportion to its odds.  Documents whose probability that would bring to 1 are certain, and the others
share what is left.  Documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` and taken in that
order until the words still owed are reached (the fixed size is counted in words, and the document
on the boundary is taken if that comes nearer).  ``u`` is a hash of the id and the text, so reruns agree
and the partitioning plays no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep

#: Weights dealt to the sources in order of their names.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Order buckets of a source, as a power of two; the boundary lies in one of them.
BUCKETS = 1 << 12


def uniform(*cols, seed: str):
    """A number in (0, 1) from the md5 of the columns; the same in any SQL engine."""
    digest = F.md5(F.concat_ws("|", *cols, F.lit(seed)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of the sources ``(source, source_size)``: shares by weight, none above ``most`` times
    its size, what is cut reshared by weight among the others until none is above.

    The level that this arrives at is computed directly: with sources in order of
    ``most * size / weight``, the first k are cut where the level left to the others reaches theirs.
    One row for each source; the sources of a corpus are a short list.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    named = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w.cast("long"))
    named = named.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "place")
    whole = Window.partitionBy(F.lit(0))
    named = (
        named.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("cut", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cut")) / F.col("open"))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(whole))
    )
    level = F.col("first.level")
    target = F.when(F.col("ratio") <= level, F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return named.select("source", "source_size", target.alias("target"))


#: Tables of one row for each source are broadcast up to this many sources, else joined.
MOST_BROADCAST = 100_000


def _sized(docs: DataFrame, key: str, text: str, source: str, weight: str | None, seed: str) -> DataFrame:
    """Each row of ``docs`` as mix$row, with what the draw needs."""
    words = F.coalesce(F.regexp_count(docs[text], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("mix$row")
    given = docs[weight].cast("double") if weight else F.lit(None).cast("double")
    u = uniform(F.coalesce(docs[key].cast("string"), F.lit("")), F.coalesce(F.md5(docs[text]), F.lit("")), seed=seed)
    out = docs.select(row, docs[key].alias("mix$id"), docs[source].alias("mix$source"), given.alias("mix$odds"), words.alias("mix$size"), u.alias("mix$u"))
    odds = F.when(F.col("mix$odds") > 0, F.col("mix$odds")).otherwise(0.0) if weight else F.length(F.bin("mix$size")).cast("double")
    return out.withColumn("mix$odds", F.when(F.col("mix$size") > 0, odds).otherwise(0.0))


def _factors(levels: DataFrame, owed: DataFrame) -> DataFrame:
    """(factor$at, mix$factor): by what a source's odds are to be multiplied for the words owed to be expected.

    ``levels`` has the words of each source and odds.  With the largest odds as certain ones, the others
    share the rest; the first odds that this doesn't bring above 1 end the certain ones."""
    of = Window.partitionBy("mix$source")
    above = F.sum("words").over(of.orderBy(F.desc("mix$odds")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    mass = F.sum(F.col("words") * F.col("mix$odds")).over(of.orderBy("mix$odds").rowsBetween(Window.unboundedPreceding, 0))
    joined = levels.withColumn("above", above).withColumn("mass", mass).join(owed, F.col("mix$source").eqNullSafe(F.col("mix$at")))
    factor = (F.col("mix$owed") - F.col("above")) / F.col("mass")
    fitting = joined.withColumn("factor", factor).where(F.col("factor") * F.col("mix$odds") <= 1)
    return fitting.groupBy("mix$source").agg(F.max_by("factor", "mix$odds").alias("mix$factor")).withColumnRenamed("mix$source", "factor$at")


def _ordered(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Inclusion probability and place in the order of each row; ``per_source`` is keyed by mix$at."""
    joined = sized.join(per_source, F.col("mix$source").eqNullSafe(F.col("mix$at")), "left").drop("mix$at")
    joined = joined.withColumn("mix$p", F.least(F.lit(1.0), F.coalesce("mix$factor", F.lit(0.0)) * F.col("mix$odds")))
    # u(1-p) / (u(1-p) + p(1-u)) orders as (u/(1-u)) / (p/(1-p)) does and lies in (0, 1)
    lead, trail = F.col("mix$u") * (1 - F.col("mix$p")), F.col("mix$p") * (1 - F.col("mix$u"))
    order = F.when(F.col("mix$p") > 0, lead / (lead + trail)).otherwise(1.0)
    return joined.withColumn("mix$order", order).withColumn("mix$rank", F.struct("mix$order", "mix$id", "mix$size", "mix$u"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, seed: str = "mix", carry: bool = False) -> DataFrame:
    """How often each row of ``docs`` is taken, so that sources come near their targets.

    Returns key, size (words of the text), source_size, target, taken (words, repeats counted) and
    copies; with ``carry``, the rows of ``docs`` as often as they are taken.  ``weight`` names a column of
    relative inclusion odds of few different values (null or below 0 counts as 0); without it they are
    the binary digits of a document's size, so longer documents are likelier.  Null and empty texts have size 0 and are never taken.  A null source is a source
    of its own, last in order.  Rows equal in key and text share a rank: all are taken or none, beyond
    the whole copies; other rows of one key, or of none, are drawn apart.  An empty table gives an empty result; further columns play no part, whatever their names.
    """
    narrow = columns(docs, *dict.fromkeys([key, text, source, *([weight] if weight else [])]))
    sized = keep(_sized(narrow, key, text, source, weight, seed).select("mix$id", "mix$source", "mix$odds", "mix$size", "mix$u"), "sizes")
    levels = keep(sized.groupBy("mix$source", "mix$odds").agg(F.sum("mix$size").alias("words")), "levels")
    sums = keep(levels.groupBy(F.col("mix$source").alias("source")).agg(F.sum("words").alias("source_size")), "sources")
    small = sums.count() <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda df: df)

    plan = source_targets(sums.select("source", "source_size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("mix$sure", F.floor(rate)).withColumn("mix$owed", F.col("target") - F.col("mix$sure") * F.col("source_size"))
    plan = plan.select(F.col("source").alias("mix$at"), F.col("source_size").alias("mix$source_size"), F.col("target").alias("mix$target"), "mix$sure", "mix$owed")
    factors = _factors(levels.where("`mix$odds` > 0"), plan.select("mix$at", "mix$owed"))
    plan = keep(plan.join(factors, F.col("mix$at").eqNullSafe(F.col("factor$at")), "left").drop("factor$at"), "plan")

    # the bucket of the order in which a source reaches the words owed, and in it the last rank taken
    drawn = _ordered(sized, hint(plan)).where("`mix$p` > 0").withColumn("bucket", F.floor(F.col("mix$order") * BUCKETS).cast("int"))
    hist = drawn.groupBy("mix$source", "bucket").agg(F.sum("mix$size").alias("words"), F.first("mix$owed").alias("owed"))
    upto = F.sum("words").over(Window.partitionBy("mix$source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = (
        hist.withColumn("upto", upto).where("upto >= owed").groupBy("mix$source")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("edge"))
        .select(F.col("mix$source").alias("edge$at"), F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"))
    )
    running = Window.partitionBy("mix$source").orderBy("mix$order", "mix$id", "mix$size", "mix$u").rowsBetween(Window.unboundedPreceding, 0)
    last = drawn.join(hint(edge), F.col("mix$source").eqNullSafe(F.col("edge$at")) & (F.col("bucket") == F.col("edge")))
    last = last.withColumn("reached", F.col("before") + F.sum("mix$size").over(running))
    short = F.col("mix$owed") - (F.col("reached") - F.col("mix$size"))
    take = (F.col("reached") <= F.col("mix$owed")) | ((short > 0) & (F.col("reached") - F.col("mix$owed") <= short))
    kind = sized.schema["mix$id"].dataType
    nothing = F.struct((F.col("edge") / F.lit(float(BUCKETS))).alias("mix$order"), F.lit(None).cast(kind).alias("mix$id"), F.lit(None).cast("long").alias("mix$size"), F.lit(None).cast("double").alias("mix$u"))
    cut = last.groupBy("mix$source").agg(F.max(F.when(take, F.col("mix$rank"))).alias("cut"), F.min("edge").alias("edge"))
    cut = cut.select(F.col("mix$source").alias("cut$at"), F.coalesce("cut", nothing).alias("mix$cut"))

    per_source = plan.join(cut, F.col("mix$at").eqNullSafe(F.col("cut$at")), "left").drop("cut$at")
    per_source = hint(keep(per_source, "cuts"))
    whole = _ordered(_sized(docs, key, text, source, weight, seed) if carry else sized, per_source)
    extra = (F.col("mix$p") > 0) & (F.col("mix$cut").isNull() | (F.col("mix$rank") <= F.col("mix$cut")))
    copies = F.when(F.col("mix$size") > 0, F.col("mix$sure") + extra.cast("long")).otherwise(0).cast("long")
    whole = whole.withColumn("mix$copies", copies)
    if carry:
        repeats = F.explode(F.array_repeat(F.lit(1), F.col("mix$copies").cast("int"))).alias("mix$copy")
        whole = whole.where("`mix$copies` > 0").select("mix$row", repeats)
        return whole.select(*[F.col("mix$row").getField(c).alias(c) for c in docs.columns])
    return whole.select(
        F.col("mix$id").alias(key), F.col("mix$size").alias("size"), F.col("mix$source_size").alias("source_size"), F.col("mix$target").alias("target"),
        (F.col("mix$copies") * F.col("mix$size")).alias("taken"), F.col("mix$copies").alias("copies"),
    )
