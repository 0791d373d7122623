"""Balanced label propagation over groups of linked documents, with DataFrame operations only.

Links join documents with equal texts.  Labels are shards.  In each round a group's members ask to move
to the label that most of them have; which of equally common ones is drawn anew for each round.  Shards
are full from the start, so moves are exchanges: of the requests from u to v as many rows go as ask to go
from v to u, in order of gain, and what room v has left is shared among those that ask beyond that.
Rounds go on until several in a row move nothing.  Nothing is ever paired: neighbour labels are counts
per (group, label), and members that share a group and a hash part form one weighted cell, so a group
that holds a third of all rows is at most ``PARTS`` rows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, forget, keep

#: Hash parts of a group; a multiple of every useful shard count, and the bound on a group's cells.
PARTS = 512
#: Priority steps of the queue between two shards: gain classes times hash steps.
GAIN_STEPS, HASH_STEPS = 16, 64
#: Rounds without a move, each with choices of its own, after which no move is taken to gain.
QUIET = 3


def _at(values: list[int], index: Column) -> Column:
    """``values[index]`` for a short list of driver-side numbers."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def _granted(asked: DataFrame, room: list[int]) -> DataFrame:
    """(label, target, queue) of the requests that are granted; at most shards² * GAIN_STEPS * HASH_STEPS rows are compared."""
    waiting = asked.where(F.col("target") != F.col("label")).groupBy("label", "target", "queue").agg(F.sum("n").alias("want"))
    flows = waiting.groupBy("label", "target").agg(F.sum("want").alias("out"))
    back = flows.select(F.col("label").alias("target"), F.col("target").alias("label"), F.col("out").alias("back"))
    flows = flows.join(back, ["label", "target"], "left").withColumn("back", F.coalesce("back", F.lit(0))).withColumn("over", F.greatest(F.col("out") - F.col("back"), F.lit(0)))
    # room goes to those that ask beyond what is exchanged, in proportion and rounded to a sum of at most the room
    upto = F.sum("over").over(Window.partitionBy("target").orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    every = F.greatest(F.sum("over").over(Window.partitionBy("target")), F.lit(1))
    flows = flows.withColumn("upto", upto).withColumn("every", every).withColumn("room", F.least(_at(room, F.col("target")), F.col("every")))
    part = lambda x: F.floor(x.cast("decimal(20,0)") * F.col("room") / F.col("every")).cast("long")
    share = part(F.col("upto")) - part(F.col("upto") - F.col("over"))
    flows = flows.select("label", "target", (F.least("out", "back") + share).alias("most"))
    before = Window.partitionBy("label", "target").orderBy("queue").rowsBetween(Window.unboundedPreceding, 0)
    return waiting.withColumn("sofar", F.sum("want").over(before)).join(flows, ["label", "target"]).where("sofar <= most").select("label", "target", "queue", F.lit(1).alias("granted"))


def _propagate(cells: DataFrame, quota: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """Labels of the cells ``(link, part, n, label)`` after the rounds, and the load of each shard."""
    n_shards = len(quota)

    def load_of(df: DataFrame) -> tuple[list[int], int, int]:
        got = df.groupBy("label").agg(F.sum("n").alias("n"), F.sum("asked").alias("a"), F.sum("moved").alias("m")).collect()
        load = [0] * n_shards
        for r in got:
            load[r.label] = r.n
        return load, sum(r.a for r in got), sum(r.m for r in got)

    load, _, _ = load_of(cells)
    quiet = 0
    for step in range(rounds):
        room = [max(0, q - x) for q, x in zip(quota, load)]
        of_group = Window.partitionBy("link")
        drawn = F.xxhash64("link", "label", F.lit(step))
        asked = (
            cells.withColumn("votes", F.sum("n").over(Window.partitionBy("link", "label")))
            .withColumn("total", F.sum("n").over(of_group))
            .withColumn("best", F.max(F.struct("votes", drawn.alias("drawn"), "label")).over(of_group))
            .withColumn("target", F.col("best.label"))
            .withColumn("gain", F.col("best.votes") / F.col("total"))
            .withColumn("queue", F.floor((1 - F.col("gain")) * (GAIN_STEPS - 1)).cast("int") * HASH_STEPS + F.pmod(F.xxhash64("link", "part", F.lit(step)), F.lit(HASH_STEPS)).cast("int"))
        )
        granted = _granted(asked, room)
        if n_shards <= 16:
            granted = F.broadcast(granted)
        moved = asked.join(granted, ["label", "target", "queue"], "left").withColumn("go", F.col("granted").isNotNull())
        new = keep(moved.select("link", "part", "n", F.when(F.col("go"), F.col("target")).otherwise(F.col("label")).cast("int").alias("label"), (F.col("target") != F.col("label")).cast("int").alias("asked"), F.col("go").cast("int").alias("moved")), "cells")
        forget(cells)
        cells = new
        load, asks, went = load_of(cells)
        quiet = 0 if went else quiet + 1
        if quiet == QUIET or asks == went:  # what asked has moved, so that every group is in one shard, or none gains
            break
    return cells, load


def shard_documents(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", rounds: int = 100) -> DataFrame:
    """Every row of ``docs`` in one of ``n_shards`` shards whose row counts differ by one at most.

    Returns key, size (UTF-8 bytes plus 1), text_crc32, law ('rows'), shard, slot (gapless from 0
    within a shard), grown_shard (null: this law has none) and linked (rows that share the text).

    Linked documents share a shard as far as the quotas allow, by exchanges until none gains (``rounds`` is
    there to end a run that would never be quiet); documents without a link are equally
    good anywhere and fill what room is left.  Null texts have size 1, checksum 0 and no link; empty
    texts are equal texts.  Repeated rows are documents of their own.  An empty table gives an empty
    result, and columns other than ``key`` and ``text`` are not read.
    """
    if not 1 <= n_shards <= PARTS:
        raise ValueError(f"n_shards must lie between 1 and {PARTS}")
    rows = columns(docs, key, text).toDF("doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("link"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("salt"),  # spreads rows without an id
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", "salt", F.lit("part")), F.lit(PARTS)).cast("int"))
    rows = keep(rows, "rows")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = (
        rows.where("link is not null").groupBy("link", "part").agg(F.count("*").alias("n"))
        .withColumn("linked", F.sum("n").over(Window.partitionBy("link"))).where("linked > 1")
        .select("link", "part", "n", F.pmod("part", F.lit(n_shards)).cast("int").alias("label"), F.lit(0).alias("asked"), F.lit(0).alias("moved"))
    )
    cells, load = _propagate(keep(cells, "cells"), quota, rounds)

    # ranks within (wanted shard, bucket), made global by the buckets' running counts
    buckets = max(1024, -(-total // 1_000_000))
    placed = (
        rows.join(cells.select("link", "part", "label"), ["link", "part"], "left")
        .withColumn("want", F.coalesce("label", F.lit(-1)))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "salt", "text_crc32", F.lit("slot")), F.lit(buckets)).cast("int"))
    )
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("want", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1)
    sizes = placed.groupBy("want", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("want").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    placed = placed.join(starts, ["want", "bucket"]).withColumn("rank", F.col("rank") + F.col("start"))

    singles = total - sum(load)
    stay = [min(x, q) for x, q in zip(load, quota)]
    evicted_before = [sum(x - k for x, k in zip(load[:s], stay[:s])) for s in range(n_shards)]
    filled = [sum(q - k for q, k in zip(quota[:s], stay[:s])) for s in range(n_shards + 1)]
    want = F.greatest("want", F.lit(0))
    stays = (F.col("want") >= 0) & (F.col("rank") < _at(stay, want))
    filler = F.when(F.col("want") < 0, F.col("rank")).otherwise(F.lit(singles) + _at(evicted_before, want) + F.col("rank") - _at(stay, want))
    placed = placed.withColumn("filler", filler).withColumn("stays", stays)
    # filled[s] <= filler < filled[s + 1] finds the shard that a filler goes to
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in filled[1:]]), lambda v: v <= F.col("filler")))
    placed = placed.withColumn("shard", F.when(F.col("stays"), F.col("want")).otherwise(to).cast("int"))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(_at(stay, F.col("shard")) + F.col("filler") - _at(filled[:-1], F.col("shard")))
    return placed.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), (F.col("want") >= 0).alias("linked"),
    )
