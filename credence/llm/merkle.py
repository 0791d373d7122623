"""A Merkle manifest of a table, in higher-order SQL functions.

Leaves are hashes of rows; each source is a tree of its own over its leaves in order of the key, and
the sources' roots are the leaves of a last tree.  A tree is collapsed a block at a time: the rows of
``BLOCK`` neighbouring nodes become one ordered array, whose levels ``sequence``, ``transform`` and
``slice`` build inside the row, and the roots of the blocks are the nodes of the next round.  On the
way back every node gets its path: for each level, what stands left and right of it in its run.

Nothing larger than a block is gathered, so a source with a third of all rows is only more blocks.
Places come from one range partitioning: rows are numbered within their partition, and the partitions'
counts (a row for each partition and source) give what is before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep

#: Nodes that share a parent.
ARITY = 16
#: Levels that are collapsed inside one row; a block holds ``ARITY ** LEVELS`` nodes.
LEVELS = 2
BLOCK = ARITY**LEVELS
#: Rows of counts up to which they are broadcast (each a short name and two numbers).
MOST_BROADCAST = 100_000
#: Rows that a task judges; fewer where there are more cores than such tasks.
TASK_ROWS = 100_000

PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as the leaves spell it: its UTF-8 bytes' number, a colon and itself; a hyphen where it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within ``grp`` by ``order`` (from 0), and ``n``, the group's size.

    ``order`` has to be total up to equal rows.  Equal rows are told apart by where they were read, so that
    many of them don't fall into one partition."""
    spread = rows.withColumn("salt", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("grp", *order, "salt").sortWithinPartitions("grp", *order, "salt").drop("salt")
    place = F.monotonically_increasing_id()
    placed = keep(ranged.withColumn("place", place).withColumn("at", F.shiftright("place", 33)), "ordered")
    parts = placed.groupBy("at", "grp").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    by_group = Window.partitionBy("grp")
    before = F.sum("here").over(by_group.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")
    parts = keep(parts.select("at", "grp", "first", before.alias("before"), F.sum("here").over(by_group).alias("n")), "counts")
    if parts.count() <= MOST_BROADCAST:
        parts = F.broadcast(parts)
    return placed.join(parts, ["at", "grp"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("at", "place", "first", "before")


def _run(level: Column, run: Column) -> Column:
    return F.slice(level, (run * ARITY + 1).cast("int"), F.lit(ARITY))


def _collapsed(level: Column) -> Column:
    """The parents of a level's nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(_run(level, r), ""), 256))


def _beside(level: Column, at: Column) -> Column:
    """What stands left and right of node ``at`` in its run."""
    run = F.floor(at / ARITY).cast("int")
    left = F.slice(level, run * ARITY + 1, at - run * ARITY)
    right = F.slice(level, at + 2, F.greatest(F.lit(0), F.lit(ARITY - 1) - (at - run * ARITY)))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row a block (grp, block, n): its ``members`` in order and, from ``level0`` on, its levels up to ``top``.

    A group of one block is collapsed until one node is left, a larger one by all ``LEVELS``."""
    member = F.struct("idx", "hash", *carried)
    out = nodes.groupBy("grp", F.floor(F.col("idx") / BLOCK).alias("block"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = out.withColumn("level0", F.col("members.hash"))
    for k in range(LEVELS):
        more = F.col("n") > ARITY**k
        out = out.withColumn(f"level{k + 1}", F.when(more, _collapsed(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    return out.withColumn("top", F.element_at(f"level{LEVELS}", 1))


def _own_path(at: Column) -> Column:
    """The path of node ``at`` of a block inside it."""
    levels = []
    for k in range(LEVELS):
        step = _beside(F.col(f"level{k}"), F.floor(at / ARITY**k).cast("int"))
        levels.append(F.when(F.col("n") > ARITY**k, F.array(step)).otherwise(F.array().cast(PATH)))
    return F.concat(*levels)


def _climbed(blocks: DataFrame, size: int) -> DataFrame:
    """The blocks with ``path`` (of their top, to the group's root) and ``root``; ``size`` is the largest group's."""
    if size <= BLOCK:
        return blocks.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("top"))
    nodes = blocks.select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("hash"))
    upper = _climbed(_blocks(nodes, []), -(-size // BLOCK))
    below = F.transform("members", lambda m, at: F.struct(m["idx"].alias("block"), F.concat(_own_path(at), F.col("path")).alias("path")))
    paths = upper.select("grp", "root", F.explode(below).alias("m")).select("grp", "m.block", "m.path", "root")
    return blocks.join(paths, ["grp", "block"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, changed: dict[str, Column] | None = None,
) -> DataFrame:
    """Every row's leaf, its group's root, the root of all and its proof, and whether a changed row would be noticed.

    Returns ``key``, leaf, subroot, root, proof_sha256, folded_root and verified.  Rows for which ``tampered``
    holds are verified with the columns of ``changed`` in place of their own, all others as they are.

    Nulls in any field are a hyphen in the leaf, unlike any value; a null group is one of its own and comes
    first, a null key comes first in its group.  Equal keys are ordered by their leaves, so that repeated rows
    are leaves of their own whose places don't matter.  Long texts are hashed where they are read.  Columns
    that aren't named play no part, and an empty table gives an empty result.
    """
    mine = columns(docs, *dict.fromkeys([key, group, *fields]))
    bad = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False))
    leaf = digest(*[field(F.col(f)) for f in fields])
    second = digest(*[field((changed or {}).get(f, F.col(f))) for f in fields])
    # the group's name with a mark before it: a null comes first and is unlike any name
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = mine.select(F.col(key).alias("id"), grp.alias("grp"), F.unhex(leaf).alias("raw"), F.when(bad, F.unhex(second)).alias("other"))
    # written first: finding the ranges reads the rows once more, and then not their texts
    nodes = _numbered(keep(leaves, "leaves"), ["id", "raw"]).select("grp", "idx", "n", F.lower(F.hex("raw")).alias("hash"), "id", F.lower(F.hex("other")).alias("other"))

    blocks = keep(_blocks(nodes, ["id", "other"]).select("grp", "block", "n", "members", *[f"level{k}" for k in range(LEVELS)], "top"), "blocks")
    size, total = blocks.agg(F.max("n"), F.sum(F.size("members"))).first()
    size = size or 0
    climbed = keep(_climbed(blocks.select("grp", "block", "n", "top"), size), "tops")

    # the groups' roots are the leaves of the last tree
    roots = climbed.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("hash"))
    ordered = _numbered(roots, ["name"])
    last = _blocks(ordered.select("grp", "idx", "n", "hash", "name"), ["name"])
    over = _climbed(last, roots.count())
    named = F.transform("members", lambda m, at: F.struct(m["name"].alias("grp"), F.concat(_own_path(at), F.col("path")).alias("above")))
    tree = over.select(F.col("root").alias("whole"), F.explode(named).alias("m")).select("m.grp", "whole", "m.above")
    tops = climbed.join(tree, "grp").select("grp", "block", F.col("root").alias("subroot"), "whole", F.concat("path", "above").alias("path"))


    def judged(m: Column, at: Column) -> Column:
        # the path is bound once, for proof and fold; the block's arrays never leave its row
        both = F.transform(F.array(F.concat(_own_path(at), F.col("path"))), lambda p: F.struct(proof(p).alias("proof"), folded(F.coalesce(m["other"], m["hash"]), p).alias("folded")))
        return F.struct(m["id"].alias("id"), m["hash"].alias("leaf"), F.element_at(both, 1).alias("d"))

    # blocks are small rows that cost much: as many tasks as rows ask for, not as bytes do
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TASK_ROWS))
    flat = blocks.join(tops, ["grp", "block"]).repartition(tasks, "grp", "block").select("subroot", "whole", F.explode(F.transform("members", judged)).alias("m"))
    out = flat.select(F.col("m.id").alias(key), "m.leaf", "subroot", F.col("whole").alias("root"), F.col("m.d").alias("d"))
    return out.select(key, "leaf", "subroot", "root", F.col("d.proof").alias("proof_sha256"), F.col("d.folded").alias("folded_root"), (F.col("d.folded") == F.col("root")).alias("verified"))


def manifest_with_tampering(docs: DataFrame) -> DataFrame:
    """:func:`manifest` in which a fifth of the rows, by the checksum of their id, are verified with their text in lower case."""
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed={"text": lowered(F.col("text"))})


def manifest_sql(depth: int = 7, group_depth: int = 3) -> str:
    """The same manifest in DuckDB SQL, for groups of up to ``16 ** depth`` rows and up to ``16 ** group_depth`` groups."""

    def spelled(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    def levels(name: str, start: str, depth: int) -> list[str]:
        parts = [f"{name}0 AS ({start})"]
        for k in range(depth):
            up = "CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h"
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, {up} FROM {name}{k} GROUP BY g, i // 16, n)")
            parts.append(f"{name}r{k} AS (SELECT g, i // 16 AS r, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        return parts

    def climb(name: str, source: str, group: str, place: str, depth: int, out: str) -> list[str]:
        parts, before = [], source
        for k in range(depth):
            p = f"(({place} // {16**k}) % 16)"
            left, right = f"array_to_string(x.hs[1:{p}], '')", f"array_to_string(x.hs[{p} + 2:], '')"
            parts.append(
                f"{out}{k} AS (SELECT a.* EXCLUDE (fold, sib), CASE WHEN x.hs IS NULL THEN a.fold ELSE sha256({left} || a.fold || {right}) END AS fold, "
                f"CASE WHEN x.hs IS NULL THEN a.sib ELSE a.sib || {left} || {right} END AS sib FROM {before} a LEFT JOIN {name}r{k} x ON x.g = a.{group} AND x.r = a.{place} // {16 ** (k + 1)})"
            )
            before = f"{out}{k}"
        return parts

    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[xor(a & 255, b) + 1])))"
    table = "crc AS (SELECT list(list_reduce(list_prepend(v, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY v) AS t FROM range(256) AS u(v))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        table,
        f"leaf AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {spelled('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {spelled(lower)} END AS o FROM documents, crc)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf)",
        *levels("d", "SELECT g, i, n, h FROM placed", depth),
        f"roots AS (SELECT g AS s, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m, h FROM d{depth})",
        *levels("s", "SELECT 0 AS g, j AS i, m AS n, h FROM roots", group_depth),
        f"start AS (SELECT p.doc_id, p.g, p.i, 0 AS zero, r.j, p.h AS leaf, r.h AS subroot, t.h AS root, coalesce(p.o, p.h) AS fold, '' AS sib FROM placed p JOIN roots r ON p.g = r.s, s{group_depth} t)",
        *climb("d", "start", "g", "i", depth, "up"),
        *climb("s", f"up{depth - 1}", "zero", "j", group_depth, "top"),
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM top{group_depth - 1}"
