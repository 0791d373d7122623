"""Exact self-join of texts on the Jaccard similarity of their word n-grams, and its components.

Universe partition and pigeonhole: a hash deals the universe of shingles into ``m`` segments.  Two
sets that are similar enough differ in at most ``H`` shingles, where H follows from the sizes; so
with segments that allow no difference (weight 1) or one (weight 2) and a total weight of ``H + 1 +
E``, segments of total weight ``E + 1`` at least must match.  A set indexes the hash of each segment,
and for segments of weight 2 also those with one shingle deleted.  How many segments there are, how
many of them get deletions and how many shingles a signature needs is chosen for each band of sizes by
an estimate of cost: deletions make signatures, and small contents make chance matches.  The slack ``E``
pays for smaller contents: a set leaves those out while the segments they can matter to weigh at most
``E``, and a set with more of them indexes all.

Sets, not documents, are joined: equal sets are one node.  The sets of a signature are a group.  Each set
is tried against one pivot of its group; that joins most of a large group of near copies.  What is still
apart goes on where its group holds others whose size and sketch allow the similarity: sets connected by
such likely links are a family, and within families whole sets are verified, each in one place and not
in every group.  Tasks give back links of a forest, never pairs: no more rows than they read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, forget, keep
from .words import WHITE, Words, mixed, shingles

_U = np.uint64
#: Sets of a group whose sketches one task compares with each other, and shingles of a group whose sets it does.
BLOCK, WEIGHT = 4000, 2_000_000
#: Nodes whose links a task remembers.
MEMORY = 500_000
#: Buckets of a set's sketch, as a power of two.
LEAST_BITS, MOST_BITS = 7, 13
#: Tables of at most this many rows of two numbers may be broadcast.
MOST_BROADCAST = 500_000


@cache
def _allocation(h: int, size: float, trial: float, common: float) -> tuple[int, int, int, int]:
    """The cheapest (segments, segments with deletions, slack, least content) for sets of ``size`` that differ in ``h`` shingles at most.

    A segment's shingles are a Poisson number; the slack covers the weight that falls to contents below
    the least one, on average and two deviations more."""
    best = None
    for least in range(1, 6):
        for m in np.unique(np.geomspace(-(-(h + 1) // 2), 2 * (h + 1), 60).astype(int)).tolist():
            each = size / m
            chance = [math.exp(-each)]
            for k in range(1, 60):
                chance.append(chance[-1] * each / k)
            below, upto, need = sum(chance[:least]), sum(chance[: least + 1]), 0
            for _ in range(50):  # deletions bring more weight to cover
                deleting = min(m, max(0, h + 1 + need - m))
                lost = (m - deleting) * below + 2 * deleting * upto
                if (more := math.ceil(lost + 2 * math.sqrt(2 * lost))) <= need:
                    break
                need = more
            slack = m + deleting - h - 1
            floor = least if slack >= need else 0  # else most sets index all contents
            cost = m + deleting * each + trial * m * sum(c * common**k for k, c in enumerate(chance) if k >= floor)
            if best is None or cost < best[0]:
                best = (cost, m, deleting, slack, least)
    return best[1:]


class Scheme:
    """Bands of set sizes and the allocation of each, for a similarity of ``num / den`` or more."""

    #: Cost model: what a chance match of a segment costs in signatures, and how likely one shingle is to be a common one.
    TRIAL, COMMON = 10, 0.35

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den

    def differences(self, small: int) -> int:
        """The largest symmetric difference of a set of this size and a similar one of at least this size."""
        large = small * self.den // self.num
        total = small + large
        return total - 2 * -(-self.num * total // (self.num + self.den))

    @cache
    def lows(self, upto: int) -> list[int]:
        """The least size of each band, up to the band that holds ``upto``; smaller sets are similar to equal ones alone."""
        low = 1
        while self.differences(low) == 0:
            low += 1
        out = [low]
        while out[-1] <= upto:
            out.append(out[-1] * self.den // self.num + 1)
        return out

    @cache
    def allocation(self, band: int) -> tuple[int, int, int, int]:
        """The allocation for sets whose smaller one is in ``band``."""
        low = self.low(band)
        top = self.low(band + 1) - 1
        return _allocation(max(self.differences(s) for s in range(low, top + 1)), (low + top) / 2, self.TRIAL, self.COMMON)

    @cache
    def low(self, band: int) -> int:
        size = 64
        while len(self.lows(size)) <= band:
            size *= 4
        return self.lows(size)[band]

    def bands(self, n: int) -> list[int]:
        """The bands in which a set of ``n`` shingles is indexed: its own, and that of smaller partners."""
        lows = self.lows(1 << max(6, n.bit_length()))
        if n < lows[0]:
            return []
        own = int(np.searchsorted(lows, n, "right")) - 1
        return [own, own - 1] if own and n <= (lows[own] - 1) * self.den // self.num else [own]


def signatures(items: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The signatures of a set of shingle hashes."""
    n, out = len(items), []
    value, place = mixed(items, 21), mixed(items, 22) >> _U(32)
    for band in scheme.bands(n):
        m, deleting, slack, least = scheme.allocation(band)
        segment = (place * _U(m)) >> _U(32)
        order = np.argsort(segment, kind="stable")
        segment, inside = segment[order], value[order]
        counts = np.bincount(segment.astype(np.int64), minlength=m)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(inside, dtype=_U)])
        ends = np.cumsum(counts)
        sums = sums[ends] - sums[ends - counts]
        lost = int((counts[deleting:] < least).sum()) + 2 * int((counts[:deleting] <= least).sum())
        floor = least if lost <= slack else 0
        each = counts[segment.astype(np.int64)]
        left = (segment < _U(deleting)) & (each > floor)
        ids = np.flatnonzero(counts >= floor)
        pairs = [(sums[ids], ids.astype(_U)), (sums[segment[left].astype(np.int64)] - inside[left], segment[left])]
        out += [mixed(s + mixed(i + _U(band << 32), 23), 24) for s, i in pairs]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def _profile(items: np.ndarray) -> int:
    """A 64-bit fingerprint of a set: its node."""
    return int(mixed(np.array([mixed(items, 31).sum(dtype=_U) + _U(len(items))], _U), 32).view(np.int64)[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node that links lead to.

    Labels of neighbours, then labels of labels, until nothing changes; a well-connected node is
    one row of an aggregate, not a list."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = hooked.join(far, "new").select("node", F.least("new", "far").alias("new"), "label")
        moved = keep(moved.select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        changed = moved.where("moved").limit(1).count()
        forget(labels)
        labels = moved.select("node", "label")
        if not changed:
            forget(both)
            return labels


def _sketch(items: np.ndarray) -> np.ndarray:
    """Shingles counted by hash, so that sets that differ in d shingles have sketches that differ by d at most.

    There are four to eight shingles to a bucket in larger sets; adjacent buckets add up to those of half the width."""
    bits = min(MOST_BITS, max(LEAST_BITS, len(items).bit_length() - 3))
    counts = np.bincount((mixed(items, 41) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal ``keys`` of sorted batches, whole."""
    held = None
    for df in batches:
        df = df if held is None else pd.concat([held, df], ignore_index=True)
        key = df[keys].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for a, b in zip(starts[:-1], starts[1:]):
            yield df.iloc[a:b]
        held = df.iloc[starts[-1] :]  # the last group may go on
    if held is not None and len(held):
        yield held


class Forest:
    """Which nodes the links so far connect, as far as a task remembers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(above, above)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _regrouped(rows: DataFrame) -> DataFrame:
    """(group, size, node, n, label) of rows (group, node, n, label): groups with the same sets are one."""
    of_group = Window.partitionBy("group")
    group, size = F.bit_xor(F.xxhash64("node", F.lit("group"))).over(of_group), F.count("*").over(of_group)
    return rows.select(group.alias("group"), size.alias("size"), "node", "n", "label").distinct().where("size > 1")


def _dealt(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """Rows with own, i and j: a group is dealt out in ``blocks``, and every two of them (or one with itself) meet once."""
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    out = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")


def _together(dealt: DataFrame) -> DataFrame:
    """Each (group, i, j) in one task, in ascending order of n; as many tasks as the session has shuffle partitions."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "group", "i", "j").sortWithinPartitions("group", "i", "j", "n")


class Likely:
    """Which sets of a block, in ascending order of size, may be similar to which later ones of another label."""

    def __init__(self, scheme: Scheme, df: pd.DataFrame, sketches: list[np.ndarray]):
        self.num, self.den = scheme.num, scheme.den
        self.n, self.own, self.label = (df[c].to_numpy(np.int64) for c in ("n", "own", "label"))
        n, self.same = self.n, df["i"].iloc[0] == df["j"].iloc[0]
        self.ends = np.searchsorted(n, n * scheme.den // scheme.num, "right")
        width = np.array([len(x) for x in sketches])
        self.until = np.searchsorted(width, width, "right")  # similar sizes have the same width or half of it
        self.first = np.searchsorted(width, width, "left")
        self.sketch = {a: np.stack(sketches[a:b]).astype(np.int16) for a, b in zip(np.unique(self.first).tolist(), np.unique(self.until).tolist())}

    def after(self, k: int, part: np.ndarray) -> np.ndarray:
        """Those of another label and ``part`` that come after the k-th."""
        to = slice(k + 1, self.ends[k])
        ok = (self.label[to] != self.label[k]) & (part[to] != part[k])
        if not self.same:
            ok &= self.own[to] != self.own[k]
        at = np.flatnonzero(ok) + k + 1
        if not len(at):
            return at
        first, until = int(self.first[k]), int(self.until[k])
        mine, alike = self.sketch[first][k - first], at[at < until]
        apart = [np.abs(self.sketch[first][alike - first] - mine).sum(1, dtype=np.int64)]
        if len(alike) < len(at):
            wider = self.sketch[until][at[len(alike) :] - until]
            folded = wider.reshape(len(wider), len(mine), -1).sum(2, dtype=np.int16)
            apart.append(np.abs(folded - mine).sum(1, dtype=np.int64))
        return at[(self.num + self.den) * np.concatenate(apart) <= (self.den - self.num) * (self.n[k] + self.n[at])]


class Join:
    """One run of the join over (doc_id, text)."""

    def __init__(self, docs: DataFrame, scheme: Scheme, size: int):
        self.docs, self.scheme, self.size = docs, scheme, size
        self.kind = docs.schema["doc_id"].dataType.simpleString()

    def profiles(self) -> DataFrame:
        """(doc_id, n, node, sketch) of every row."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut = Words(WHITE)
            for df in batches:
                sets = [(len(s), _profile(s), _sketch(s).tobytes()) for _, w in cut.of(df["text"].tolist()) for s in (shingles(w, size),)]
                yield pd.DataFrame({"doc_id": df["doc_id"], "n": [x[0] for x in sets], "node": [x[1] for x in sets], "sketch": [x[2] for x in sets]})

        return self.docs.mapInPandas(run, f"doc_id {self.kind}, n long, node long, sketch binary")

    def signatures(self) -> DataFrame:
        size, scheme = self.size, self.scheme

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut, seen = Words(WHITE), set()
            for df in batches:
                found, nodes, held = [], [], 0
                for _, w in cut.of(df["text"].tolist()):
                    s = shingles(w, size)
                    node = _profile(s)
                    if node in seen:  # a copy within this task; copies elsewhere are dropped later
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    sigs = signatures(s, scheme)
                    found.append(sigs.view(np.int64))
                    nodes.append(np.full(len(sigs), node, np.int64))
                    held += len(sigs)
                    if held > 200_000:
                        yield pd.DataFrame({"sig": np.concatenate(found), "node": np.concatenate(nodes)})
                        found, nodes, held = [], [], 0
                if found:
                    yield pd.DataFrame({"sig": np.concatenate(found), "node": np.concatenate(nodes)})

        return self.docs.where("doc_id is not null").mapInPandas(run, "sig long, node long")

    def members(self) -> DataFrame:
        """(group, size, node): the sets of each signature that several share.  Signatures with the same sets are one group."""
        of_sig = Window.partitionBy("sig")
        shared = self.signatures().withColumn("least", F.min("node").over(of_sig)).withColumn("most", F.max("node").over(of_sig))
        shared = shared.where("least != most").select("sig", "node").distinct()
        size, group = F.count("*").over(of_sig), F.bit_xor(F.xxhash64("node", F.lit("group"))).over(of_sig)
        return shared.select(group.alias("group"), size.alias("size"), "node").distinct()

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and sketches allow the similarity."""
        num, den = self.scheme.num, self.scheme.den
        one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("of_a"))
        two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("of_b"))
        alike = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                kept = []
                for x, y, n in zip(df["of_a"], df["of_b"], (df["n_a"] + df["n_b"]).tolist()):
                    x, y = (np.frombuffer(v, np.uint8).astype(np.int16) for v in (x, y))
                    width = min(len(x), len(y))
                    apart = np.abs(x.reshape(width, -1).sum(1) - y.reshape(width, -1).sum(1)).sum()
                    kept.append((num + den) * int(apart) <= (den - num) * n)
                yield df.loc[kept, ["a", "b"]]

        return pairs.join(one, "a").join(two, "b").where(alike).mapInPandas(run, "a long, b long")

    def families(self, apart: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, family) of the sets of ``apart`` (group, node, n, label) that may be similar to another of
        their group and not of their label; any two that may be are of one family."""
        scheme = self.scheme
        rows = _regrouped(apart).join(nodes.select("node", "sketch"), "node")
        dealt = _together(_dealt(rows, F.ceil(F.col("size") / BLOCK)).select("group", "i", "j", "own", "n", "node", "label", "sketch"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest = Forest()
            for df in _groups(batches, ["group", "i", "j"]):
                if len(forest.up) > MEMORY:
                    forest = Forest()
                node, out = df["node"].tolist(), []
                likely = Likely(scheme, df, [np.frombuffer(x, np.uint8) for x in df["sketch"]])
                part = np.array([forest.root(x) for x in node])
                for k in range(len(df) - 1):
                    found = likely.after(k, part)
                    for m in found[np.unique(part[found], return_index=True)[1]].tolist():
                        forest.join(node[k], node[m])
                        part[part == part[m]] = part[k]
                        out.append((node[k], node[m]))
                yield pd.DataFrame(out, columns=["a", "b"])

        links = keep(dealt.mapInPandas(run, "a long, b long").distinct(), "likely-links")
        return components(links).withColumnRenamed("label", "family")

    def sets(self, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, items) of the nodes ``wanted`` (node), from the text of one document of each."""
        size = self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cut = Words(WHITE)
            for df in batches:
                nodes, out = df["node"].tolist(), []
                for i, w in cut.of(df["text"].tolist()):
                    s = shingles(w, size)
                    if _profile(s) == nodes[i]:  # a repeated id may have another text
                        out.append((nodes[i], s.view(np.int64)))
                yield pd.DataFrame(out, columns=["node", "items"])

        wanted = keep(wanted.distinct().join(nodes.select("rep", "node"), "node"), "wanted")
        few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
        texts = self.docs.join(few, F.col("doc_id") == F.col("rep")).select("node", "text")
        return texts.mapInPandas(run, "node long, items array<long>").dropDuplicates(["node"])

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar: intersections of whole sets, counted exactly."""
        one = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("of_b")), "b")
        both = one.join(sets.select(F.col("node").alias("a"), F.col("items").alias("of_a")), "a")
        shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
        total = F.size("of_a") + F.size("of_b")
        return both.where(self.scheme.den * shared >= self.scheme.num * (total - shared)).select("a", "b")

    def within(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) that join all similar sets of ``rows`` (group, node, n, label) within their groups.

        Every two sets whose sketches allow it are verified on whole sets, unless links join them already;
        a task gives a forest of links back."""
        scheme = self.scheme
        num, den = scheme.num, scheme.den
        rows = rows.withColumn("weight", F.sum("n").over(Window.partitionBy("group")))
        dealt = _dealt(rows, F.ceil(F.col("weight") / WEIGHT)).join(sets, "node")
        dealt = _together(dealt.select("group", "i", "j", "own", "n", "node", "label", "items"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in _groups(batches, ["group", "i", "j"]):
                forest, out = Forest(), []
                items, node, label = df["items"].tolist(), df["node"].tolist(), df["label"].tolist()
                likely = Likely(scheme, df, [_sketch(np.asarray(x).view(_U)) for x in items])
                for k in range(len(df) - 1):
                    part = np.array([forest.root(x) for x in label]) if k == 0 or joined else part
                    joined = False
                    for m in likely.after(k, part).tolist():
                        if forest.root(label[k]) == forest.root(label[m]):
                            continue
                        shared = len(np.intersect1d(items[k], items[m], assume_unique=True))
                        if den * shared >= num * (len(items[k]) + len(items[m]) - shared):
                            joined = forest.join(label[k], label[m])
                            out.append((min(node[k], node[m]), max(node[k], node[m])))
                yield pd.DataFrame(out, columns=["a", "b"])

        return dealt.mapInPandas(run, "a long, b long").distinct()


def ngram_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of every row.

    Words are runs without the bytes 0x20 and 0x09 to 0x0D, A to Z in lower case.  A set holds the
    distinct runs of ``size`` words, or the whole sequence if it is shorter.  Two documents link when
    ``den * intersection >= num * union``; component_id is the least key that links lead to.  Texts
    without words (null and empty ones too) have no shingles and link with nothing: they are their
    own component.  Rows with a null key link with nothing and have no component.  Repeated rows
    share one; an empty table gives an empty result; columns other than ``key`` and ``text`` are not
    read.  Shingles and sets are compared by 64-bit hashes.
    """
    run = Join(columns(docs, key, text).toDF("doc_id", "text"), Scheme(num, den), size)
    profiles = keep(run.profiles(), "profiles")
    nodes = profiles.where("n > 0 and doc_id is not null").groupBy("node")
    nodes = keep(nodes.agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    # the set with most groups is the pivot of its group: a text among its edited copies shares most with the others
    of_group, rank = Window.partitionBy("group"), F.struct(F.count("*").over(Window.partitionBy("node")), F.xxhash64("node"), "node")
    members = keep(run.members().withColumn("rank", rank).select("group", "size", "node", F.max("rank").over(of_group)["node"].alias("pivot")), "members")
    tried = members.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    likely = keep(run.likely(tried, nodes), "likely")
    sets = keep(run.sets(likely.select(F.explode(F.array("a", "b")).alias("node")), nodes), "sets")
    edges = keep(run.linked(likely, sets), "edges")
    forget(sets)
    labels = components(edges)

    # groups that are one component but for their pivot are done
    untried = F.when(F.col("node") != F.col("pivot"), F.col("label"))
    apart = members.join(nodes.select("node", "n"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = apart.withColumn("least", F.min(untried).over(of_group)).withColumn("most", F.max(untried).over(of_group))
    apart = keep(apart.where("least != most and node != pivot").select("group", "node", "n", "label"), "apart")
    families = run.families(apart, nodes)
    rows = apart.select("node", "n", "label").distinct().join(families, "node")
    rows = keep(rows.select(F.col("family").alias("group"), "node", "n", "label"), "families")
    sets = keep(run.sets(rows.select("node"), nodes), "sets")
    found = keep(run.within(rows, sets), "edges")
    if found.limit(1).count():
        labels = components(edges.union(found))

    grouped = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = keep(grouped.join(least, "label").select("node", "component_id"), "components")
    for done in (members, likely, apart, rows, sets, edges, found):
        forget(done)
    out = profiles.join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
