"""Benchmark decontamination by spaced seeds.

A seed is a run of SPAN words cut into four blocks; a mask keeps two of the blocks and ignores the
rest.  Two substitutions spoil at most two blocks, so of the six masks one still agrees.  The hashes
of the masked windows of the benchmark (bounded blocks of it, in a broadcast) are looked up with
those of every window of every text, and a hit is verified: along its diagonal the best stretch of
equal words, substitutions counted against it, has to be long and equal enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, keep
from .words import NOT_WORD, Words, mixed

_U = np.uint64
BLOCK, BLOCKS, KEPT = 3, 4, 2
SPAN = BLOCK * BLOCKS
MASKS = list(combinations(range(BLOCKS), KEPT))
#: Words that have to agree (or all of a shorter item), and their share in the stretch, as a fraction.
LEAST_WORDS, LEAST_SHARE = 10, (4, 5)
#: Bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 16_000_000
FILTER_BITS = 22


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    out = np.full(max(0, len(words) - size + 1), size, _U)
    for k in range(size if len(out) else 0):
        out = mixed(out + words[k : len(words) - size + 1 + k], k)
    return out


def _masked(words: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of what it keeps of each window of SPAN words."""
    n = len(words) - SPAN + 1
    if n < 1:
        return []
    blocks = _runs(words, BLOCK)
    out = []
    for k, mask in enumerate(MASKS):
        h = np.full(n, k + 100, _U)
        for b in mask:
            h = h * _U(0x9E3779B97F4A7C15) + blocks[b * BLOCK : b * BLOCK + n]
        out.append(mixed(h, 50))
    return out


@dataclass
class Seeds:
    """The seeds of a block of the benchmark, sorted by hash, and its words."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    short: list[int]  #: lengths of items shorter than a seed: their seed is the whole item
    known: np.ndarray  #: a bit for each value of the first bits of a hash

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Seeds:
        words = [w for _, w in Words(NOT_WORD).of([t.lower() for t in texts])]
        hashes, item, pos, short = [], [], [], set()
        for i, w in enumerate(words):
            for h in _masked(w) or ([_runs(w, len(w))] if len(w) else []):
                hashes.append(h)
                item.append(np.full(len(h), i))
                pos.append(np.arange(len(h)))
            if 0 < len(w) < SPAN:
                short.add(len(w))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        h = join(hashes, _U)
        order = np.argsort(h, kind="stable")
        known = np.zeros(1 << FILTER_BITS, bool)
        known[(h >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, words, h[order], join(item, np.int32)[order], join(pos, np.int32)[order], sorted(short), known)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, diagonal) of each seed that a text shares; the diagonal is the item's first word's place."""
        found = set()
        for h in [*_masked(words), *(_runs(words, n) for n in self.short)]:
            at = np.flatnonzero(self.known[(h >> _U(64 - FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                found.update((int(self.item[k]), int(p) - int(self.pos[k])) for k in range(a, b))
        return iter(sorted(found))

    def overlap(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(first word, words compared, words equal) of the stretch with most equal words on a diagonal, if one counts.

        With 1 for an equal word and -cost for another, a stretch has its share of equal words where its
        sum isn't negative; the longest such one up to a word starts where the sums were first as low."""
        own = self.words[item]
        lo, hi = max(0, -diagonal), min(len(own), len(words) - diagonal)
        same = own[lo:hi] == words[lo + diagonal : hi + diagonal]
        sums = np.concatenate([[0], np.cumsum(np.where(same, LEAST_SHARE[1] - LEAST_SHARE[0], -LEAST_SHARE[0]))])
        low = np.minimum.accumulate(sums)
        starts = np.searchsorted(-low, -sums, "left")  # the first place where ``low`` is at most the sum
        equals = np.concatenate([[0], np.cumsum(same)])
        last = int(np.argmax(equals - equals[starts]))
        at = np.flatnonzero(same[starts[last] : last]) + starts[last]  # without unequal words at the ends
        if len(at) < min(LEAST_WORDS, len(own)) or not len(at):
            return None
        return lo + int(at[0]) + diagonal, int(at[-1] - at[0]) + 1, len(at)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id, first_word, n_words and n_equal for each row of ``docs`` that shares a stretch
    with an item of ``benchmark``: the longest one of each pair.

    Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case.  A stretch
    counts with 10 equal words (or all of a shorter item) that are 80 % of it; up to two substitutions in 12
    words can't hide one.  Null and empty texts, and items without a word, share nothing.  Repeated
    rows are reported each; a repeated item id counts once for each text.  Empty tables give an
    empty result; further columns are not read.  Of equally long stretches with an item the first counts.  The benchmark is taken in blocks of BLOCK_BYTES, each a pass over ``docs``.
    """
    rows = columns(docs, key, text).toDF("doc_id", "text")
    items = columns(benchmark, item_key, item_text).toDF("item_id", "text").where("text is not null").distinct()
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    items = keep(items.withColumn("bytes", F.octet_length("text").cast("long")), "benchmark")
    total = items.agg(F.sum("bytes")).first()[0] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_BYTES))
    out = None
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).select("item_id", "text").toPandas()
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds.of(part["item_id"].tolist(), part["text"].tolist()))
        found = rows.where("text is not null").mapInPandas(_search(seeds), f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, n_equal long")
        if n_blocks > 1:  # the driver and executors hold the seeds of one block at a time
            found = keep(found, "overlaps")
            seeds.destroy()
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("doc_id", key)


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, cut = shared.value, Words(NOT_WORD)
        for df in batches:
            ids, out = df["doc_id"].tolist(), []
            for i, words in cut.of([t.lower() for t in df["text"]]):
                best: dict = {}
                for item, diagonal in seeds.hits(words):
                    found = seeds.overlap(words, item, diagonal)
                    if found and found[2] > best.get(item, (0, 0, 0))[2]:
                        best[item] = found
                out += [(ids[i], seeds.ids[item], *found) for item, found in sorted(best.items())]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "first_word", "n_words", "n_equal"])

    return run
