"""Byte-level BPE by Spark's higher-order functions: ids of whole texts, and their bytes again.

Bytes are text of the characters U+0000 to U+00FF here, so that pieces are joined and looked up as
strings.  The ranks are one literal of the plan: an array of small maps, found by the piece's checksum.

* A text is cut into words by the vocabulary's pattern.  Java knows fewer letters and digits than the
  library does; the ones it lacks are asked of the library and added for texts that may hold them.
* The corpus's distinct words are counted; the most frequent ones (at most ``KNOWN``) are encoded once,
  as rows of their own, and become a second literal, together with the vocabulary itself.
* Encoding a word folds merges over its pieces: ``aggregate`` takes the least rank among neighbours, the
  first where several have it, joins these two, and looks up only the two ranks that changed.
* Lambdas are interpreted: a fold takes about 140 microseconds a word, a look-up in SQL some 5 for each word
  with all around it.  So Arrow batches put the texts' words together, and merge words beyond the known ones
  (rare, or longer than ``KNOWN_BYTES``) by the same rule, long ones by a heap.  Nothing is joined or shuffled
  for them.
* Decoding looks up each id's piece and joins the pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, keep

#: Most words that are encoded beforehand, and the bytes that such a word may have.
KNOWN, KNOWN_BYTES = 60_000, 48
#: Bytes of a word beyond which merges come from a heap.
HEAP_BYTES = 100
#: Rare words that a worker remembers before it starts again (about 200 bytes each).
MEMO = 800_000
#: Maps of a literal table.
BUCKETS = 1 << 16
LATIN = "ISO-8859-1"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file, one piece in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- the pattern ----------------------------------------------------------------------------------------


def _missing(spark: SparkSession, kind: str) -> list[tuple[int, int]]:
    """Ranges of the characters of a Unicode class that the library knows and Java doesn't."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    finder = tiktoken.Encoding("class", pat_str=rf"\p{{{kind}}}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    library = {ord(c) for c in finder.decode(finder.encode_ordinary("".join(map(chr, points))))}
    every = spark.range(0x110000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    java = {r.id for r in every.where(F.col("c").rlike(rf"\A\p{{{kind}}}\z")).select("id").collect()}
    if java - library:
        raise ValueError(f"Java knows characters of class {kind} that the library doesn't")
    out: list[tuple[int, int]] = []
    for c in sorted(library - java):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


_missed: dict[str, dict[str, list[tuple[int, int]]]] = {}


def java_pattern(spark: SparkSession, pattern: str) -> tuple[str, str, str]:
    """The pattern for Java, the one that knows the library's newer characters too, and the class of texts that need it."""
    app = spark.sparkContext.applicationId
    if app not in _missed:
        _missed[app] = {kind: _missing(spark, kind) for kind in ("L", "N")}
    ranges = _missed[app]
    wide, inside, at = "", False, 0
    while at < len(pattern):
        kind = pattern[at + 3] if pattern.startswith((r"\p{L}", r"\p{N}"), at) else ""
        if kind:
            more = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges[kind])
            wide += rf"\p{{{kind}}}{more}" if inside else rf"[\p{{{kind}}}{more}]"
            at += 5
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        wide += pattern[at : at + step]
        at += step
    least = min((a for r in ranges.values() for a, _ in r), default=0x10FFFF)
    return "(?U)" + pattern, "(?U)" + wide, rf"[\x{{{least:X}}}-\x{{10FFFF}}]"


def words_of(text: Column, patterns: tuple[str, str, str]) -> Column:
    """The words of a text, by the pattern; a null text has none."""
    plain, wide, newer = patterns
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(newer), F.regexp_extract_all(text, F.lit(wide), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(plain), F.lit(0)))


# --- tables in the plan ---------------------------------------------------------------------------------


def _table(entries: dict[str, object], kind: str) -> Column:
    """A literal of ``BUCKETS`` maps; folded to a value when the plan is made."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _find(table: Column, key: Column) -> Column:
    return F.get(table, (F.crc32(key.cast("binary")) % BUCKETS).cast("int"))[key]


def as_bytes(text: Column) -> Column:
    """The characters U+0000 to U+00FF as the bytes they stand for."""
    return F.encode(text, LATIN)


def spelled(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters."""
    return F.decode(F.encode(text, "UTF-8"), LATIN)


def folded(word: Column, ranks: Column) -> Column:
    """Ids of a word of at least one byte (as characters), by merges of the least rank."""
    nothing = F.array().cast("array<int>")

    def step(state: Column, _: Column) -> Column:
        parts, near = state["parts"], state["near"]

        def merge(i: Column) -> Column:
            both = F.concat(F.get(parts, i), F.get(parts, i + 1))
            before = F.when(i > 0, F.array(_find(ranks, F.concat(F.get(parts, i - 1), both)))).otherwise(nothing)
            behind = F.when(i + 1 < F.size(near), F.array(_find(ranks, F.concat(both, F.get(parts, i + 2))))).otherwise(nothing)
            return F.struct(
                F.concat(F.slice(parts, 1, i), F.array(both), F.slice(parts, i + 3, F.size(parts))).alias("parts"),
                F.concat(F.slice(near, 1, F.greatest(i - 1, F.lit(0))), before, behind, F.slice(near, i + 3, F.size(near))).alias("near"),
            )

        # rank and place in one number: the least is the first of the least rank
        least = F.array_min(F.transform(near, lambda r, k: r.cast("long") * 65536 + k))
        return F.coalesce(_let((least % 65536).cast("int"), lambda i: F.when(i.isNotNull(), merge(i))), state)

    def run(parts: Column) -> Column:
        near = F.transform(F.slice(parts, 2, F.size(parts)), lambda right, i: _find(ranks, F.concat(F.get(parts, i), right)))
        done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.struct(parts.alias("parts"), near.alias("near")), step)
        return F.transform(done["parts"], lambda piece: _find(ranks, piece))

    whole = _find(ranks, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(F.split(word, ""), run))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a word that isn't known: by the list of its neighbours' ranks, for a long one by a heap."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > HEAP_BYTES:
        return _by_heap(word, ranks)
    rank, never = ranks.get, 1 << 62
    parts = [word[i : i + 1] for i in range(len(word))]
    near = [rank(word[i : i + 2], never) for i in range(len(word) - 1)]
    while near and (least := min(near)) < never:
        i = near.index(least)
        both = parts[i] + parts[i + 1]
        parts[i : i + 2] = [both]
        del near[i]
        if i < len(near):
            near[i] = rank(both + parts[i + 1], never)
        if i:
            near[i - 1] = rank(parts[i - 1] + both, never)
    return [ranks[p] for p in parts]


def _by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


# --- encoding and decoding ------------------------------------------------------------------------------


def known_words(docs: DataFrame, text: str, patterns: tuple[str, str, str], ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Ids of the most frequent words that aren't a token: at most ``KNOWN`` words of ``KNOWN_BYTES`` bytes, from all texts."""
    words = columns(docs, text).toDF("text").select(F.explode(words_of(F.col("text"), patterns)).alias("word")).where(F.octet_length("word") <= KNOWN_BYTES)
    counts = keep(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    # how often the words stand, in steps of a quarter of a doubling: at most 256 rows
    sizes = {r.step: r.words for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("words")).collect()}
    room, least = KNOWN, None
    for step in sorted(sizes, reverse=True):
        room -= sizes[step]
        if room < 0:
            break
        least = step
    if least is None:
        return {}
    table = _table({piece.decode(LATIN): rank for piece, rank in ranks.items()}, "int")
    chosen = counts.where(F.floor(F.log2("n") * 4) >= least).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    ids = _let(table, lambda t: folded(spelled(F.col("word")), t))
    return {r.word: r.ids for r in chosen.select("word", ids.alias("ids")).where(F.size("ids") > 1).collect()}


#: Of a Python worker: the run that it works for, and the ids (packed) of the words it has met.
_memo: dict = {}


class _Assembly:
    """What a task does with the words of its texts.  A class of this module, so that workers share ``_memo``."""

    def __init__(self, shared):
        self.shared, self.name = shared, uuid.uuid4().hex

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = self.shared.value

        def begin() -> None:
            _memo.clear()
            _memo.update(of=self.name, ids={w: np.array(ids, "<i4").tobytes() for w, ids in known.items()})

        if _memo.get("of") != self.name:
            begin()

        def rare(word: str) -> bytes:
            if len(_memo["ids"]) >= MEMO + len(known):
                begin()
            got = _memo["ids"][word] = np.array(merged(word.encode(), ranks), "<i4").tobytes()
            return got

        for batch in batches:
            words, ends, out = batch.column("words"), [0], []
            for i in range(batch.num_rows):  # a text's words at a time
                find = _memo["ids"].get
                out.append(b"".join([find(w) or rare(w) for w in words.slice(i, 1).flatten().to_numpy(zero_copy_only=False)]))
                ends.append(ends[-1] + len(out[-1]) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids, pa.array(out, pa.binary())], ["key", "ids", "packed"])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``packed`` (the same as little-endian unsigned 32-bit numbers) of every whole text.

    Ids are those that the library gives without special tokens.
    Null and empty texts have no ids; strings of special tokens are ordinary text.  Long texts are cut into
    words as others are.  Repeated rows and null keys stay; equal texts have equal ids.  Other columns play no
    part, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranks, patterns = read_ranks(path), java_pattern(spark, pattern)
    # what words are looked up by: themselves
    known = {piece.decode(): [rank] for piece, rank in ranks.items() if _is_text(piece)} | known_words(docs, text, patterns, ranks)
    rows = columns(docs, key, text).toDF("key", "text").select("key", "text", words_of(F.col("text"), patterns).alias("words"))

    work = _Assembly(spark.sparkContext.broadcast((known, ranks)))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "words").mapInArrow(lambda batches: work(batches), f"key {kind}, ids array<int>, packed binary").withColumnRenamed("key", key)


def _is_text(piece: bytes) -> bool:
    try:
        return bool(piece.decode())
    except UnicodeDecodeError:
        return False


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids stand for; an id that the vocabulary lacks is an error."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode(LATIN)
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return as_bytes(_let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.element_at(t, i + 1)), "")))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the packed ids) and decoded_sha256 (of the bytes that decoding gives)."""
    out = encode(docs, path, pattern)
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("packed")).alias("ids_sha256"), digest(decode(F.col("ids"), path)).alias("decoded_sha256"))
