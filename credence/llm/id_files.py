"""Token-id files with keyed access: raw id payloads, and in each a minimal perfect hash index.

A file holds the documents of one range of keys in ascending order:

    magic | ids, little-endian | keys i8[n] | null flags u1[n] | starts u8[n + 1] | index | footer JSON | footer length u8

The index maps a key to the place of its first document: levels of bit arrays in which a key owns
the bit that it alone hashes to (keys that collide go on to the next level); the rank of the bit is
the key's slot, which stores a fingerprint of the key and the place.  A lookup reads a constant
number of words and rejects foreign keys by their fingerprint.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh_path, keep
from .token_counts import _tokenizer, chunks

MAGIC = b"CREDIDS1"
#: Runs that a worker remembers before it starts again.
MEMO = 1_000_000
#: Runs of characters that no normalisation but lower-casing changes, alone or side by side: visible ASCII, letters
#: of Latin-1 and Latin Extended-A but for the dotted capital I (which becomes two characters), and marks of prose.
SAFE = re.compile("[!-~À-ÖØ-öø-įı-ſ«»„“”‘’–—…¡¿]+").fullmatch
#: The letters that byte-level vocabularies write for bytes.
BYTE_LEVEL = {b: chr(c) for c, b in enumerate((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)), 256)}
#: Ids or documents after which a task begins a new file; it holds a key and a count for each document.
FILE_IDS, FILE_DOCS = 64_000_000, 2_000_000
_U = np.uint64


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix (the finaliser of SplitMix64) of each number."""
    z = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class PerfectIndex:
    """Minimal perfect hash over distinct 64-bit keys, with a fingerprint and a value in each slot."""

    GAMMA, MOST_LEVELS = 2, 64

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, places: np.ndarray):
        self.levels, self.prints, self.places = levels, prints, places
        self.ranks, base = [], 0
        for words in levels:  # set bits before each word
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray, places: np.ndarray) -> PerfectIndex:
        keys, levels = keys.astype(_U), []
        rest = keys
        while len(rest):
            if len(levels) == cls.MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-cls.GAMMA * len(rest) // 64) * 64
            at = (mixed(rest, len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        index = cls(levels, np.zeros(len(keys), "<u2"), np.zeros(len(keys), "<u8"))
        slots = index.slots(keys)
        index.prints[slots], index.places[slots] = cls.fingerprint(keys), places
        return index

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 1000) >> _U(48)).astype("<u2")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        keys = keys.astype(_U)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = mixed(keys[todo], level) % _U(64 * len(words))
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            hit = (words[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(words[word] & ((_U(1) << bit) - _U(1)))
            out[todo[hit]] = (ranks[word] + below)[hit]
            todo = todo[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for keys that are not here (but for one in 65,536 of them)."""
        slots = self.slots(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == self.fingerprint(keys[known])
        return np.where(known, self.places[np.where(known, slots, 0)].astype(np.int64) if len(self.places) else -1, -1)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Writes one file; documents must come in ascending order of their keys, null first."""

    def __init__(self, uri: str, dtype: str):
        filesystem, path = _filesystem(uri)
        self.uri, self.dtype, self.out = uri, dtype, filesystem.open_output_stream(path)
        self.out.write(MAGIC)
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // np.dtype(self.dtype).itemsize)

    def close(self) -> dict:
        nulls = np.array([k is None for k in self.keys], "u1")
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        starts = np.concatenate([[0], np.cumsum(np.array(self.counts, "<u8"), dtype="<u8")]).astype("<u8")
        known = np.flatnonzero(nulls == 0)
        distinct, first = np.unique(keys[known], return_index=True)
        index = PerfectIndex.build(distinct.view(_U), known[first])
        parts = {"keys": keys, "nulls": nulls, "starts": starts, "prints": index.prints, "places": index.places}
        parts |= {f"level{i}": words for i, words in enumerate(index.levels)}
        at, where = len(MAGIC) + int(starts[-1]) * np.dtype(self.dtype).itemsize, {}
        for name, part in parts.items():
            self.out.write(part.tobytes())
            where[name] = [at, len(part), part.dtype.str]
            at += part.nbytes
        footer = json.dumps({"ids": self.dtype, "levels": len(index.levels), "parts": where}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little"))
        self.out.close()
        return {"file": self.uri, "n_docs": len(keys), "n_ids": int(starts[-1])}


class FileReader:
    """Reads a file of :class:`FileWriter`: by key, or all documents in order."""

    def __init__(self, uri: str):
        filesystem, path = _filesystem(uri)
        self.src = filesystem.open_input_file(path)
        size = self.src.size()
        length = int.from_bytes(self._at(size - 8, 8), "little")
        self.footer = json.loads(self._at(size - 8 - length, length))
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no id file")
        self.dtype = np.dtype(self.footer["ids"])
        self.keys, self.nulls, self.starts = (self._part(n) for n in ("keys", "nulls", "starts"))
        self.index = PerfectIndex([self._part(f"level{i}") for i in range(self.footer["levels"])], self._part("prints"), self._part("places"))

    def _at(self, offset: int, length: int) -> bytes:
        return self.src.read_at(length, offset)

    def _part(self, name: str) -> np.ndarray:
        offset, n, kind = self.footer["parts"][name]
        return np.frombuffer(self._at(offset, n * np.dtype(kind).itemsize), kind)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to ``last``, counted over the file."""
        size = self.dtype.itemsize
        return np.frombuffer(self._at(len(MAGIC) + first * size, (last - first) * size), self.dtype)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document with this key; None if there is none."""
        place = int(self.index.find(np.array([key], np.int64).view(_U))[0])
        if place < 0 or self.nulls[place] or self.keys[place] != key:
            return None
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))

    def close(self) -> None:
        self.src.close()


#: How this vocabulary normalises and cuts: what ``Runs`` does on SAFE runs holds for these settings.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def _cutter(tok):
    """The pattern that cuts a lower-cased SAFE run into the library's pre-tokens; None for a vocabulary of other settings."""
    import regex

    spec = json.loads(tok.to_str())
    if any(spec[k] != v for k, v in KNOWN.items()) or any(t["normalized"] or t["content"].isalpha() for t in spec["added_tokens"]):
        return None
    return regex.compile(KNOWN["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])


class Runs(dict):
    """The ids of runs as bytes; a run that isn't known yet is encoded and kept.

    Runs of SAFE characters are lower-cased and cut into pre-tokens, which (alone, such runs themselves)
    get their ids from the library's model; any other run is encoded whole by the library, and so is
    one with a special string."""

    def __init__(self, path: str, dtype: str):
        super().__init__()
        self.tok, code = _tokenizer(path), np.dtype(dtype).char
        self.cut, self.model = _cutter(self.tok), self.tok.model
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or r"(?!)").search
        self.pack = lru_cache(1024)(lambda n: struct.Struct(f"<{n}{code}").pack)

    def __missing__(self, run: str) -> bytes:
        if not self.cut or not SAFE(run) or not run.isalpha() and self.special(run):
            ids = self.tok.encode(run, add_special_tokens=False).ids
            found = self.pack(len(ids))(*ids)
        else:
            low = run.lower()
            pieces = [low] if low.isalpha() else self.cut.findall(low)
            if pieces == [run]:
                seen = run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_LEVEL)
                ids = [t.id for t in self.model.tokenize(seen)]
                found = self.pack(len(ids))(*ids)
            else:
                found = b"".join(map(self.__getitem__, pieces))
        self[run] = found
        return found


class RunEncoder:
    """Ids of texts.  Splitting at single spaces and line ends changes nothing for a vocabulary that
    drops white space, so each distinct run is encoded once for a worker."""

    def __init__(self, path: str, end_id: int, dtype: str):
        self.memo = Runs(path, dtype)
        self.end = np.array([end_id], dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, out = self.memo.__getitem__, []
        for text in texts:
            if len(self.memo) > MEMO:
                self.memo.clear()
            out.append(b"".join(map(ids, text.replace("\n", " ").split(" "))) + self.end)
        return out


@cache
def encoder(path: str, end_id: int, dtype: str) -> RunEncoder:
    """The encoder of a worker, which outlives its tasks."""
    return RunEncoder(path, end_id, dtype)


def write_id_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode ``docs`` into id files under ``folder`` in ascending order of ``key``.

    Returns the manifest: part, seq (the files' order), file, n_docs, n_ids.  One range of keys is
    one task; it holds one document at a time and begins a new file after FILE_IDS ids or FILE_DOCS documents.  A task
    that runs again writes files of new names, and only those of the attempt that ended are listed.
    """
    spark = docs.sparkSession
    vocabulary = _tokenizer(path).get_vocab_size()
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    rows = columns(docs, key, text).toDF("k", "text").select(F.col("k").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    n, most_ids, most_docs = files or int(spark.conf.get("spark.sql.shuffle.partitions")), FILE_IDS, FILE_DOCS
    rows = rows.repartitionByRange(n, "k", F.xxhash64("text")).sortWithinPartitions("k", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, writer, written = TaskContext.get().partitionId(), 0, None, 0
        encode = encoder(path, end_id, dtype).encode
        _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
        for df in batches:
            keys = [None if pd.isna(k) else int(k) for k in df["k"].tolist()]
            texts = df["text"].tolist()
            for a, b in chunks(texts):
                for k, ids in zip(keys[a:b], encode(texts[a:b])):
                    if writer is None:
                        writer = FileWriter(f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids", dtype)
                    writer.add(k, ids)
                    written += len(ids) // np.dtype(dtype).itemsize
                    if written >= most_ids or len(writer.keys) >= most_docs:
                        yield pd.DataFrame([{"part": part, "seq": seq} | writer.close()])
                        writer, written, seq = None, 0, seq + 1
        if writer is not None:
            yield pd.DataFrame([{"part": part, "seq": seq} | writer.close()])

    return keep(rows.mapInPandas(run, "part int, seq int, file string, n_docs long, n_ids long"), "manifest")


def read_id_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the
    files, looked up through their indexes.  The manifest has a row for each file.

    Null and empty texts have the end id alone; null and repeated keys have a row for each document;
    without files there are no rows."""
    order = Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)
    based = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids")).select("file", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for file, base in zip(df["file"], df["base"]):
                reader = FileReader(file)
                known = np.flatnonzero(reader.nulls == 0)
                first = reader.index.find(reader.keys[known].view(_U))
                if (first < 0).any() or (reader.keys[first] != reader.keys[known]).any():
                    raise ValueError(f"the index of {file} misses keys")
                total, lo = len(reader.keys), 0
                while lo < total:  # stretches of about a million ids
                    hi = max(lo + 1, int(np.searchsorted(reader.starts, int(reader.starts[lo]) + 1_000_000, "right")) - 1)
                    hi = min(hi, total)
                    offset = int(reader.starts[lo])
                    ids = reader.ids(offset, int(reader.starts[hi])).astype("<u4")
                    cuts = (reader.starts[lo : hi + 1] - _U(offset)).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                    keys = pd.Series(reader.keys[lo:hi]).astype("Int64").mask(reader.nulls[lo:hi] == 1)
                    yield pd.DataFrame({"k": keys, "start": cuts[:-1] + offset + int(base), "n_tokens": np.diff(cuts), "ids_crc32": np.array(crc, np.int64)})
                    lo = hi
                reader.close()

    out = based.repartition(n).mapInPandas(run, "k long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.col("k").alias(key), "start", "n_tokens", "ids_crc32")


def id_files(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as id files in the shared folder and read them back.

    Null and empty texts are documents of the end id alone.  Null keys come first; repeated keys
    stay in a row, and the index gives the first of them.  An empty table gives no file and an empty
    result.  Columns other than ``key`` (an integer) and ``text`` are not read.
    """
    folder = fresh_path(docs.sparkSession, "ids")
    return read_id_files(write_id_files(docs, path, folder, end_id, key, text), key)
