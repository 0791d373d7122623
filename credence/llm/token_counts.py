"""Token counts of whole texts with a byte-level BPE vocabulary, by the whole-token shortcut.

Offline (once for each vocabulary, on the driver) every vocabulary string is encoded alone; those
that are one pre-token and give one token are proven whole.  In the tasks a text is cut into
pre-tokens: proven ones count 1, and only the rest are merged, each distinct one once for a worker
(up to a bound).  Cutting costs most, so runs between single spaces are counted as units: a space
with no white space on one side or the other always opens a pre-token, so such a run's pre-tokens
don't depend on what is around it.  Texts with a space between other white space (a doubled one, or
one between no-break spaces, tabs or line ends), a final space or a special string take the plain way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: A space within white space: it may stay in one pre-token with what is before it.
WITHIN = re.compile(r"\s \s|  ")
#: Counted runs that a worker remembers before it starts again from the proven strings.
MEMO = 1_000_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pattern():
    """The pattern of byte-level pre-tokens."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def merger(path: str):
    """A function from a pre-token to its tokens, by the merges of the vocabulary alone.

    A byte-level vocabulary lists its merges in order of rank, so an id is the rank of its bytes."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that, encoded alone, are one pre-token and one token: a proof by trial
    of each.  The list is bounded by the vocabulary."""
    tok, cut = _tokenizer(path), pattern()
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = sorted({tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())} - special - {""})
    # a piece of a character decodes to U+FFFD, which isn't its string; the trial below settles those too
    once = [s for s in strings if (m := cut.match(s)) and m.end() == len(s)]
    return [s for s, e in zip(once, tok.encode_batch(once, add_special_tokens=False)) if len(e.ids) == 1]


class Counter:
    """Counts tokens; holds the tokenizer, the proven strings and the memo of a worker."""

    def __init__(self, path: str, whole: list[str]):
        self.tok, self.cut, self.whole = _tokenizer(path), pattern(), frozenset(whole)
        self.merge = merger(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.after_space: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.after_space = {w[1:]: 1 for w in self.whole if w[:1] == " " and len(w) > 1}

    def pieces(self, strings: list[str]) -> list[int]:
        """Token counts of strings that hold no special string, by their pre-tokens."""
        whole, merge, cut, out = self.whole, self.merge, self.cut.findall, []
        for s in strings:
            out.append(1 if s in whole else sum(1 if p in whole else len(merge(p)) for p in cut(s)))
        return out

    def plain(self, text: str) -> int:
        """A text of any kind: special strings count 1, what lies between them by pre-tokens."""
        if any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        return self.pieces([text])[0]

    def count(self, texts: list[str]) -> list[int]:
        out, runs = [0] * len(texts), {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if text[-1] == " " or WITHIN.search(text) or any(s in text for s in self.special):
                out[i] = self.plain(text)
            else:
                runs[i] = text.split(" ")
        new = set().union(*(r[1:] for r in runs.values())).difference(self.after_space) if runs else ()
        if new:
            if len(self.after_space) + len(new) > MEMO:
                self.reset()
                new = set().union(*(r[1:] for r in runs.values())).difference(self.after_space)
            new = list(new)
            self.after_space.update(zip(new, self.pieces([" " + x for x in new])))
        first = dict(zip(runs, self.pieces([r[0] for r in runs.values()])))
        seen = self.after_space.__getitem__
        for i, r in runs.items():
            out[i] = first[i] + sum(map(seen, r[1:]))
        return out


def chunks(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of ``texts`` with about ``most`` characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row.

    The counts are those of the tokenizers library without added special tokens; special strings in
    a text are special tokens, as is its default.  Null texts count as empty: no bytes, no tokens.
    Rows are independent of each other: repeated ones repeat, an empty table gives an empty result,
    and columns other than ``key`` and ``text`` are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(path, whole.value)
        for df in batches:
            texts = df["text"].fillna("").tolist()
            counts = [n for a, b in chunks(texts) for n in counter.count(texts[a:b])]
            yield pd.DataFrame({"doc_id": df["doc_id"], "n_bytes": df["n_bytes"], "n_tokens": counts}).astype({"n_tokens": "int64"})

    rows = columns(docs, key, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
