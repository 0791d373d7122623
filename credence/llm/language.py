"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language; the log-probability matrix (buckets x languages) goes
to the executors in a broadcast, and a batch of texts is scored in numpy with the sparse counts of
its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns
from .words import mixed

_U = np.uint64
UNKNOWN = "und"


@dataclass(frozen=True)
class Grams:
    """Hashed n-grams of one to ``longest`` characters, within words with a space on either side."""

    buckets: int = 1 << 14
    longest: int = 3

    def text(self, text: str) -> np.ndarray:
        """Buckets of all n-grams of a text, in stretches if it is long; none without a letter."""
        return np.concatenate([self._stretch(text[i : i + (1 << 18)]) for i in range(0, len(text), 1 << 18)] or [np.zeros(0, np.int64)])

    def _stretch(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = letters()[np.minimum(codes, len(letters()) - 1)]
        if not letter.any():
            return np.zeros(0, np.int64)
        chars = np.where(letter, codes, 32)
        chars = chars[np.concatenate([[True], letter[1:] | letter[:-1]])]  # one space between words
        chars = np.concatenate([[32], chars[int(chars[0] == 32) : len(chars) - int(chars[-1] == 32)], [32]]).astype(_U)
        out, h = [], np.zeros(len(chars), _U)
        for n in range(1, self.longest + 1):
            h = h[: len(chars) - n + 1] * _U(0x100000001B3) + chars[n - 1 :] + _U(n)
            keep = h if n > 1 else h[chars != 32]
            out.append((mixed(keep) >> _U(40)) & _U(self.buckets - 1))
        return np.concatenate(out).astype(np.int64)


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        flags = np.fromiter((chr(c).isalpha() for c in range(0x32400)), bool, 0x32400)
        _letters.append(np.append(flags, False))
    return _letters[0]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logp: np.ndarray  #: buckets x languages
    prior: np.ndarray
    grams: Grams
    #: A text's evidence counts as at most so many n-grams, since those of one text aren't independent.
    evidence: int = 200

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior probability of each text: sparse counts times the matrix."""
        names, scores = [], []
        for text in texts:
            found = self.grams.text(text) if text else np.zeros(0, np.int64)
            if not len(found) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            counts = np.bincount(found, minlength=self.grams.buckets)
            at = np.flatnonzero(counts)
            total = counts[at].astype(np.float64) @ self.logp[at]
            total = self.prior + total * (min(self.evidence, len(found)) / len(found))
            p = np.exp(total - total.max())
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


def held_out(key: str):
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 4000, grams: Grams = Grams(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on the labelled rows that aren't held out: about ``per_language`` rows of each language,
    chosen by a hash of the key (all of them where there are fewer).

    The languages are a short list; what is gathered is ``buckets`` counts for each.  Rows without a
    label or a text teach nothing, rows without a key are learnt from, repeated rows count each.  Without
    a labelled row the model knows no language.  Equal scores go to the language that comes first.
    """
    rows = columns(docs, key, text, lang).toDF("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((grams.buckets, 0)), np.zeros(0), grams)
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(chance < share[F.col("lang")]).where("text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {k: np.zeros(grams.buckets, np.int64) for k in languages}
        for df in batches:
            for t, k in zip(df["text"], df["lang"]):
                held[k] += np.bincount(grams.text(t), minlength=grams.buckets)
        for k, v in held.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"lang": k, "bucket": at, "n": v[at]})

    got = sample.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.zeros((grams.buckets, len(languages)))
    matrix[got["bucket"], got["lang"].map({k: i for i, k in enumerate(languages)})] = got["n"]
    smooth = matrix + 0.5
    prior = np.array([counts[k] for k in languages], float)
    return Model(languages, np.log(smooth / smooth.sum(0)), np.log(prior / prior.sum()), grams)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred and score of every row.

    lang_pred is a language of the model, or 'und' with score 0 where the text is null, empty or has
    no letter.  Whole texts count, long ones in stretches.  Rows with a null key are not held out.
    Repeated rows repeat; an empty table gives an empty result; columns other than ``key`` and
    ``text`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    rows = columns(docs, key, text).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            names, scores = shared.value.score(df["text"].tolist())
            yield pd.DataFrame({"doc_id": df["doc_id"], "held_out": df["held_out"], "lang_pred": names, "score": scores})

    found = rows.withColumn("held_out", held_out("doc_id")).mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("doc_id", key)
