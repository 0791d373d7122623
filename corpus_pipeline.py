"""A corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  Results are
written as Parquet in the shared folder and read again between stages.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontamination, jaccard, language, mixing, sharding
from credence.llm.common import keep, table

#: Not expressible in SQL: trained scores, components of a similarity join and label propagation.
ORACLE_SQL = None

#: Parameters of the stages.
SHARDS = 16
LEAST_SCORE = 0.5


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key as last column, and its name: rows share a key where all their columns are equal."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    # JSON quotes what a value holds, so that no two rows are spelled alike; a null has a spelling of its own
    row = F.to_json(F.struct(*[docs[c] for c in docs.columns]), {"ignoreNullFields": "false"})
    return docs.select("*", F.md5(row.cast("binary")).alias(name)), name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what goes has no letter or no clear language.

    Null and empty texts go.  Equal texts are treated alike, repeated rows stay; equal scores go to the
    language that comes first.  An empty table, or one without labelled rows, gives an empty result."""
    model = spark.sparkContext.broadcast(language.train(docs))

    @F.pandas_udf("boolean")
    def recognised(text: pd.Series) -> pd.Series:
        names, scores = model.value.score(text.tolist())
        return pd.Series([n != language.UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, scores)])

    return docs.where(recognised(docs["text"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the least hash of its columns.

    Ids play no part: a null or repeated id loses no text.  Of rows equal in all columns one stays.
    Texts without words are no duplicates of each other.  An empty table gives an empty result."""
    rows, key = _keyed(docs)
    found = jaccard.ngram_components(rows, size=5, num=80, den=100, key=key)
    others = keep(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "duplicates")
    return rows.join(others, key, "left_anti").dropDuplicates([key]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch of a benchmark item.

    Each row is judged by its own text, whatever its id; null and empty texts stay.  Repeated rows stay
    or go together.  An empty table gives an empty result, an empty benchmark all rows."""
    rows, key = _keyed(docs)
    leaks = decontamination.find_overlaps(rows, table(spark, sf_dir, "benchmark"), key=key)
    leaks = keep(leaks.select(key).distinct(), "leaks")
    return rows.join(leaks, key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; longer documents are likelier to be taken once more.

    Null texts and texts without words are not taken.  A null source is one of its own.  Ties are
    resolved as in the operator.  An empty table gives an empty result."""
    return mixing.mix_sources(docs, carry=True)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix, repeats counted; null texts and ids have a place too.

    Equal texts go together as far as the quotas allow.  An empty table gives an empty result."""
    return sharding.shard_documents(docs, n_shards=SHARDS)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is defined for odd rows in its own words."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
