"""How far the sources of a language are apart in their words, by an inverted index of corrections.

Each group (language, source) gives each kept term a share p of parts in 10^9, smoothed, so that a term
it never uses has its least share z.  Two groups differ by the sum of f(p, q) over all kept terms.  That
sum starts at V f(z, z'), as if neither group used any term, and postings bring what is missing:

* a term that group a uses adds f(p, z') - f(z, z'); p depends on the number of uses alone, so terms of
  equal counts are one row of a histogram before they meet the other groups;
* a term that both use adds f(p, q) - f(p, z') - f(z, q) + f(z, z'), from the postings of that term.

No term is listed for a pair in which neither group uses it.  All arithmetic is in whole numbers.

The pairs of a language are all wanted in the result, so its rows, and a term's corrections, grow with
the square of the sources that use it; corrections are summed within the task that makes them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep

#: Documents of a language that a term has to stand in.
LEAST_DOCS = 10
#: Parts that shares are counted in.
PARTS = 1_000_000_000
#: Ranks of terms that are listed.
LISTED = 10
#: Groups up to which their table is broadcast (two names and four numbers each).
MOST_BROADCAST = 20_000
#: Different terms that a task holds before it hands them on.
HELD = 300_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(PARTS (count + 2) / (total + 2 terms))``, exact for any counts below 10^18."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return (F.call_function("div", above, (total + 2 * terms).cast("decimal(19,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)² / (p + q))``; shares are at most 10^9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


#: Every byte of UTF-8 as the terms have it: A to Z in lower case, a space for what parts terms.
SPELLED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _words(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in lists; a long text is cut between terms."""
    raw, at = text.encode().translate(SPELLED), 0
    while at < len(raw):
        end = raw.find(b" ", at + piece) if at + piece < len(raw) else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task has read, ``HELD`` terms at a time."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            names = [pa.array([name] * len(n), pa.string()) for name in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    kept = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            mine: Counter = Counter()
            for words in _words(text):
                mine.update(words)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(mine)
            docs.update(mine.keys())
            kept += len(n) - before
            if kept > HELD:
                yield from flush()
                kept = 0
    yield from flush()


def term_counts(docs: DataFrame, group: str = "source", lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, docs) of every term and group, and (lang, source) of all groups.

    A document's uses are counted where it is read, with its terms once each in ``docs``; a task adds up what
    it has read before anything is shuffled."""
    rows = columns(docs, lang, group, text).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (group, "source"), (text, "text"))])
    partial = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), rows.select("lang", "source").distinct()


def _by_term(counts: DataFrame, least: int) -> DataFrame:
    """The kept postings (lang, source, term, n) with the language's count and ``lead``, 1 on one posting of each term."""
    same = Window.partitionBy("lang", "term")
    seen = counts.withColumn("n_docs", F.sum("docs").over(same)).withColumn("n_lang", F.sum("n").over(same)).withColumn("least", F.min("source").over(same))
    return seen.where(F.col("n_docs") >= least).select("lang", "source", "term", "n", "n_lang", (F.col("source") == F.col("least")).cast("int").alias("lead"))


def audit(docs: DataFrame, group: str = "source", lang: str = "lang", text: str = "text", least: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """Distances between the groups of each language, and the terms that set a group apart from its language.

    Returns lang, source, part, item, value and rank.  ``pair`` rows name every other group of the language,
    ``term`` rows the ``listed`` terms of the largest gaps among those used more than the language does.

    Null text, language and group are the empty string.  Texts without terms, and empty ones, still make their
    group: with no kept term in the language its distances are 0.  Long texts are read whole.  Repeated rows
    count again.  Ties go to the item that comes first by its bytes.  Other columns play no part, and an empty
    table gives an empty result.
    """
    counts, groups = term_counts(docs, group, lang, text)
    postings = keep(_by_term(counts, least), "postings")

    spread = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = postings.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("n").alias("n_all"))
    zero = F.lit(0).cast("long")
    table = groups.join(spread, ["lang", "source"], "left").join(langs, "lang", "left")
    table = table.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "n_all")])
    # least share of a group; without terms there is nothing to share
    table = keep(table.withColumn("z", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms")))), "groups")
    n_groups = table.count()

    posted = postings.join(_small(table, n_groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    posted = keep(posted.select("lang", "source", "term", "n", "p", "z", share(F.col("n_lang"), F.col("n_all"), F.col("terms")).alias("q")), "shares")

    one = posted.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    two = posted.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    pair, za, zb = ["lang", "a", "b"], F.col("za"), F.col("zb")
    both = one.join(two, ["lang", "term"]).where("a < b")
    both = both.select(*pair, (gap(F.col("pa"), F.col("pb")) - gap(F.col("pa"), zb) - gap(za, F.col("pb")) + gap(za, zb)).alias("v"))
    both = both.groupBy(*pair).agg(F.sum("v").alias("v"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))

    hist = posted.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za")).agg(F.count("*").alias("k"))
    others = table.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    alone = hist.join(_small(others, n_groups), "lang").where("a <> b").select(*pair, (F.col("k") * (gap(F.col("pa"), zb) - gap(za, zb))).alias("v"))
    alone = alone.groupBy(*pair).agg(F.sum("v").alias("v"))
    alone = alone.unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v"))

    mine = table.select("lang", F.col("source").alias("a"), "terms", F.col("z").alias("za"))
    base = mine.join(_small(others, n_groups), "lang").where("a <> b").select(*pair, F.coalesce(F.col("terms") * gap(za, zb), zero).alias("v"))
    pairs = base.unionByName(alone).unionByName(both).groupBy(*pair).agg(F.sum("v").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    terms = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed), pairs.withColumn("rank", F.row_number().over(order))]
    return ranked[1].unionByName(ranked[0])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p,
    1 + (1000000000 * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)
), p AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pr AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), tm AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM tm QUALIFY rank <= 10
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r
"""
