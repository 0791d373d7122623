"""Winnowing over line hashes, with DataFrame operations only.

A window is the shortest run of lines from a place on, or up to a place, that holds ``words`` words.
Its fingerprint is its least line hash, at the place where that first stands.  Equal windows have equal
fingerprints, so only windows whose fingerprint stands at several places can repeat.  Those are extended
both ways to their whole run of lines and matched with the first place in the corpus where the same lines
stand; a window goes if that is another place.  Every repeated run of at least ``words`` words goes
whole, whatever its earlier copies are followed by: each of its lines lies in a window within the run,
as one that starts at the run's first line or one that ends at the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, keep

#: What is to be deleted is broadcast up to so many documents and places of lines, else joined.
MOST_ROWS, MOST_PLACES = 200_000, 2_000_000
#: Words of a window.
WORDS = 25


def _lines(text: Column) -> Column:
    """The lines of a text that hold more than white space, in order."""
    return F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))


def twin(line: Column) -> Column:
    """A second hash of a line: what comes first changes the state that its bytes meet, so both are 128 bits together."""
    return F.xxhash64(F.lit("twin"), line)


def hashed_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, body, lines) of each different document of ``rows`` (doc_id, body, text): two hashes and words of its lines, in order."""
    lines = F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("hash"), twin(x).alias("twin"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n")))
    return rows.where("text is not null").select("doc_id", "body", lines.alias("lines")).dropDuplicates(["doc_id", "body"])


def windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, body, first, last, window, least, at) of each different window of ``docs`` (doc_id, body, lines), with
    its fingerprint ``least`` and the place of that; places count from 0."""
    lines = docs.select("doc_id", "body", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("doc_id", "body", "pos", F.struct("line.hash", "line.twin").alias("hash"), F.col("line.n").cast("long").alias("n"))
    doc = Window.partitionBy("doc_id", "body")
    lines = lines.withColumn("upto", F.sum("n").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("before", F.col("upto") - F.col("n")).withColumn("total", F.sum("n").over(doc))
    # every line holds a word, so these are the lines of the shortest run with that many words
    lines = lines.withColumn("on", F.collect_list("hash").over(doc.orderBy("before").rangeBetween(0, words - 1)))
    lines = lines.withColumn("back", F.collect_list("hash").over(doc.orderBy("upto").rangeBetween(1 - words, 0)))

    def place(run: str, first: Column) -> Column:
        hashes, same = F.col(run)["hash"], F.struct(F.xxhash64(F.col(run)["hash"]).alias("one"), F.xxhash64(F.col(run)["twin"]).alias("two"))
        least = F.array_min(hashes)
        at = (first + F.array_position(hashes, least) - 1).cast("int").alias("at")
        return F.struct(first.cast("int").alias("first"), (first + F.size(run) - 1).cast("int").alias("last"), same.alias("window"), least.alias("least"), at)

    on = F.when(F.col("total") - F.col("before") >= words, place("on", F.col("pos")))
    back = F.when(F.col("upto") >= words, place("back", F.col("pos") - F.size("back") + 1))
    found = lines.select("doc_id", "body", F.explode(F.array_compact(F.array_distinct(F.array(on, back)))).alias("x"))
    return found.select("doc_id", "body", "x.*")


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, body, first, last) of the runs of lines of ``docs`` (doc_id, body, lines) that occur before."""
    all_windows = keep(windows(docs, words), "windows")
    place = F.struct("doc_id", "body", "at")
    shared = all_windows.groupBy("least").agg(F.min(place).alias("one"), F.max(place).alias("other")).where(~F.col("one").eqNullSafe(F.col("other")))
    likely = keep(all_windows.join(shared.select("least"), "least", "left_semi").select("doc_id", "body", "first", "last", "window"), "likely")
    origin = likely.groupBy("window").agg(F.min(F.struct("doc_id", "body", "first")).alias("o"), F.max(F.struct("doc_id", "body", "first")).alias("end"))
    origin = keep(origin.where(~F.col("o").eqNullSafe(F.col("end"))).select("window", F.col("o.doc_id").alias("at_doc"), F.col("o.body").alias("at_body"), F.col("o.first").alias("at")), "origins")
    same_place = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("body") == F.col("at_body")) & (F.col("first") == F.col("at"))
    return likely.join(origin, "window").where(~same_place).select("doc_id", "body", "first", "last")


def dedup_lines(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_removed and clean_text of every row.

    Lines are compared by 128 bits of hashes, as whole texts are: of 10^12 different runs two would be taken
    for one with a chance of about 10^-15.  Lines of white space alone don't count as lines, and stay out of
    clean_text where something was removed.  The first copy in the order of (key, text hash, place)
    stays, so every line that goes has an equal one before it.  Null texts have no lines and stay
    null; empty texts stay empty; texts without a repeat stay as they are.  Rows with the same key
    and text are one document: each has the same result.  An empty table gives an empty result;
    columns other than ``key`` and ``text`` are not read.
    """
    rows = columns(docs, key, text).toDF("doc_id", "text").withColumn("body", F.unhex(F.md5(F.col("text").cast("binary"))))
    once = keep(hashed_lines(rows), "lines")
    runs = keep(repeated_runs(once, words), "runs")
    gone = runs.select("doc_id", "body", F.explode(F.sequence("first", "last")).alias("pos")).groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone"))
    gone = keep(gone, "gone").select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "gone")
    size = gone.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("places")).first()
    if size["rows"] <= MOST_ROWS and size["places"] <= MOST_PLACES:
        gone = F.broadcast(gone)  # then no text is shuffled
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left")
    lines = _lines(F.col("text"))
    size = F.coalesce(F.size(lines), F.lit(0))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), size - 1), F.col("gone")))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return out.select(F.col("doc_id").alias(key), F.when(F.col("text").isNull(), 0).otherwise(size).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), clean.alias("clean_text"))
