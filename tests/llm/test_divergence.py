import re
from collections import Counter

import duckdb
import pytest

from credence.llm import divergence

SCHEMA = "doc_id long, source string, lang string, text string"


def _brute(rows, least=10, listed=10):
    """The audit by the book: every pair of groups over every kept term."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    used, docs = {}, {}
    for _, source, lang, text in rows:
        lang, source = lang or "", source or ""
        words = pattern.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        used.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, seen in docs.items():
        kept = [t for t, k in seen.items() if k >= least]
        groups = {s: c for (g, s), c in used.items() if g == lang}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def _rows():
    words = "alpha Beta gamma délta été 你好 x y z omega".split()
    rows = [(i, f"s{i % 4}", "en", " ".join(words[(i * k) % 10] for k in range(1, 9)) + f" once{i}") for i in range(60)]
    rows += [(i, f"s{i % 3}", None, f"same same same w{i % 2}") for i in range(45)] + [(1, None, "en", "Alpha")] * 30
    rows += [(2, "mute", "en", None), (3, "empty", "en", ""), (4, "signs", "en", "123 -- 45"), (5, "s0", "xx", "few words"), (6, "s1", "xx", None), (7, "s1", None, "a" * 50), (None, None, None, None)]
    return rows + [(8, "long", "en", "beta,Alpha " * 200_000)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'clash' AS {c}" for c in ("term", "n", "p", "z", "item", "value", "rank", "words")]).repartition(7)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == _brute(rows)


@pytest.mark.parametrize("held", [1, 3])
def test_how_much_a_task_holds_plays_no_part(spark, rows, monkeypatch, held):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", held)
    batch = pa.RecordBatch.from_pylist([{"lang": r[2] or "", "source": r[1] or "", "text": r[3] or ""} for r in rows[:150]])
    got = Counter()
    for part in divergence._counted(iter([batch])):
        for r in part.to_pylist():
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert got["en", "s0", "beta", "docs"] <= got["en", "s0", "beta", "n"] and got["", "s0", "same", "n"] == 45 and got["", "s0", "same", "docs"] == 15


def test_words_of_a_long_text_are_not_cut():
    text = "Été one2three " * 1000
    assert [w for part in divergence._words(text, piece=64) for w in part] == ["Été".encode(), b"one", b"three"] * 1000


def test_join_instead_of_broadcast_and_sql(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()))
    con = duckdb.connect()
    con.register("frame", spark.createDataFrame(rows, SCHEMA).toArrow())
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    assert got == sorted(con.sql(divergence.SQL).fetchall())


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
