import hashlib
import zlib

import duckdb
import pytest

from credence.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(nodes):
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            start = p // 16 * 16
            paths[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 16])))
            places[i] = p // 16
        nodes = [_hash("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def _brute(rows):
    """The manifest by the book, in plain Python."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = _tree([_leaf(r) for r in sources[s]])
    root, above = _tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for r, path in zip(sources[s], trees[s][1]):
            node = _leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path + up:
                node = _hash(left + node + right)
            out.append((r[0], _leaf(r), trees[s][0], root, _hash("".join(a + b for a, b in path + up)), node, node == root))
    return out


def _same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_odd_rows_hot_source_and_many_sources(spark):
    rows = [(i, "a" if i % 3 else None, "en", i, f"Text É {i}") for i in range(40)] + [(None, "b", None, None, None)] * 3 + [(7, "c", "x", 1, "T")] * 20
    rows += [(i, "big", None, 2, "Q") for i in range(5000)] + [(i, f"s{i % 300}", "q", 0, "") for i in range(300)] + [(-5, "", "-", -1, "1:-")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS hash", "'clash' AS grp", "1 AS idx", "2 AS n", "0 AS bad")
    _same(merkle.manifest_with_tampering(docs).collect(), _brute(rows))


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4097])
def test_sizes_at_the_edges_of_runs_and_blocks(spark, n):
    rows = [(i * 7 % n, "x", "en", i, f"Text {i}") for i in range(n)]
    _same(merkle.manifest_with_tampering(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), _brute(rows))


def test_fields_cannot_run_into_each_other(spark):
    rows = [(1, "s", "a", 1, "b:c"), (2, "s", "a1", None, "bc"), (3, "s", "-", None, None), (4, "s", None, None, "-")]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fields=("lang", "text")).collect()
    assert len({r.leaf for r in got}) == 4 and all(r.verified for r in got)


def test_a_changed_row_is_noticed_and_names_its_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(100)]
    before = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    rows[41] = (41, "s2", "en", 41, "text 41.")
    after = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    roots = [{r.leaf: r.subroot for r in x} for x in (before, after)]
    assert before[0].root != after[0].root and len(set(roots[0].values()) & set(roots[1].values())) == 2


def test_empty_table(spark):
    assert merkle.manifest_with_tampering(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees(spark):
    rows = [(i, f"s{i % 4}" if i % 5 else None, None if i % 7 == 0 else "En", i, None if i % 11 == 0 else f"Some Text {i}") for i in range(700)]
    con = duckdb.connect()
    con.register("frame", spark.createDataFrame(rows, SCHEMA).toArrow())
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    _same(con.sql(merkle.manifest_sql()).fetchall(), _brute(rows))
