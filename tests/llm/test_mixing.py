import collections
import re

import pytest

from compare import duck, same
from credence.llm import mixing, queries


def fill(sizes, weights, most):
    """Targets by resharing until none is above its limit."""
    total, cut = sum(sizes), {}
    while True:
        left, open_ = total - sum(cut.values()), [i for i in range(len(sizes)) if i not in cut]
        share = {i: left * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            return [cut.get(i, share.get(i)) for i in range(len(sizes))]
        cut |= {i: most * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[10, 1000, 1000, 50], [1, 1, 5000], [7], [100, 100, 100, 100, 3000, 1, 9]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_odd_rows(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 14
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(r.text) for r in odd.collect())
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(none).count() == 0
    carried = mixing.mix_sources(odd, carry=True)
    assert carried.columns == odd.columns and carried.count() == sum(r.copies for r in rows)


def test_near_targets_and_reruns(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('s', case when id % 3 = 0 then 0 else id % 10 end) as source", "repeat('w ', cast(1 + id % 50 as int)) as text")
    a, b = mixing.mix_sources(docs).collect(), mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    taken, target = collections.Counter(), {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in a:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 26 for s, t in target.items())


def test_unequal_odds(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('s', id % 2) as source", "'a b c' as text", "case when id % 4 < 2 then 1.0 else 3.0 end as odds")
    rows = mixing.mix_sources(docs, weights=(1, 3), weight="odds").collect()
    got = collections.defaultdict(list)
    for r in rows:
        if r.doc_id % 2 == 0:  # a quarter of the words from half of them
            got[r.doc_id % 4 < 2].append(r.copies)
    rate = {k: sum(v) / len(v) for k, v in got.items()}
    assert 2.2 < rate[False] / rate[True] < 3.8


def test_certain_units_and_shares(spark):
    """Odds that would be above 1 are certain ones; the others share what is left in proportion."""
    rows = [(10, 1.0), (40, 2.0), (30, 8.0), (20, 64.0)]
    levels = spark.createDataFrame([("a", o, w) for w, o in rows] + [(None, 1.0, 5)], "`mix$source` string, `mix$odds` double, words long")
    owed = spark.createDataFrame([("a", 66.0), (None, 0.0)], "`mix$at` string, `mix$owed` double")
    got = {r[0]: r[1] for r in mixing._factors(levels, owed).collect()}
    assert got[None] == 0 and got["a"] == pytest.approx((66 - 20 - 30) / (10 * 1 + 40 * 2)) and got["a"] * 2 <= 1
    assert sum(w * min(1, got["a"] * o) for w, o in rows) == pytest.approx(66)


def test_longer_documents_are_likelier(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 2) as source", "repeat('w ', case when id % 4 < 2 then 3 else 100 end) as text")
    got = collections.defaultdict(list)
    for r in mixing.mix_sources(docs, weights=(1, 3)).collect():
        if r.doc_id % 2 == 0:
            got[r["size"]].append(r.copies)
    rate = {k: sum(v) / len(v) for k, v in got.items()}
    assert 2.8 < rate[100] / rate[3] < 4.3  # seven binary digits against two


def test_rows_without_id_are_drawn_apart(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('s', id % 2) as source", "concat('w ', id) as text")
    taken = mixing.mix_sources(docs, weights=(1, 3)).where("copies = 0").count()
    assert 600 < taken < 900


def test_equals_sql(spark, sf):
    same(queries.op4_mixing(spark, sf).toPandas(), duck(sf, queries.OP4_SQL))
