import random

import pytest

from credence.llm import decontamination


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(0)
    items = [(i, " ".join(f"t{rng.randrange(2000)}" for _ in range(n))) for i, n in enumerate([15, 30, 60, 6, 12])]
    return spark.createDataFrame([*items, (9, None), (10, ""), (11, "...")], "item_id long, text string").selectExpr("*", "1 as words", "2 as bytes", "3 as doc_id")


def plant(words, k, rng):
    """``k`` substitutions, at most two in any twelve words."""
    w = list(words)
    for at in range(3, len(w), 6) if k else ():
        w[at] = "zzz"
    return w


def test_finds_planted_passages_and_leaves_others(spark, bench):
    rng = random.Random(1)
    items = {r.item_id: r.text for r in bench.collect() if r.text and r.text[0] == "t"}
    rows, want = [], set()
    for d in range(60):
        own = [f"t{rng.randrange(2000)}" for _ in range(rng.randrange(5, 200))]
        if d % 3 == 0:
            item = d // 3 % 5
            passage = plant(items[item].split(), 0 if item == 3 else d % 2 * 2, rng)
            at = rng.randrange(len(own))
            own[at:at] = passage
            want.add((d, item))
        text = " ".join(own)
        rows.append((d, text.upper() if d % 4 == 0 else text.replace(" ", ", ")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.find_overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_equal >= 0.8 * r.n_words for r in got)


def test_blocks_of_the_benchmark_change_nothing(spark, bench, monkeypatch):
    items = {r.item_id: r.text for r in bench.collect() if r.text}
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items.items()], "doc_id long, text string")
    one = sorted(map(tuple, decontamination.find_overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, decontamination.find_overlaps(docs, bench).collect())) == one and {r[0] for r in one} == {0, 1, 2, 3, 4}


def test_odd_rows(odd, none, bench, spark):
    assert decontamination.find_overlaps(odd, bench).count() == 0
    assert decontamination.find_overlaps(none, bench).count() == 0 and decontamination.find_overlaps(odd, bench.where("false")).count() == 0
    own = spark.createDataFrame([(1, next(r.text for r in odd.where("doc_id = 1").collect()))], "item_id long, text string")
    got = decontamination.find_overlaps(odd, own).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 6, 7, 11]


def test_against_every_diagonal(spark):
    """Brute force: what is found counts on some diagonal, and nothing with two substitutions in 12 words is missed."""
    rng = random.Random(4)
    items = {k: [f"w{rng.randrange(400)}" for _ in range(rng.randrange(9, 40))] for k in range(8)}
    docs = {}
    for d in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        if d % 3:
            own = items[rng.randrange(8)]
            a = rng.randrange(0, max(1, len(own) - 12))
            part = [f"x{rng.randrange(99)}" if rng.random() < 0.05 * (d % 6) else w for w in own[a : a + rng.randrange(8, 30)]]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs[d] = words
    seeds = decontamination.Seeds.of(list(items), [" ".join(w) for w in items.values()])
    cut = dict(decontamination.Words(decontamination.NOT_WORD).of([" ".join(docs[d]) for d in sorted(docs)]))
    counts, sure = set(), set()
    for d, own in docs.items():
        for i, item in items.items():
            for diagonal in range(-len(item), len(own)):
                if seeds.overlap(cut[d], i, diagonal):
                    counts.add((d, i))
                same = [own[k + diagonal] == w for k, w in enumerate(item) if 0 <= k + diagonal < len(own)]
                if any(sum(same[k : k + 12]) >= 10 for k in range(len(same) - 11)) or len(item) < 12 and len(same) == len(item) and all(same):
                    sure.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_overlaps(df, bench).collect()}
    assert len(sure) > 15 and sure <= got <= counts
