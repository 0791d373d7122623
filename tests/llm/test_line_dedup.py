import random

from credence.llm import line_dedup

LINE = "this is line number {} with quite a few words in it so that it counts well"


def test_odd_rows(odd, none):
    rows = {(r.doc_id, r.clean_text): r for r in line_dedup.dedup_lines(odd).collect()}
    assert rows[2, None].n_lines == 0 and rows[3, ""].n_lines == 0 and rows[4, " \n\t "].n_lines == 0
    assert rows[6, ""].n_removed == 1 and rows[1, next(t for k, t in rows if k == 1)].n_removed in (0, 1)
    assert line_dedup.dedup_lines(none).count() == 0


def test_long_repeats_go_and_first_copies_stay(spark):
    rng = random.Random(1)
    passage = [LINE.format(f"p{i}") for i in range(6)]
    docs, planted = {}, {}
    for d in range(40):
        own = [LINE.format(f"{d}-{i}-{rng.random()}") for i in range(10)]
        at = rng.randrange(11)
        if d % 4 == 0:
            own[at:at] = passage
            planted[d] = at
        docs[d] = "\n".join(own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    first = min(planted)
    for d, text in docs.items():
        if d == first or d not in planted:
            assert out[d].n_removed == 0 and out[d].clean_text == text
        else:
            assert out[d].n_removed == 6 and not any(p in out[d].clean_text for p in passage)
            assert out[d].clean_text.count("\n") == 9


def test_every_deleted_line_has_an_earlier_copy(spark):
    rng = random.Random(2)
    pool = [LINE.format(i) for i in range(12)]
    docs = {d: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 15))) for d in range(30)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    seen = set()
    for d in sorted(docs):
        kept = [x for x in out[d].clean_text.split("\n") if x]
        assert len(kept) + out[d].n_removed == out[d].n_lines
        assert set(docs[d].split("\n")) <= seen | set(kept)  # no line is lost from the corpus
        seen |= set(kept)


def test_short_repeats_stay(spark):
    df = spark.createDataFrame([(1, "a short line\nfirst"), (2, "a short line\nsecond")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in line_dedup.dedup_lines(df).collect())


def test_other_copies_of_a_head_or_an_end(spark):
    """Brute force: every line of a run of 25 words or more that occurs before goes, whichever copy it continues."""
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    head, tail, middle = [line(40)], [line(40)], [line(9), line(8), line(7)]
    docs = {
        1: [*head, line(30)], 2: [line(30), *head, *middle, line(30)], 3: [line(30), *head, *middle, line(30)],
        4: [line(30), *tail], 5: [line(30), *middle, *tail, line(30)], 6: [line(30), line(9), *middle, *tail, line(3)],
    }
    pool = [line(k) for k in (3, 9, 12, 20, 26)]
    docs |= {d: [rng.choice(pool) for _ in range(rng.randrange(1, 12))] for d in range(7, 25)}
    places = [(d, i, j) for d, x in docs.items() for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(len(y.split()) for y in x[i:j]) >= 25]
    first = {}
    for d, i, j in places:
        first.setdefault(tuple(docs[d][i:j]), (d, i))
    gone = {(d, k) for d, i, j in places if first[tuple(docs[d][i:j])] != (d, i) for k in range(i, j)}
    assert {(3, 1), (3, 2), (3, 3), (3, 4), (6, 2), (6, 5)} <= gone
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for d, x in docs.items():
        kept = [y for k, y in enumerate(x) if (d, k) not in gone]
        assert out[d].n_removed == len(x) - len(kept) and out[d].clean_text.split("\n") == (kept or [""])


def test_lines_that_share_one_hash_are_not_taken_for_equal(spark):
    """Two documents whose lines agree in the first hash: only those that agree in the second too are repeats."""
    kind = "doc_id long, body binary, lines array<struct<hash:long,twin:long,n:int>>"
    lines = lambda twins: [(7 + i, t, 10) for i, t in enumerate(twins)]
    docs = spark.createDataFrame([(1, b"a", lines([1, 2, 3, 4])), (2, b"b", lines([1, 2, 3, 4])), (3, b"c", lines([9, 8, 7, 6]))], kind)
    assert {r.doc_id for r in line_dedup.repeated_runs(docs).collect()} == {2}
