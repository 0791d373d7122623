import hashlib

import pytest

from compare import duck, same
from credence.llm import queries, warc


def test_equals_sql(spark, sf):
    same(queries.op8_warc(spark, sf).toPandas(), duck(sf, queries.OP8_SQL))


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "x<p>" * 400, "é\r\n\r\nWARC/1.1 \x1f" * 200
    rows = [(1, "u1", big), (5, None, big), (3, "u3\r\nX: y", big), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", big), (None, None, "lone" * 300), (5, "again", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha1", "2 as same", "3 as holder", "4 as refers_to")


def test_odd_rows(pages):
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.record_type, r.refers_to) for r in by[5]] == [("response", None)] * 2
    assert (by[1][0].record_type, by[1][0].refers_to) == ("revisit", 5) and by[3][0].refers_to == 5
    assert by[2][0].record_type == by[4][0].record_type == "response"
    assert by[6][0].payload_digest == hashlib.sha1(b"").hexdigest() and by[6][0].payload_bytes == 0
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 5)]
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("split", [100, 1000, 1 << 20])
def test_splits_find_each_record_once(spark, tmp_path, split):
    pages = spark.range(60).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('page ', id, ' '), cast(1 + id * 7 as int)) as html").coalesce(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    rows = warc.read_archives(archives, split, with_payload=True).collect()
    want = {r.page_id: r for r in pages.collect()}
    assert sorted(r.page_id for r in rows) == sorted(want)
    assert all(r.payload.decode() == want[r.page_id].html and r.url == want[r.page_id].url for r in rows)


def test_false_magic_is_no_record(tmp_path):
    path = tmp_path / "f"
    good = warc.record(7, "u", b"payload", hashlib.sha1(b"payload").digest(), None)
    path.write_bytes(warc.MAGIC + b"junk" * 10 + good)
    with open(path, "rb") as f:
        class Handle:
            def read_at(self, n, at):
                f.seek(at)
                return f.read(n)

        src = warc._Source(Handle(), path.stat().st_size)
        at = warc.first_record(src, 0, src.size)
        assert at == 43
        one, end = warc.read_record(src, at, True)
        assert one["payload"] == b"payload" and end == src.size
