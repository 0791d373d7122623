import corpus_pipeline as C
from credence.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:3]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    mixed = C.mix(spark, docs, sf).persist()
    assert mixed.columns == columns and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    shards = C.shard(spark, mixed, sf).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def test_odd_rows(spark, sf, odd, none):
    for name, stage in C.STAGES[:4]:
        assert stage(spark, none, sf).count() == 0, name
        assert stage(spark, odd, sf).columns == odd.columns, name
    assert C.shard(spark, none, sf).count() == 0 and C.shard(spark, odd, sf).count() == odd.count()
    kept = C.near_duplicates(spark, odd, sf).collect()
    prose = {r.doc_id for r in kept if r.doc_id in (1, 6, 7, 11) or r.doc_id is None and r.text}
    assert len(prose) == 1 and sorted(r.doc_id for r in kept if r.doc_id in (2, 3, 4, 5, 8, 9, 10)) == [2, 3, 4, 5, 8, 9, 10]
    assert len(kept) == 9 and sum(r.text is None for r in kept) == 2


def test_ids_lose_no_text(spark, sf):
    """Rows without an id, and rows that share one, are judged by their own texts."""
    item = table(spark, sf, "benchmark").first().text
    texts = {k: " ".join(f"{k}{i * i % 89}" for i in range(50)) for k in "abcd"}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"] + " more"), (None, texts["c"]), (None, texts["c"]), (2, texts["c"] + " more"), (3, item), (None, item), (3, texts["d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda df: sorted({k for k in texts for r in df.collect() if r.text.startswith(k)})
    once = C.near_duplicates(spark, docs, sf)
    assert once.count() == 5 and left(once) == list("abcd")
    clean = C.decontaminate(spark, docs, sf)
    assert clean.count() == 7 and left(clean) == list("abcd") and not any(r.text == item for r in clean.collect())


def test_separators_within_values_lose_no_text(spark, sf):
    """Rows whose columns, run together, would be spelled alike."""
    one, two = (" ".join(f"{k}{i * i % 89}" for i in range(50)) for k in "ab")
    rows = [(f"x\0={one}", two), ("x", f"{one}\0={two}"), (None, "-"), ("-", None), ("null", None), (None, None), ('a","b":"', "c"), ("a", '","b":"c')]
    docs = spark.createDataFrame(rows, "source string, text string")
    keyed, key = C._keyed(docs)
    assert keyed.select(key).distinct().count() == len(rows)
    assert C.near_duplicates(spark, docs, sf).count() == len(rows)
