import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from credence.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a  b", "don't  stop\n\n\tx", "    x", "日本語のテキスト 12³ Ⅷ", "ࡰࡱ x㄄ 0\U00031350z", "a" * 1000, "ab" * 300 + " c", " " * 500 + "x", "\n" * 400,
    "<|endoftext|> hi", "\0\x01 z", "\U0001f600" * 100, "\U0001e4f0\U0001e4f1   x", "word " * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    signs = list("abcde fgh  '\n\t.,;123éßñ你好 'sre") + ["ࡰ", "\U0001e4f0", "\U0001f600"]
    return ODD + ["".join(rnd.choice(signs) for _ in range(rnd.choice([3, 30, 300]))) for _ in range(600)]


@pytest.mark.parametrize("known", [0, 40, 60_000])
def test_ids_are_the_library_s(spark, library, texts, monkeypatch, known):
    monkeypatch.setattr(byte_bpe, "KNOWN", known)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS words", "'x' AS ids", "'x' AS key", "'x' AS packed")
    got = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.packed == struct.pack(f"<{len(ids)}I", *ids)


def test_folds_and_merges_agree_with_the_library(spark, library):
    rnd, ranks = random.Random(2), byte_bpe.read_ranks(PATH)
    words = ["".join(rnd.choice("abcdeéß你thnio") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 20] * 12] + ["a" * 40]
    table = byte_bpe._table({p.decode(byte_bpe.LATIN): r for p, r in ranks.items()}, "int")
    rows = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    for r in rows.select("i", byte_bpe._let(table, lambda t: byte_bpe.folded(byte_bpe.spelled(F.col("word")), t)).alias("ids")).collect():
        raw = words[r.i].encode()
        assert r.ids == library._encode_single_piece(raw) == byte_bpe.merged(raw, ranks)
    for n in (99, 101, 700):  # at either side of the heap's bound
        raw = "".join(rnd.choice("abcdeéß你") for _ in range(n)).encode()
        assert byte_bpe.merged(raw, ranks) == byte_bpe._by_heap(raw, ranks) == library._encode_single_piece(raw)


def test_round_trip_digests(spark, library, texts):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no key"), (0, "again"), (0, "again")], "doc_id long, text string")
    of = {**dict(enumerate(texts)), None: "no key"}
    got = byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r.doc_id == 0:
            continue
        ids = library.encode_ordinary(of[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((of[r.doc_id] or "").encode()).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect() == []
