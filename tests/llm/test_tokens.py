import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credence.llm import id_files, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_counts(odd, none):
    tok = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = token_counts.count_tokens(odd, BYTE)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert {r.over_limit for r in got.where("doc_id = 5").collect()} == {True}
    assert token_counts.count_tokens(none, BYTE).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n b", "a \nb", "a\n  b", "x<|endoftext|>y", "\n <|endoftext|> z", "it's 12's", " a b", "\t\ta", "  ", "a\r\nb", "a　b c", " x y", "a ́b"])
def test_corner_cases(text):
    c, tok = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE)), Tokenizer.from_file(BYTE)
    assert c.count([text]) == [len(tok.encode(text, add_special_tokens=False).ids)]
    e, word = id_files.RunEncoder(WORD, 2, "<u2"), Tokenizer.from_file(WORD)
    assert np.frombuffer(e.encode([text])[0], "<u2").tolist() == [*word.encode(text, add_special_tokens=False).ids, 2]


def test_a_full_memo_changes_nothing(monkeypatch):
    texts = [" ".join(f"word{i * j % 91}," for i in range(40)) for j in range(30)]
    tok = Tokenizer.from_file(BYTE)
    monkeypatch.setattr(token_counts, "MEMO", 20)
    monkeypatch.setattr(id_files, "MEMO", 20)
    c = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE))
    assert [c.count([t])[0] for t in texts] == [len(tok.encode(t).ids) for t in texts]
    e, word = id_files.RunEncoder(WORD, 2, "<u2"), Tokenizer.from_file(WORD)
    assert [np.frombuffer(e.encode([t])[0], "<u2").tolist()[:-1] for t in texts] == [word.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(odd, none, spark):
    tok = Tokenizer.from_file(WORD)
    known = odd.where("doc_id is not null")
    rows = id_files.id_files(known, WORD).collect()
    ids = sorted((r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in known.collect())
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in ids]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, len(x), crc(x)) for d, x in ids)
    assert [r.doc_id for r in sorted(id_files.id_files(odd, WORD).collect(), key=lambda r: r.start)][:2] == [None, None]
    assert id_files.id_files(none, WORD).count() == 0


def test_keyed_access_and_rolling(tmp_path, spark, monkeypatch):
    docs = spark.range(200).selectExpr("id * 7 as doc_id", "concat('text number ', id) as text")
    manifest = id_files.write_id_files(docs, WORD, f"file://{tmp_path}/ids", files=2).collect()
    tok = Tokenizer.from_file(WORD)
    found = 0
    for m in manifest:
        reader = id_files.FileReader(m.file)
        for k in range(200):
            got = reader.get(k * 7)
            if got is not None:
                found += 1
                assert got.tolist() == [*tok.encode(f"text number {k}", add_special_tokens=False).ids, 2]
            assert reader.get(k * 7 + 3) is None
        reader.close()
    assert found == 200


def test_perfect_index():
    keys = np.random.default_rng(0).choice(1 << 40, 20_000, replace=False).astype(np.uint64)
    index = id_files.PerfectIndex.build(keys, np.arange(len(keys)))
    assert sorted(index.slots(keys)) == list(range(len(keys)))  # minimal and perfect
    assert (index.find(keys) == np.arange(len(keys))).all()
    others = keys + np.uint64(1 << 50)
    assert (index.find(others) >= 0).mean() < 0.001
    with pytest.raises(ValueError):
        id_files.PerfectIndex.build(np.zeros(2, np.uint64), np.arange(2))


def test_mixed_white_space():
    rng = np.random.default_rng(5)
    parts = [" ", " ", " ", "\t", "\n", "\r\n", " ", "　", "\x1f", "\x85", "a", "b,", "12", "'s"]
    nbsp = "  "
    texts = [*(f"a{nbsp * n} b" for n in (1, 2, 4, 8, 9)), "a\n \n b", "a\t \t b", "a \t b  c", *("".join(rng.choice(parts, 12)) for _ in range(2000))]
    c, tok = token_counts.Counter(BYTE, token_counts.whole_tokens(BYTE)), Tokenizer.from_file(BYTE)
    assert c.count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_many_small_documents_begin_new_files(spark, tmp_path, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "case when id % 3 = 0 then '' else concat('word ', id) end as text")
    whole = sorted(map(tuple, id_files.id_files(docs, WORD).collect()))
    monkeypatch.setattr(id_files, "FILE_DOCS", 3)
    manifest = id_files.write_id_files(docs, WORD, f"file://{tmp_path}/ids", files=2)
    assert max(r.n_docs for r in manifest.collect()) == 3 and manifest.count() >= 14
    assert sorted(map(tuple, id_files.read_id_files(manifest).collect())) == whole
