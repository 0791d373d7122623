import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credence.llm import id_files

WORD = public_tokenizers.path("word_bpe_49k.json")
SAFE = [chr(c) for c in range(0x3000) if id_files.SAFE(chr(c))]


class Counted:
    """The library's tokenizer or its model, with a count of calls."""

    def __init__(self, of):
        self.of, self.calls = of, 0

    def __getattr__(self, name):
        def call(*args, **kwargs):
            self.calls += 1
            return getattr(self.of, name)(*args, **kwargs)

        return call


def agree(texts):
    got = id_files.RunEncoder(WORD, 2, "<u2").encode(texts)
    want = Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)
    return [t for t, ids, e in zip(texts, got, want, strict=True) if np.frombuffer(ids, "<u2").tolist() != [*e.ids, 2]]


def test_a_word_is_encoded_once():
    memo = id_files.Runs(WORD, "<u2")
    memo.tok, memo.model = Counted(memo.tok), Counted(memo.model)
    for run in "Ställe ställe, STÄLLE. (ställe) ställe!".split():
        memo[run]
    assert memo.tok.calls == 0 and memo.model.calls == 6  # the word and five marks


def test_every_pair_of_safe_characters():
    assert len(SAFE) > 290 and "İ" not in SAFE and " " not in SAFE
    assert agree([a + b for a in SAFE for b in SAFE]) == []


@pytest.mark.parametrize("letters", [SAFE, list("'strevmlldSTREVM!a1é’'"), [*"aé'İſKß<|>", "́", "ﬁ", "你", "Σ", "ς", "\t", "\r", "\x85", "\x1f", "　", " ", "\n", "½", "<|endoftext|>"]])
def test_runs_of_all_kinds(letters):
    rng = np.random.default_rng(7)
    assert agree(["".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(20_000)]) == []


def test_special_strings():
    assert agree(["<|endoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "<|startoftext|>,", "<|endoftext|", "a <|endoftext|> b"]) == []


def test_other_settings_are_left_to_the_library(monkeypatch):
    monkeypatch.setitem(id_files.KNOWN, "normalizer", None)
    memo = id_files.Runs(WORD, "<u2")
    memo.model = Counted(memo.model)
    assert memo.cut is None and memo["Word,"] == id_files.Runs.__missing__(memo, "Word,") and memo.model.calls == 0
