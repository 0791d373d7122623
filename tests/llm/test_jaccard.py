import collections
import itertools
import random
import re

import numpy as np
import pytest

from credence.llm import jaccard
from credence.llm.words import Words, shingles


def sets_of(texts, size=4):
    out = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size=4, num=85, den=100):
    s = sets_of(texts, size)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = collections.defaultdict(list)
    for d, items in s.items():
        for i in items:
            having[i].append(d)
    both = collections.Counter(p for ds in having.values() for p in itertools.combinations(sorted(ds), 2))
    for (a, b), n in both.items():
        if den * n >= num * (len(s[a]) + len(s[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s[d]), find(d)) for d in s}


def corpus(seed, n=120):
    rng = random.Random(seed)
    texts = {}
    for d in range(n):
        if d and rng.random() < 0.6:  # a near copy of another, some just over and some just under the line
            w = texts[rng.randrange(d)].split(" ")
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts[d] = " ".join(w)
        else:
            texts[d] = " ".join(f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 4, 9, 20, 60, 200, 700])))
    return texts


@pytest.mark.parametrize("size, num, den, seed", [(4, 85, 100, 1), (5, 80, 100, 2), (2, 9, 10, 3)])
def test_equals_brute_force(spark, size, num, den, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_components(df, size, num, den).collect()}
    assert got == brute(texts, size, num, den)


def test_large_group_near_the_line(spark, monkeypatch):
    """Near copies of one text, most of them too far from each other; compared in small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "WEIGHT", 1500)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for d in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.ngram_components(df).collect()}
    assert got == brute(texts)


def test_odd_rows(odd, none):
    rows = jaccard.ngram_components(odd).collect()
    assert len(rows) == 14
    comp = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert comp[1] == comp[6] == comp[7] == comp[11] == 1 and all(comp[d] == d for d in (2, 3, 4, 5, 8, 9, 10))
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0} and {r.n_shingles for r in rows if r.doc_id in (8, 9)} == {1}
    assert jaccard.ngram_components(none).count() == 0


@pytest.mark.parametrize("num", [85, 80, 90])
def test_pigeonhole(num):
    """Similar sets share a signature, for sizes in and across bands."""
    rng = np.random.default_rng(0)
    scheme = jaccard.Scheme(num)
    for n in [6, 7, 8, 9, 10, 12, 13, 14, 17, 20, 25, 33, 40, 57, 80, 120, 300, 900, 2500]:
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            most = scheme.differences(n)
            for gone in {0, most // 2, most}:
                added = most - gone
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, added).astype(np.uint64)])
                both, union = n - gone, n + added
                if (gone or added) and 100 * both >= num * union:  # equal sets are one
                    assert len(np.intersect1d(jaccard.signatures(np.sort(a), scheme), jaccard.signatures(np.sort(b), scheme))), (n, gone, added)


def test_long_texts_hash_as_in_one_piece():
    text = " ".join(f"W{i % 977}" for i in range(5000)) + "  tail\n"
    whole, pieces = (dict(Words().of([text], p))[0] for p in (1 << 20, 700))
    assert (whole == pieces).all() and len(shingles(whole)) == len({tuple(text.lower().split()[i : i + 4]) for i in range(4998)})
