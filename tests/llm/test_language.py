import collections
import math
import random
import zlib

from credence.llm import language
from credence.llm.common import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    rows = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, none):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == 14
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 9)} == {"und"}
    assert language.identify(none, model).count() == 0
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "abc def" if i in out else "xyz uvw", "secret" if i in out else "open") for i in range(200)], "doc_id long, text string, lang string")
    assert language.train(docs).languages == ["open"]


def naive_grams(text):
    """N-grams as strings, counted by hand."""
    chars = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in chars:
        chars = chars.replace("  ", " ")
    return [chars[i : i + n] for n in (1, 2, 3) for i in range(len(chars) - n + 1) if chars[i : i + n] != " "]


def test_scores_equal_naive_bayes_by_hand(spark):
    """Brute force: multinomial naive Bayes over dictionaries of strings gives the same languages and scores."""
    rng = random.Random(6)
    words = {"aa": ["the", "an", "and", "of", "there"], "bb": ["der", "und", "ein", "das", "ueber"], "cc": ["el", "una", "y", "del", "sobre"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(2, 9))) + "! 12", k) for i in range(90) for k in [rng.choice(list(words))]]
    rows += [(100, None, "aa"), (101, "ohne label", None)]
    grams = language.Grams(buckets=1 << 22)
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), grams=grams)
    seen = [(t, k) for i, t, k in rows if k and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {k: collections.Counter(g for t, x in seen if t and x == k for g in naive_grams(t)) for k in words}
    texts = ["the und una", "Der EIN el y of", "xyz", "an  12 an", None, "9 !"]
    names, scores = model.score(texts)
    for text, name, score in zip(texts, names, scores):
        own = naive_grams(text or "")
        if not own:
            assert (name, score) == ("und", 0.0)
            continue
        total = {}
        for k in words:
            size = sum(counts[k].values()) + 0.5 * grams.buckets
            total[k] = sum(math.log((counts[k][g] + 0.5) / size) for g in own) * min(200, len(own)) / len(own) + math.log(sum(x == k for _, x in seen) / len(seen))
        best = max(total, key=total.get)
        assert name == best and math.isclose(score, 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-9)
