import pytest

#: Columns whose names the operators use inside.
CLASH = "size bucket want rank label node sig n items shard slot link part text_crc32 body pos window gone lines html url k start ids copies target u p order mix$id mix$size media feature sha1 same holder hash count".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeats, and columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    prose = " ".join(words[i * 7 % 12] + str(i % 5) for i in range(60))
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [
        (1, prose, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", None, "b"), (5, long, "de", "b"), (6, prose, "en", "c"), (1, prose, "en", "a"), (None, prose + " x", "en", None),
        (7, prose + " extra", "en", "a"), (8, "one two", "fr", "a"), (9, "1234 !!", "fr", "b"), (10, "É́ 你好 <|endoftext|> x  y ", "fr", "c"), (None, None, None, None), (11, prose.upper(), "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *[f"'clash' as `{c}`" for c in CLASH])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
