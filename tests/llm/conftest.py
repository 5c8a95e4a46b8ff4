import pytest

WORDS = "the of and river stone walked under bright sky with seven old lanterns near quiet harbour where boats".split()


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "sun", "dra", "pe"]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null text and key, empty, blank, one word, long, repeated rows, equal texts, a column named like outputs."""
    long = prose(1, 6000)
    rows = [(1, prose(2, 120), "a"), (2, prose(2, 120), "a"), (3, None, None), (None, prose(3, 60), "b"), (5, "", "b"), (6, " \n\t ", "b"),
            (7, "word", "b"), (8, long, "c"), (9, prose(4, 30) + " " + long[:700] + " " + prose(5, 30), "c"), (10, "é😀 ñ " * 40, "c"),
            (1, prose(2, 120), "a"), (12, "aaaa" * 300, "a")]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, fp string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
