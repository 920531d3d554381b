import random

import pytest

#: Columns beside the operators' own, with names that clash with theirs.
DDL = "doc_id long, text string, lang string, source string, n_chars long, rid long, score double, size int, KEY string, slot string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, clashing columns."""
    texts = [None, "", " \t\n", "one", "a b c d e f g h", "A  b c\td e f g h", "a b c d e f g h", "word " * 30_000, "ünï çødé 漢字 🙂 " * 50, "you are an idiot and a moron !!!"]
    rows = [(i if i != 8 else None, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 7, 0.5, 1, "k", "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, None, None, None, None, None, None, None, None, None), (3, "one", "en", "s1", 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).coalesce(1)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(9, 1, 1), (3, 1, 0), (4, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def prose():
    """Texts with exact copies, near copies and a chain of near copies; the same each time."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(120)]
    for _ in range(60):
        t = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    return texts
