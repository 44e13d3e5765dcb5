import random

import pytest

SYLLABLES = "ka lo mi ne ru ta vi so pe du".split()
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n):
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, a null, empty and very short ones, one long one, and a repeated row."""
    r = random.Random(11)
    texts = {i: " ".join(words(r, r.randrange(40, 120))) for i in range(30)}
    for i in range(30, 40):
        w = texts[i - 30].split()
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    texts |= {40: texts[3], 41: texts[3], 42: None, 43: "", 44: "two words", 45: "two words", 46: " ".join(words(r, 30_000)), 47: "\n\n \t", 48: texts[5].upper()}
    rows = [(i, t) for i, t in texts.items()]
    return [*rows, rows[7], (None, texts[9]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, -1) for i, t in corpus]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
