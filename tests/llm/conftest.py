import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and very long texts, copies, repeated rows, shared passages and odd spaces."""
    rng = random.Random(5)
    passage = sentence(rng, 50)
    rows = [(i, sentence(rng, rng.randint(1, 90)), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, f"{sentence(rng, 5)} {passage} {sentence(rng, 7)}", "en", "s", 1) for i in range(6)]
    long = sentence(rng, 6000)
    rows += [(200, long, "en", "s", 1), (201, long.replace(" a ", " b ", 3), None, None, None), (202, "la " * 120, "fr", "s", 1)]
    base = sentence(rng, 300).split()
    for i in range(8):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        rows.append((300 + i, " ".join(near), "de", "hot", 1))
    rows += [(400, rows[0][1], "en", "s", 1), (401, None, None, None, None), (402, "", "en", "s", 0), (403, " \t\n\x0b ", "en", "s", 0), (None, rows[3][1], "en", "s", 1), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (404, rows[50][1].upper(), "en", "s", 1), (405, "é ü 日本語 " * 40, "ja", "s", 1), (406, "a\x0bb\x0cc\rd e", "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
