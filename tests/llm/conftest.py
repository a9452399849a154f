import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, fp long, digest string, block string, ids string, __id long"


def row(doc_id, text, lang="en"):
    """A document with further columns, some named like columns the operators use inside."""
    return (doc_id, text, lang, None, None, 0.5, 7, 8, "d", "b", "i", 9)


def prose(rng, words, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(words))


def corpus():
    """Documents with copies, near copies, shared passages, nulls, blanks, long texts and repeated rows."""
    rng = random.Random(5)
    shared = prose(rng, 40)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    docs += [(200 + i, prose(rng, 20) + " " + shared + "\n" + prose(rng, 15)) for i in range(12)]
    docs += [(300 + i, texts[3]) for i in range(8)] + [(320, texts[3].replace(" ", "\t  ")), (321, texts[3] + " extra")]
    long = prose(rng, 30_000)
    docs += [(400, long), (401, long + " tail"), (402, "x" * 300_000), (403, "a " * 5000), (404, "ß " * 300 + "日本語 \U0001f600 " * 50)]
    docs += [(500, None), (501, ""), (502, " \t\n "), (503, "\x00 \x1c  word"), (None, texts[3]), (None, None), (504, texts[5]), (504, texts[5]), (504, "other words here"), (-1, texts[6])]
    return docs


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([row(*d) for d in corpus()], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
