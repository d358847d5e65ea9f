import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, tree int, shard string, g string, row bigint, ids string, Text_ string"
ODD = ["", None, " \n\t ", "...!!!", "a", "é", "x " * 150_000, "y" * 300_000, "\x00\x01", "'s", "🙂 🙂", "<b>"]


def prose(r, n, stock):
    return " ".join(r.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose in two made-up languages, near and exact copies, repeated rows, nulls in every column, odd and long texts; further columns with names that operators use inside."""
    r = random.Random(4)
    a = ["".join(r.choice(["the", "ing", "er", "on", "an", "re"]) for _ in range(r.randint(1, 3))) for _ in range(900)]
    b = ["".join(r.choice(["sch", "ung", "ei", "zu", "ö", "keit"]) for _ in range(r.randint(1, 3))) for _ in range(900)]
    texts = [(prose(r, r.randint(30, 120), s), lang) for s, lang in ((a, "aa"), (b, "bb")) for _ in range(60)]
    for k in range(12):
        w = texts[k][0].split()
        w[r.randrange(len(w))] = "changed"
        texts += [(" ".join(w), texts[k][1]), (texts[k][0], texts[k][1])]
    texts += [(t, "aa") for t in ODD] + [(ODD[6], None)]
    rows = [(i, t, lang, f"s{i % 2}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None), (len(rows) + 5, "the last", "aa", None, 8)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*x, "d", 1, "s", "g", 7, "i", "t") for x in corpus], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
