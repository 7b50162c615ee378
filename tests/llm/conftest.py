import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "vé", "zu") for b in ("n", "rt", "st", "l", "ng", "x")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Documents with nulls, empty and long texts, repeated rows, copies and near copies, by doc_id."""
    rng = random.Random(7)
    base, passage, line = prose(rng, 120), prose(rng, 30), prose(rng, 20)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "one two", prose(rng, 40) + " " + passage + " " + prose(rng, 40), prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 9), prose(rng, 3000), line + "\n" + prose(rng, 15), prose(rng, 12) + "\n" + line.upper() + "!", line.replace(line.split()[3], "other", 1) + "\n" + line, "ï" * 50, base.upper()]
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def odd_table(spark, odd_docs):
    """The same with a repeated row and extra columns whose names operators use themselves."""
    rows = [(d, t, "k", d, 0.5, [1], "p") for d, t in [*odd_docs, odd_docs[7]]]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id long, score double, spans array<int>, n string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")
