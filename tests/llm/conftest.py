import random

import pytest

SCHEMA = "doc_id long, text string, k string, fp int, n int, row string, score string, tokens string, quality int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Copies, near copies, shared passages, nulls, blanks, odd white space, a long text and equal rows."""
    rng = random.Random(11)
    passage, texts = prose(rng, 60, 10**6), []
    for i in range(60):
        texts.append(prose(rng, rng.randint(1, 200)))
    for i in range(15):
        texts.append(f"{prose(rng, 30)} {passage}\n{prose(rng, 40)}")
    base = prose(rng, 150, 10**6).split(" ")
    for i in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    texts += [texts[3]] * 4 + [" ".join(base)] * 5 + [None, "", "  \n\t ", "one", "Two words", "a b c d", "A B C D", "é ü 日本 ▁ x  y z  ", "l1 l2 l3 l4 l5 l6 l7 l8 l9\n" * 3, "tail \n", "###" * 5, prose(rng, 6000)]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:3] + [(rows[5][0], "a text of its own under a used id " + passage), (None, passage), (None, None)]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "row", "s", "t", 9) for i, t in messy_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_texts():
    """The texts of the smallest given table."""
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
