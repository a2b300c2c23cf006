import random

import pytest
from pyspark.sql import functions as F

#: Columns named as operators name theirs.
CLASHES = ("n", "hi", "lo", "word", "size", "shard", "slot", "kept", "length", "row", "doc", "cls", "token", "__slot", "pos", "features")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashes=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clashes else df

    return make


def invented(n=160, seed=3):
    """Texts with copies, near copies, shared passages, nulls, blanks, ties and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        kind = rng.random()
        if kind < 0.3:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        elif kind < 0.5 and w:
            w[rng.randrange(len(w))] = "Changed"
        elif kind < 0.65:
            a = rng.randint(0, 25)
            w = w[:20] + passage[a : a + rng.randint(45, 55)] + w[20:]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "a"), (n + 4, "A"), (n + 5, "one two"), (n + 6, "One  two"), (n + 7, "x " * 3000), (n + 8, "x " * 3000 + "y"), (n + 9, "\x1c    z"), (n + 10, "<|endoftext|> it's 12")]
    return rows


@pytest.fixture(scope="session")
def corpus():
    return invented()
