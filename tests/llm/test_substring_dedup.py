import os
import time

import numpy as np

from cloakframe.llm.common import materialize, mix, written
from cloakframe.llm.substring_dedup import remove_repeats, spans


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    for vocabulary in (1, 2, 3, 10, 1000):
        base = mix(rng.integers(1, vocabulary + 1, 300).astype(np.uint64))
        docs = []
        for _ in range(6):
            k, n = rng.integers(0, 200), rng.integers(0, 150)
            docs.append(np.concatenate([mix(rng.integers(1, vocabulary + 1, rng.integers(0, 60)).astype(np.uint64)), base[k : k + n]]))
        words, bounds = np.concatenate(docs), np.append(0, np.cumsum([len(x) for x in docs]))
        for window in (50, 20, 5, 1):
            seen, count = {}, 0
            for d, p, n, a in zip(*spans(words, bounds, window), strict=True):
                assert bounds[d] <= p and p + n + window - 1 <= bounds[d + 1]
                for q in range(p, p + n):
                    count += 1
                    assert seen.setdefault(words[q : q + window].tobytes(), a) == a
            assert count == sum(max(0, len(x) - window + 1) for x in docs)


def brute(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = (" ".join(x.decode() for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    return out


def test_brute_force(make_docs, corpus):
    for window in (50, 7):
        got = {r[0]: tuple(r[1:]) for r in remove_repeats(make_docs(corpus), window).collect()}
        assert got == brute(corpus, window)


def test_runs_and_empty(make_docs):
    rows = [(1, "a " * 49), (2, "a " * 120), (3, "b " + "a " * 60), (4, "a b " * 40), (5, "b a " * 40)]
    assert {r[0]: tuple(r[1:]) for r in remove_repeats(make_docs(rows)).collect()} == brute(rows, 50)
    assert remove_repeats(make_docs([])).count() == 0
    assert [tuple(r)[2:] for r in remove_repeats(make_docs([(1, "a " * 60), (1, "a " * 60)])).collect()] == [(60, 0), (60, 0)]


def test_null_and_repeated_ids(make_docs):
    """Rows with one id lose their own repeats only; a null id is larger than any."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (2, "x " + a + " " + b), (2, b), (2, a + " y"), (2, a + " y"), (None, b + " z"), (None, a), (None, a), (None, "own " * 55), (None, None)]
    out = sorted((str(r[0]), r[2], r[3]) for r in remove_repeats(make_docs(rows)).collect())
    assert out == sorted([("1", 60, 0), ("2", 121, 60), ("2", 60, 0), ("2", 61, 60), ("2", 61, 60), ("None", 61, 60), ("None", 60, 60), ("None", 60, 60), ("None", 55, 0), ("None", 0, 0)])


def shuffled(spark):
    """The shuffles of which files lie on the disk of this session's one executor."""
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name.split("_")[1] for top in tops for _, _, names in os.walk(top.getPath()) for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_released_shuffles_and_read_tables_go(make_docs, corpus, spark):
    """A write deletes what it shuffled; of the tables of all steps, only the one that the result is read from stays."""
    before = shuffled(spark)
    counts = materialize(make_docs(corpus).groupBy("doc_id").count(), "counts", release=True)
    until = time.time() + 10
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert counts.count() == len(corpus)
    first = len(written())
    out = remove_repeats(make_docs(corpus), 7)
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in written(first)] == ["cuts"]
    for _ in range(2):
        assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute(corpus, 7)
