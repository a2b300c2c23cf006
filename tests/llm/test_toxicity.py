import random

import numpy as np
from compare import SF

from cloakframe.llm.toxicity import FOLDS, MEASURES, Chain, best_threshold, fit_chain, fit_logistic, predict_chain, probabilities, toxicity
from pyspark.sql import functions as F


def test_logistic_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    rows = np.concatenate([np.flatnonzero(y == 1), np.arange(400)])
    columns = np.concatenate([np.zeros(int(y.sum()), int), rng.integers(1, 6, 400)])
    dense = np.ones((400, 1))
    w = fit_logistic(rows, columns, dense, y, 6)
    assert ((probabilities(rows, columns, dense, w) > 0.5) == (y == 1)).all()


def planted(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(len(w))] = "zqvile" + rng.choice(["", "a", "xo", "er"])
        rows.append((i, " ".join(w)))
        labels.append((i, rng.randint(0, 1), int(toxic)))
    return rows, labels


def test_held_out(spark, make_docs):
    rows, labels = planted()
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity(make_docs(rows), known).collect()}
    assert len(got) == len(rows) and all(got[i] == bool(t) for i, _, t in labels[200:])


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (1, 0, 0), (2, None, 1), (99, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(0, "bad words"), (1, "fine words"), (2, None), (3, ""), (4, "x" * 100_000), (4, "x" * 100_000)]
    out = toxicity(make_docs(rows), labels).collect()
    assert len(out) == 6 and all(0 <= r.p_toxic <= 1 for r in out)
    assert toxicity(make_docs([]), labels).count() == 0
    none = toxicity(make_docs(rows), labels.where("1 = 0")).collect()
    assert {r.p_toxic for r in none} == {0.5}


def test_nothing_is_toxic_without_labels(spark, make_docs):
    docs = make_docs([(0, "bad words"), (1, "fine words")])
    for known in ([], [(0, None, None)], [(99, 1, 1)]):
        labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
        assert [r.toxic for r in toxicity(docs, labels).collect()] == [False, False]


def test_later_categories_see_earlier_ones(spark, make_docs):
    rows, labels = planted(120)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = fit_chain(make_docs(rows), known, {"first": F.col("toxic") == 1, "second": F.col("toxic") == 1})
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][-1] > 0
    assert predict_chain(make_docs(rows), chain).columns == ["doc_id", "p_first", "p_second", "first", "second"]


def dense_newton(x, y):
    """Penalised logistic weights by whole Newton steps."""
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p) / n)[:, None]) + 0.5 / n * np.eye(len(w)), x.T @ (p - y) / n + 0.5 / n * w)
    return w


def test_chain_equals_dense_newton():
    rng = np.random.default_rng(5)
    n, width = 240, 12
    bits = rng.random((n, width)) < 0.3
    dense = np.column_stack([np.ones(n), rng.random((n, len(MEASURES) - 1))])
    labels = np.stack([bits[:, 0] | (rng.random(n) < 0.1), (bits[:, 0] & bits[:, 1]) | (rng.random(n) < 0.05)], 1).astype(int)
    fold = rng.integers(0, FOLDS, n)
    rows, columns = np.nonzero(bits)
    chain = Chain.fit(["a", "b"], [str(k) for k in range(width)], rows, columns, dense, labels, fold)
    x = np.column_stack([bits, dense])
    out, got = [], chain.predict(rows, columns, dense)
    for k in range(2):
        held = np.zeros(n)
        for f in range(FOLDS):
            t = fold == f
            held[t] = 1 / (1 + np.exp(-(x[t] @ dense_newton(x[~t], labels[~t, k]))))
        p = 1 / (1 + np.exp(-(np.column_stack([x[:, : width + len(MEASURES)], *out]) @ dense_newton(x, labels[:, k]))))
        assert np.abs(p - got[:, k]).max() < 1e-3 and abs(best_threshold(held, labels[:, k]) - chain.thresholds[k]) < 1e-2
        x, out = np.column_stack([x, held]), [*out, p]


def test_best_threshold():
    """Held against the F1 score of every cut."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        y = rng.integers(0, 2, 40)
        p = np.round(np.clip(0.3 * y + rng.random(40) * 0.7, 0, 1), 2)
        score = lambda t: 2 * (y[p >= t].sum()) / ((p >= t).sum() + y.sum())
        assert score(best_threshold(p, y)) == max(map(score, p))
    assert best_threshold(np.array([0.1, 0.2, 0.9]), np.array([0, 0, 1])) > 0.4
    assert best_threshold(np.array([0.1, 0.9]), np.array([0, 0])) > 1


def test_repeated_and_null_ids(spark, make_docs):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = [(i, ("vile thing " if i % 3 == 0 else "good thing ") + f"w{i % 7}") for i in range(60)]
    rows += [(0, rows[0][1]), (0, "good thing w1"), (None, "vile thing w2"), (None, "good thing w3"), (1, rows[1][1])]
    out = toxicity(make_docs(rows), labels)
    assert out.count() == len(rows) and out.where("doc_id is null and toxic").count() == 1 and out.where("doc_id = 0 and toxic").count() == 2


def test_labelled_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity(docs, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id")
    assert got.where("toxic = (y = 1)").count() > 0.9 * got.count()
