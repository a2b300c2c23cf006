import numpy as np
import pytest
from compare import SF, assert_same
from pyspark.sql import functions as F

from cloakframe.llm import queries
from cloakframe.llm.topk_search import BallTree, top_k


@pytest.mark.parametrize("n,d,q,k", [(1, 3, 1, 5), (300, 2, 20, 5), (2000, 8, 50, 5), (1500, 32, 60, 3), (300, 1, 300, 5)])
def test_tree(n, d, q, k):
    rng = np.random.default_rng(n + d)
    v = rng.integers(-20, 20, (n, d))
    if n == 300:
        v[:200] = v[0]
    ids = rng.permutation(n * 3)[:n]
    found, scores = BallTree(ids.copy(), v.copy()).search(ids[:q], v[:q], k, np.full(q, np.iinfo(np.int64).min))
    for r in range(q):
        s = v @ v[r]
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[r]][:k]
        assert list(found[r][: len(want)]) == list(ids[want]) and list(scores[r][: len(want)]) == list(s[want])


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        s = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s)}
    return out


def test_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(200)]
    rows += [(700, None), (701, [1.0, None, 1.0, 1.0]), (750, [1.0, float("nan"), 0.0, 0.0]), (800, [float("inf")] * 4), (850, [1.0, 2.0]), (851, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS v", "3 AS floor", "4 AS label")
    for shard in (64, 10_000):
        assert {tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, shard_vectors=shard).collect()} == brute(rows)
    assert top_k(df.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_clusters_repeated_ids_and_hot_vector(spark):
    """Balls far apart, a vector that a third of the rows have, and ids that repeat with other vectors and widths."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(6, 5)) * 4
    rows = [(i, [float(x) for x in middle[i % 6] + rng.normal(size=5) / 8]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, shard_vectors=32).collect()} == brute(rows)
    again = [(50, [9.0, 9.0, 9.0, 9.0, 9.0]), (50, [1.0, 2.0]), (51, [2.0, 2.0]), (52, [3.0, 1.0]), (None, [5.0, 5.0])]
    out = top_k(spark.createDataFrame(rows + again, df.schema), F.col("vec_id") % 50 == 0, shard_vectors=32)
    own = sorted((r["rank"], r["vec_id"]) for r in out.where("query_id = 50").collect())
    assert own == [(1, 51), (2, 52)]
    others = {tuple(r) for r in out.where("query_id = 100").collect()}
    assert others == {r for r in brute([*rows, *[x for x in again if x[0] == 50 and len(x[1]) == 5]]) if r[0] == 100}


def test_overflow():
    with pytest.raises(ValueError):
        BallTree(np.array([1]), np.array([[1 << 31, 1 << 31]]))
    big = BallTree(np.array([1, 2]), np.array([[1 << 29], [3]]))
    assert big.search(np.array([9]), np.array([[(1 << 29) + 1]]), 1, np.array([-1]))[1][0][0] == (1 << 29) * ((1 << 29) + 1)


def test_sql(spark, duck):
    assert_same(queries.op9_topk_search(spark, SF), duck, queries.OP9_SQL)
