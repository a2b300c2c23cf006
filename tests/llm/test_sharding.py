import pytest
from compare import SF, assert_same

from cloakframe.llm import queries
from cloakframe.llm.sharding import assign_shards, fill_table, preference


def brute(shards, m):
    """Turn after turn over full permutations."""
    orders = [[(o + j * s) % m for j in range(m)] for o, s in (preference(x, m) for x in shards)]
    owner = {}
    while len(owner) < m:
        for k, order in enumerate(orders):
            if len(owner) < m:
                owner[next(x for x in order if x not in owner)] = k
    return [owner[x] for x in range(m)]


@pytest.mark.parametrize("n,m", [(1, 7), (3, 7), (7, 7), (10, 101), (64, 251)])
def test_table(n, m):
    shards = [f"s{i}" for i in range(n)]
    table = fill_table(shards, m)
    assert table == brute(shards, m)
    sizes = [table.count(k) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_little_moves():
    shards = [f"s{i}" for i in range(20)]
    a, b = fill_table(shards, 4093), fill_table(shards[:-1], 4093)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x != 19) < 0.1 * 4093


@pytest.mark.parametrize("shards,m", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 9, 7)])
def test_refused(shards, m):
    with pytest.raises(ValueError):
        fill_table(shards, m)


def test_edges(make_docs):
    df = make_docs([(1, "a"), (1, "a"), (None, None), (2, "")])
    out = assign_shards(df, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(out) == 4 and len({r.shard for r in out if r.doc_id == 1}) == 1 and set(out[0].asDict()) == set(df.columns)
    assert assign_shards(make_docs([]), "doc_id", ["a"], 7).count() == 0


def test_sql(spark, duck):
    assert_same(queries.op10_sharding(spark, SF), duck, queries.op10_sql())
