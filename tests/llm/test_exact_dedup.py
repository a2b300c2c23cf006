import hashlib
import re

import numpy as np
from compare import SF, assert_same

from cloakframe.llm import queries
from cloakframe.llm.exact_dedup import CountingQuotientFilter, exact_dedup


def test_filter_round_trip_and_merge():
    rng = np.random.default_rng(0)
    for bits, n in ((60, 500), (12, 800), (6, 40), (20, 0), (1, 2)):
        parts, whole = [], {}
        for _ in range(4):
            keys, counts = np.unique(rng.integers(0, 1 << bits, n).astype(np.uint64), return_counts=True)
            counts = counts * rng.integers(1, 300, len(counts))
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                whole[k] = whole.get(k, 0) + c
            parts.append(CountingQuotientFilter.load(CountingQuotientFilter.build(keys, counts, bits).dump()))
            back = parts[-1].items()
            assert (back[0] == keys).all() and (back[1] == counts).all()
        keys, counts = CountingQuotientFilter.merge(parts).items()
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == whole


def brute(rows):
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    groups = {}
    for i, t in rows:
        groups.setdefault(bare[i], []).append((-len(t or ""), i))
    return {(i, min(groups[bare[i]])[1], len(groups[bare[i]]), min(groups[bare[i]])[1] == i, hashlib.sha256(bare[i].encode()).hexdigest()) for i, _ in rows}


def test_brute_force(make_docs, corpus):
    assert {tuple(r) for r in exact_dedup(make_docs(corpus)).collect()} == brute(corpus)


def test_empty_and_repeated(make_docs):
    assert exact_dedup(make_docs([])).count() == 0
    out = exact_dedup(make_docs([(1, "a b"), (1, "a b"), (2, None), (3, " ")])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in sorted(out)] == [(1, 1, 2), (1, 1, 2), (2, 3, 2), (3, 3, 2)]


def test_null_and_repeated_ids(make_docs):
    rows = [(None, "a"), (None, "a"), (3, "a"), (4, "a"), (None, "b c"), (None, "bc"), (5, "d "), (5, "d"), (5, "d "), (None, None)]
    out = exact_dedup(make_docs(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    sizes = sorted((len(v), {r.group_size for r in v}, {r.keep_id for r in v}, sum(r.kept for r in v)) for v in by.values())
    assert sizes == [(1, {1}, {None}, 1), (2, {2}, {None}, 1), (3, {3}, {5}, 1), (4, {4}, {3}, 1)]
    assert [r.doc_id for r in out if r.kept and r.group_size == 4] == [3]


def test_sql(spark, duck):
    assert_same(queries.op8_exact_dedup(spark, SF), duck, queries.OP8_SQL)
