import math
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import SF

from cloakframe.llm import lm_score
from cloakframe.llm.lm_score import END, score_documents


def words(t):
    return (t or "").encode().lower().split()


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*words(t), END])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = [*words(t), END]
        out[i] = (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_base_scores(make_docs, corpus):
    got = score_documents(make_docs(corpus)).collect()
    check(got, brute_base(corpus))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = score_documents(docs).collect()
    check(got, brute_base([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_normalised():
    """All symbols after any context add up to one."""
    rng = np.random.default_rng(0)
    frequency = rng.random(lm_score.SYMBOLS)
    model = lm_score.LogBilinear.initial(frequency / frequency.sum())
    near, far = model.pair_scores()
    for one, two in ((0, 5), (lm_score.BEGIN_SYMBOL, lm_score.BEGIN_SYMBOL), (lm_score.END_SYMBOL - 1, 3)):
        z = lm_score.log_normaliser(near, far, one)[two]
        p = np.exp(near[one, : lm_score.BEGIN_SYMBOL].astype(float) + far[two, : lm_score.BEGIN_SYMBOL] - z)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_score_held_against_single_tokens(make_docs, corpus, monkeypatch):
    """The score from the trained model, token by token: a softmax over all symbols, then the count inside the class."""
    held = []
    plain = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: held.append(plain(*a)) or held[0])
    got = {r.doc_id: r.score for r in score_documents(make_docs(corpus)).collect()}
    counts = Counter()
    for i, t in corpus:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(words(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    symbol = {w: k for k, w in enumerate(order[: lm_score.SYMBOL_WORDS])}
    of = lambda w: symbol.get(w, lm_score.SYMBOL_WORDS + lm_score.ending_class(w))
    inside = {}
    for w in order[lm_score.SYMBOL_WORDS :]:
        tokens, several = inside.get(of(w), (0, 0))
        inside[of(w)] = (tokens + counts[w], several + 1)
    m, begin = held[0], lm_score.BEGIN_SYMBOL
    for i, t in corpus[::9]:
        far = near = begin
        total = 0.0
        for w in [*words(t), END]:
            s = lm_score.END_SYMBOL if w == END else of(w)
            logits = m.vectors[:begin] @ (m.near.T @ m.vectors[near] + m.far.T @ m.vectors[far]) + m.bias[:begin]
            total += logits[s] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
            if w != END and w not in symbol:
                tokens, several = inside.get(s, (0, 0))
                total += np.log((counts[w] + 0.1) / (tokens + 0.1 * (several + 1)))
            far, near = near, s
        assert got[i] == pytest.approx(total / np.log(10), rel=1e-4)


def test_repeated_and_null_ids(make_docs):
    rows = [(1, "Rare one two"), (1, "rare RARE three"), (None, "one rare"), (1, "Rare one two"), (None, None), *((i, "one two three") for i in range(2, 40))]
    got = [tuple(r) for r in score_documents(make_docs(rows)).collect()]
    assert len(got) == len(rows)
    first = [r for r in got if r[0] == 1]
    assert sorted(r[2] for r in first) == [4, 4, 4] and len(set(first)) == 2
    assert all(not r[1] for r in got if r[0] is None) and sum(r[2] for r in got) == got[0][4] + sum(r[2] for r in got if r[1])


def test_empty(make_docs):
    assert score_documents(make_docs([])).count() == 0
    only = score_documents(make_docs([(i, None) for i in range(30)])).collect()
    assert len(only) == 30 and all(r.n_tokens == 1 for r in only)
