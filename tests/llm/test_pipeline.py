import re

import pytest
from compare import SF
from test_exact_dedup import brute as exact
from test_ngram_join import brute as near
from test_substring_dedup import brute as repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")


def test_exact_stage(spark, docs, corpus):
    out = STAGES["exact_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in exact(corpus) if r[3]}


def test_near_stage(spark, docs, corpus):
    out = STAGES["ngram_jaccard_join"](spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in near(corpus).items() if i == c}


def test_cut_stage(spark, docs, corpus):
    out = {r.doc_id: r for r in STAGES["substring_dedup"](spark, docs, SF).collect()}
    want = repeats(corpus, 50)
    texts = dict(corpus)
    assert set(out) == {i for i, (_, n, gone) in want.items() if not gone or gone < n}
    for i, r in out.items():
        kept, _, gone = want[i]
        assert r.text == (kept if gone else texts[i]) and (not gone or r.n_chars == len(kept))


def test_toxic_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = STAGES["toxicity"](spark, docs, SF)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert out.columns == docs.columns and docs.count() * 0.8 < len(kept) < docs.count() and len(kept & toxic) <= 0.4 * len(toxic) + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and re.match("doc_id", out.columns[0])


def test_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), SF).count() == 0, name


def test_clashing_columns_repeated_and_null_ids(spark):
    """Stages decide on rows, whatever their ids and other columns are called."""
    long = " ".join(f"w{k}" for k in range(70))
    rows = [(1, "same text here"), (1, "same  text here"), (1, "another one"), (None, "another  one"), (2, long), (2, long + " tail"), (3, "head " + long), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS kept", "true AS all_gone", "'r' AS row", "'c' AS cut", "'t' AS toxic", "0.5 AS p_toxic", "1 AS n", "2 AS n_removed")
    out = {name: STAGES[name](spark, docs, SF) for name in ("toxicity", "exact_dedup", "ngram_jaccard_join", "substring_dedup")}
    for name, df in out.items():
        assert df.columns == docs.columns, name
    # The longest of equal texts stays, one row of each group.
    assert sorted(str((r.doc_id, r.text)) for r in out["exact_dedup"].collect()) == sorted(map(str, [(1, "same  text here"), (None, "another  one"), (2, long), (2, long + " tail"), (3, "head " + long), (None, None)]))
    near = [(r.doc_id, r.text) for r in out["ngram_jaccard_join"].collect()]
    assert len(near) == 5 and sum("w5" in (t or "") for _, t in near) == 1 and near.count((None, None)) == 1 and near.count((None, "")) == 1
    cut = [(r.doc_id, r.text) for r in out["substring_dedup"].collect()]
    # One row keeps the passage; of the others, those that are nothing else go.
    assert sum("w5" in (t or "").split() for _, t in cut) == 1 and (3, "head") in cut and len(cut) in (8, 9)
    assert out["toxicity"].count() == len(rows)


def test_run_leaves_one_table(spark):
    """What stages write on their way goes."""
    from cloakframe.llm.common import written

    before = len(written())
    corpus_pipeline.run(spark, SF).count()
    assert len(written(before)) == 1
