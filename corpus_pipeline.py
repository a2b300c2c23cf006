"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

All but the last return the columns of their input, whatever else they are
named.  A stage works on all that its predecessor kept; every decision takes
effect on single rows: where ids repeat or are null, rows are numbered in the
order of their ids (null last) first.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.common import discard, fresh, materialize, table, written
from cloakframe.llm.exact_dedup import exact_dedup
from cloakframe.llm.ngram_join import jaccard_components
from cloakframe.llm.packing import pack_documents
from cloakframe.llm.substring_dedup import remove_repeats
from cloakframe.llm.toxicity import chain_rows, toxicity_chain


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: the id, where it does, else a number in the order of ids."""
    ids = docs.groupBy("doc_id").count()
    if ids.where("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    row = fresh(docs, "row")
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(row, F.monotonically_increasing_id())
    return materialize(ordered, "numbered"), row


def _without(docs: DataFrame, gone: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    return docs.join(materialize(gone.select(key), name), key, "left_anti").select([F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, fitted on ``labels``, finds toxic."""
    rows = chain_rows(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))
    return rows.where("not toxic").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    rows, key = _numbered(docs)
    return _without(rows, exact_dedup(rows, key).where("not kept"), key, docs.columns, "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    rows, key = _numbered(docs)
    return _without(rows, jaccard_components(rows, id_col=key).where(F.col("component_id") != F.col(key)), key, docs.columns, "near-copies")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document has.

    A text that loses nothing stays as it is; one that loses words becomes the
    words that stay, joined by one space, with n_chars, if there is such a
    column, to match; one that loses all of them goes.
    """
    rows, key = _numbered(docs)
    cut = fresh(rows, "cut")
    changed = remove_repeats(rows, id_col=key).where("n_removed > 0").select(key, F.struct("kept", (F.col("n_removed") == F.col("n_words")).alias("all_gone")).alias(cut))
    kept = F.col(f"{cut}.kept")
    out = rows.join(materialize(changed, "cut"), key, "left").where(~F.coalesce(F.col(f"{cut}.all_gone"), F.lit(False)))
    new = {"text": F.coalesce(kept, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(kept), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: a row for each piece of a document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and a packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), len(written())
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        # What the stage read and wrote on its way is needed no more.
        discard(spark, written(first)[:-1])
    return docs
