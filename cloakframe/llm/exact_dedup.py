"""Exact deduplication with counting quotient filters.

Every partition builds counting quotient filters over the fingerprints of its
texts, one for each range of quotients.  The filters of a range meet in one
task and merge without loss by their sorted remainders.  A fingerprint whose
merged count stays at one proves its text unique; the others go on to
verification by bytes, where equal texts are counted and the row that stays
is chosen.

Scale: fingerprints travel as packed filters (about 9 bytes a text), ranges
follow the number of shuffle partitions, and copies are pre-aggregated before
any shuffle, so a group that holds a third of all rows costs a few rows for
each task.  Nothing is collected to the driver and nothing is broadcast unless
Spark measures it below its own threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, partitions

#: Bits of a fingerprint: 15 hex digits of SHA-256 fit a non-negative long.
FINGERPRINT_BITS = 60


class CountingQuotientFilter:
    """A counting quotient filter over sorted fingerprints of ``bits`` bits.

    ``quotient_bits`` high bits give the home slot; the slots of a quotient
    form a run of rising remainders, pushed right where an earlier run is
    still open.  ``occupied`` marks quotients with a run, ``run_end`` the last
    slot of each run, and ``counter`` the slots that hold the count of the
    remainder before them (absent for a count of one).
    """

    def __init__(self, bits: int, quotient_bits: int, occupied, run_end, counter, slots):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.run_end, self.counter, self.slots = occupied, run_end, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From rising distinct ``fingerprints`` with their ``counts``."""
        n = len(fingerprints)
        quotient_bits = min(bits, max(1, int(np.ceil(np.log2(max(n, 1) * 1.25 + 1)))))
        r = np.uint64(bits - quotient_bits)
        quotient = (fingerprints >> r).astype(np.int64)
        remainder = fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        width = np.where(counts > 1, 2, 1)
        before = np.cumsum(width) - width
        at = before + np.maximum.accumulate(quotient - before) if n else before
        size = max(1 << quotient_bits, int(at[-1] + width[-1]) if n else 0)
        occupied, run_end, counter = (np.zeros(size, bool) for _ in range(3))
        slots = np.zeros(size, np.uint64)
        occupied[quotient] = True
        slots[at] = remainder
        many = counts > 1
        slots[at[many] + 1] = counts[many].astype(np.uint64)
        counter[at[many] + 1] = True
        last = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
        run_end[(at + width - 1)[last]] = True
        return cls(bits, quotient_bits, occupied, run_end, counter, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The rising fingerprints and their counts, read from the slots."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(quotient):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.maximum(quotient, np.append(0, end[:-1] + 1))
        length = end - start + 1
        slot = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        of = np.repeat(quotient, length)
        extra = self.counter[slot]
        head = np.flatnonzero(~extra)
        r = np.uint64(self.bits - self.quotient_bits)
        found = (of[head].astype(np.uint64) << r) | self.slots[slot[head]]
        counts = np.ones(len(head), np.int64)
        counted = np.flatnonzero(extra)
        counts[np.searchsorted(head, counted) - 1] = self.slots[slot[counted]].astype(np.int64)
        return found, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: the sorted streams of all filters meet and equal remainders add their counts."""
        parts = [f.items() for f in filters]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        if len(keys):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        return cls.build(keys, counts, filters[0].bits)

    def dump(self) -> bytes:
        width = 1 + max(int(self.slots.max(initial=0)).bit_length() - 1, 0) // 8
        head = np.array([self.bits, self.quotient_bits, len(self.slots), width], np.int64).tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter))
        return head + bits + self.slots.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, size, width = map(int, np.frombuffer(raw, np.int64, 4))
        at, n, found = 32, (size + 7) // 8, []
        for _ in range(3):
            found.append(np.unpackbits(np.frombuffer(raw, np.uint8, n, at), count=size).astype(bool))
            at += n
        slots = np.zeros((size, 8), np.uint8)
        slots[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(size, width)
        return cls(bits, quotient_bits, *found, slots.reshape(-1).view(np.uint64))


def _build(range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) for b in batches]
        if not parts:
            return
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        low = FINGERPRINT_BITS - range_bits
        which = keys >> np.uint64(low)
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(keys) else []
        for i, j in zip(first, np.append(first[1:], len(keys)), strict=True) if len(keys) else ():
            inner = keys[i:j] & np.uint64((1 << low) - 1)
            built = CountingQuotientFilter.build(inner, counts[i:j], low)
            yield pa.RecordBatch.from_pydict({"quotients": pa.array([int(which[i])], pa.int32()), "filter": [built.dump()]})

    return run


def _merge(range_bits: int):
    def run(group: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.load(x) for x in group.column("filter").to_pylist()])
        keys, counts = merged.items()
        high = np.uint64(group.column("quotients")[0].as_py() << (FINGERPRINT_BITS - range_bits))
        many = counts > 1
        return pa.table({"fingerprint": (keys[many] | high).astype(np.int64), "copies": counts[many]})

    return run


def repeated_fingerprints(prints: DataFrame, ranges: int | None = None) -> DataFrame:
    """(fingerprint, copies) of the values in the one column of ``prints`` that occur more than once."""
    range_bits = max(1, ((ranges or partitions(prints.sparkSession)) - 1).bit_length())
    filters = prints.mapInArrow(_build(range_bits), "quotients int, filter binary")
    return filters.groupBy("quotients").applyInArrow(_merge(range_bits), "fingerprint long, copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after their ASCII white space is deleted;
    a null text counts as empty, so null, empty and blank texts form one
    group.  Of a group, the row with the most code points in the original
    text stays, on ties that with the smallest id, a null id being larger
    than any.  One row a group is kept: of rows alike in all that, any one,
    also where their ids are equal.  Other columns are ignored; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    points = F.length(text).cast("long").alias("points")
    bare = F.regexp_replace(text, f"{SPACE_CLASS}+", "")
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id")
    rows = docs.select(F.col(id_col).alias("doc_id"), number, points, F.sha2(bare.cast("binary"), 256).alias("text_sha256"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    print_of = F.conv(F.substring("text_sha256", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")
    repeated = repeated_fingerprints(rows.select(print_of.alias("fingerprint")))
    suspects = rows.select("id", print_of.alias("fingerprint")).join(repeated.select("fingerprint"), "fingerprint", "left_semi").select("id").distinct()
    # Bytes decide: a text is a key of the aggregation itself, and a digest that two texts share stops the job.
    texts = docs.select(number, points, bare.alias("bare")).join(suspects, "id", "left_semi")
    classes = texts.groupBy("bare").agg(F.count("*").alias("size"), F.max(F.struct("points", (-F.col("id")).alias("rank"))).alias("best"))
    classes = (
        classes.select(F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), "size", "best")
        .groupBy("text_sha256")
        .agg(F.sum("size").alias("size"), F.max("best").alias("best"), F.count("*").alias("texts"))
        .select("text_sha256", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.col("size")).alias("size"), "best")
        .where("size > 1")
    )
    # Written first, so that Spark can split a large group's rows in these joins.
    classes = materialize(classes.select("text_sha256", "size", F.col("best.points").alias("most"), (-F.col("best.rank")).alias("least")), "classes")
    best = rows.join(classes, "text_sha256").where("points = most and id = least").groupBy("text_sha256").agg(F.min("row").alias("best_row"), F.first("size").alias("size"), F.first("doc_id").alias("keep"))
    best = materialize(best, "best")
    alone = F.col("size").isNull()
    return rows.join(best, "text_sha256", "left").select(
        F.col("doc_id").alias(id_col), F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"), "text_sha256",
    )
