"""Removal of repeated passages by recompression.

Recompression rewrites every text in rounds.  A round names pairs of
neighbouring symbols (a symbol of the left half of the alphabet before one of
the right half) or runs of one symbol.  Names and halves are hashes of what
they stand for, so all tasks give equal things equal names without an
exchange, and inside equal passages the same symbols appear at every level.
With each symbol goes the stretch of words that decides it: equal stretches
give equal symbols wherever they stand.

A window's anchor is the symbol of the highest level whose stretch lies inside
the window (on ties that of the least hash, then the leftmost).  It depends on
the window's words alone, so equal windows have equal anchors.  Consecutive
windows with one anchor make a span.

1.  Spans are listed by anchor and by the words they cover; each task sends
    one entry for equal spans, packed by ranges of anchors.  Anchors that
    only one document has are done with.
2.  Spans of shared anchors come back as rows.  A span whose words a smaller
    document also has is repeated whole.  The first holders of different
    spans with one anchor compare single windows.
3.  Each document drops the words that repeated windows cover.

Anchors and spans are hashed by independent 64-bit functions, so equal spans
agree in 128 bits, and so do equal windows.

Scale: what is shuffled in step 1 is one entry for several words; step 2 is a
join that Spark can split on a hot anchor; step 3 moves each text once.  The
filter that is broadcast has a fixed size.  What a step shuffled or wrote is
deleted as soon as the next has read it; the cuts of step 3 stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_view, discard, materialize, membership_filter, mix, partitions, passes, span_hashes, text_bytes, tidy, word_hashes, word_spans, written

#: Rounds of naming: pairs or runs.
ROUNDS = ("pairs", "pairs", "runs", "pairs", "pairs", "runs", "pairs", "pairs", "pairs", "runs", "pairs")
#: Entries (32 bytes each) that one bucket of anchors holds on average.
BUCKET_ENTRIES = 500_000
#: Stands for a null id: larger than any other.
_NO_ID = 2**63 - 1


def _shift(values: np.ndarray, edge: np.ndarray, at_edge: np.ndarray, back: int) -> np.ndarray:
    """The neighbour's value, or ``at_edge`` where there is none in the document."""
    out = np.roll(values, back)
    return np.where(edge, at_edge, out)


def _name_pairs(sym, lo, hi, doc, first, last, begin, end, salt):
    half = (mix(sym ^ salt) >> np.uint64(63)).astype(bool)
    right = np.append(half[1:], False)
    pair = ~half & right & ~last
    after = _shift(hi, last, end[doc] + 1, -1)
    before = _shift(lo, first, begin[doc] - 1, 1)
    joined = np.append(sym[1:], np.uint64(0))
    name = np.where(pair, mix(sym * np.uint64(0x9E3779B97F4A7C15) + mix(joined + np.uint64(0x2545F4914F6CDD1D))), sym)
    keep = ~np.append(False, pair[:-1])
    # A lone left symbol is known by what follows it, a lone right one by what stands before it.
    new_hi = np.where(pair | ~half, after, hi)
    new_lo = np.where(half, before, lo)
    new_last = last | (pair & np.append(last[1:], False))
    return name[keep], new_lo[keep], new_hi[keep], doc[keep], first[keep], new_last[keep]


def _name_runs(sym, lo, hi, doc, first, last, begin, end, salt):
    start = first | np.append(True, sym[1:] != sym[:-1])
    at = np.flatnonzero(start)
    to = np.append(at[1:], len(sym)) - 1
    n = to - at + 1
    after = _shift(hi, last, end[doc] + 1, -1)
    before = _shift(lo, first, begin[doc] - 1, 1)
    name = np.where(n > 1, mix(sym[at] + mix(n.astype(np.uint64) ^ salt)), sym[at])
    return name, before[at], after[to], doc[at], first[at], last[to]


def levels(words: np.ndarray, bounds: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, where their stretches begin, where they end) of each level, words first."""
    n = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begin, end = bounds[:-1], bounds[1:]
    at = np.arange(n)
    state = (words, at, at + 1, doc, at == begin[doc], at == end[doc] - 1)
    out = [state[:3]]
    for k, kind in enumerate(ROUNDS):
        salt = np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        state = (_name_pairs if kind == "pairs" else _name_runs)(*state, begin, end, salt)
        out.append(state[:3])
        if not ((state[2] - state[1]) <= reach).any():
            break
    return out


def spans(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, anchor) of each span."""
    many = np.maximum(np.diff(bounds) - window + 1, 0)
    total = int(many.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    doc = np.repeat(np.arange(len(many)), many)
    p = np.repeat(bounds[:-1] - (np.cumsum(many) - many), many) + np.arange(total)
    anchor, which = np.zeros(total, np.uint64), np.full(total, -1, np.int64)
    todo = np.arange(total)
    found = levels(words, bounds, window)
    size = len(words) + 3
    for k in range(len(found) - 1, -1, -1):
        sym, lo, hi = found[k]
        begins = np.cumsum(np.bincount(lo + 1, minlength=size + 1))
        ends = np.cumsum(np.bincount(hi, minlength=size + 1))
        at = p[todo]
        i, j = begins[at], ends[at + window]
        ok = i < j
        if not ok.any():
            continue
        key = (mix(sym ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sym), dtype=np.uint64)
        edges = np.stack([i[ok], j[ok]], 1).ravel()
        best = np.minimum.reduceat(np.append(key, np.uint64(0xFFFFFFFFFFFFFFFF)), edges)[::2] & np.uint64(0xFFFFFFFF)
        hit = todo[ok]
        best = best.astype(np.int64)
        anchor[hit] = mix(sym[best] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        which[hit] = (k << 40) | best
        todo = todo[~ok]
        if not len(todo):
            break
    new = np.append(True, (which[1:] != which[:-1]) | (doc[1:] != doc[:-1]))
    at = np.flatnonzero(new)
    return doc[at], p[at], np.diff(np.append(at, total)), anchor[at]


def _spans_of(b: pa.RecordBatch, window: int):
    """Spans of a block of texts with the hash of the words they cover, and the words' second hashes."""
    data, offsets = byte_view(b.column("text"))
    starts, ends, bounds = word_spans(data, offsets)
    doc, p, n, anchor = spans(word_hashes(data, starts, ends), bounds, window)
    second = word_hashes(data, starts, ends, which=1) if len(doc) else np.zeros(0, np.uint64)
    cover = span_hashes(second, p, p + n + window - 1)
    return doc, p - bounds[doc], n, anchor, cover, second, p


_ENTRY = np.dtype([("anchor", "<u8"), ("cover", "<u8"), ("low", "<i8"), ("more", "<i8")])


def _reduced(rows: np.ndarray) -> np.ndarray:
    """One entry for equal anchors and covers: the smallest document, and how far the largest lies above."""
    rows = rows[np.lexsort((rows["low"], rows["cover"], rows["anchor"]))]
    at = np.flatnonzero(np.append(True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["cover"][1:] != rows["cover"][:-1])))
    top = np.maximum.reduceat(rows["low"] + rows["more"], at)
    rows = rows[at]
    rows["more"] = top - rows["low"]
    return rows


def _list_spans(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = _reduced(np.concatenate(held))
            # Anchors are evenly spread, so ranges of them are; rows are sorted by them.
            bucket = ((rows["anchor"] >> np.uint64(33)).astype(np.int64) * buckets) >> 31
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cut[1:], len(bucket))
            for i in range(0, len(cut), 64):
                packed = [b"".join(np.ascontiguousarray(rows[f][a:z]).tobytes() for f in _ENTRY.names) for a, z in zip(cut[i : i + 64], ends[i : i + 64], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[i : i + 64]].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for b in blocks(batch, "text"):
                doc, _, _, anchor, cover, _, _ = _spans_of(b, window)
                if not len(doc):
                    continue
                rows = np.zeros(len(doc), _ENTRY)
                rows["anchor"], rows["cover"], rows["low"] = anchor, cover, b.column("doc_id").to_numpy()[doc]
                held.append(rows)
                size += len(rows)
                if size > 1_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // _ENTRY.itemsize
    rows = np.empty(n, _ENTRY)
    for k, f in enumerate(_ENTRY.names):
        rows[f] = np.frombuffer(raw, _ENTRY[f], n, k * n * 8)
    return rows


def _shared(group: pa.Table) -> pa.Table:
    rows = _reduced(np.concatenate([_unpack(x.as_py()) for c in group.column("entries").chunks for x in c]))
    at = np.flatnonzero(np.append(True, rows["anchor"][1:] != rows["anchor"][:-1]))
    size = np.diff(np.append(at, len(rows)))
    low = np.minimum.reduceat(rows["low"], at)
    high = np.maximum.reduceat(rows["low"] + rows["more"], at)
    keep = np.repeat(low < high, size)
    rows, several = rows[keep], np.repeat(size > 1, size)[keep]
    return pa.table({"anchor": rows["anchor"].view(np.int64), "cover": rows["cover"].view(np.int64), "low": rows["low"], "several": several})


def _rows_of(window: int, filter_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_var.value, np.uint8)
        for batch in batches:
            for b in blocks(batch, "text"):
                doc, pos, n, anchor, cover, second, p = _spans_of(b, window)
                ok = passes(bits, anchor.view(np.int64))
                doc, pos, n, anchor, cover, p = (x[ok] for x in (doc, pos, n, anchor, cover, p))
                if not len(doc):
                    continue
                to = np.cumsum(n)
                start = np.repeat(p - (to - n), n) + np.arange(int(to[-1]))
                prints = span_hashes(second, start, start + window).tobytes()
                each = pa.array([prints[8 * i : 8 * j] for i, j in zip(to - n, to, strict=True)], pa.binary())
                ids, keys = (pa.array(b.column(k).to_numpy()[doc]) for k in ("doc_id", "key"))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(anchor.view(np.int64)), pa.array(cover.view(np.int64)), pa.array(pos), pa.array(n), each], ["doc_id", "key", "anchor", "cover", "pos", "n", "prints"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.column("n").to_numpy()
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        prints = np.frombuffer(b"".join(b.column("prints").to_pylist()), np.int64)
        doc, key, anchor, pos = (np.repeat(b.column(k).to_numpy(), n) for k in ("doc_id", "key", "anchor", "pos"))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(anchor), pa.array(pos + inside), pa.array(prints)], ["doc_id", "key", "anchor", "pos", "print"])


def _keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, total, removed = [], [], []
        for text, at, n in zip(b.column("text"), b.column("at"), b.column("n"), strict=True):
            words = text.as_py().split()
            total.append(len(words))
            if at.is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                i, k = np.array(at.as_py(), np.int64), np.array(n.as_py(), np.int64)
                np.add.at(edge, i, 1)
                np.add.at(edge, i + k, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                removed.append(0)
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["id", "kept", "n_words", "n_removed"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (a null one is larger than any other), key (a hash of the text, to tell rows with one id apart), text."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text_bytes(text_col).alias("text"), F.col(id_col).alias("id"))


def repeated_stretches(rows: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, key, pos, n): stretches of words of ``rows`` (doc_id, key, text) covered by windows that a row with a smaller doc_id also has."""
    spark, first = rows.sparkSession, len(written())
    # An entry stands for several words, which take some bytes each: so many buckets hold a bounded number of entries.
    bytes_in = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, partitions(spark), bytes_in // 50 // BUCKET_ENTRIES)
    listed = rows.select("doc_id", "text").mapInArrow(tidy(_list_spans(window, buckets)), "bucket int, entries binary")
    shared = materialize(listed.groupBy("bucket").applyInArrow(tidy(_shared), "anchor long, cover long, low long, several boolean"), "shared", release=True)
    filter_var = spark.sparkContext.broadcast(membership_filter(shared.select("anchor")))
    found = rows.select("doc_id", "key", "text").mapInArrow(tidy(_rows_of(window, filter_var)), "doc_id long, key long, anchor long, cover long, pos long, n long, prints binary").join(shared, ["anchor", "cover"])
    again = F.col("low") < F.col("doc_id")
    found = materialize(found.where(again | F.col("several")).select("doc_id", "key", "anchor", "pos", "n", again.alias("again"), F.when(~again, F.col("prints")).alias("prints")), "found", release=True)
    discard(spark, written(first)[:-1])
    whole = found.where("again").select("doc_id", "key", "pos", (F.col("n") + window - 1).alias("n"))
    single = found.where("not again").select("doc_id", "key", "anchor", "pos", "n", "prints").mapInArrow(_windows, "doc_id long, key long, anchor long, pos long, print long")
    least = materialize(single.groupBy("anchor", "print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor", "print", "low"), "windows", release=True)
    return whole.unionByName(single.join(least, ["anchor", "print"]).where("low < doc_id").select("doc_id", "key", "pos", F.lit(window).cast("long").alias("n")))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept (the words that stay, joined by one space), n_words, n_removed of every document.

    Words are runs of anything but ASCII white space, unchanged.  A word goes
    if a window of ``window`` words that covers it also starts in a document
    with a smaller id, a null id being larger than any; repeats inside one
    document, and among rows with equal or null ids, stay.  A null text has
    no words, one of fewer than ``window`` words loses none.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark, first, rows = docs.sparkSession, len(written()), _rows(docs, id_col, text_col)
    cuts = materialize(repeated_stretches(rows, window).groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "n")).alias("cuts")), "cuts", release=True)
    discard(spark, written(first)[:-1])
    joined = rows.join(cuts, ["doc_id", "key"], "left").select("id", "text", F.col("cuts.pos").alias("at"), F.col("cuts.n").alias("n"))
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(tidy(_keep_words), f"id {kind}, kept string, n_words long, n_removed long").withColumnRenamed("id", id_col)
