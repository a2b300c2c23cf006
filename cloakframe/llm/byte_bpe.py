"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap.  Each chunk
is pre-tokenised on its own, anywhere in the cluster.  Pre-tokenisation has no
memory: what follows a boundary depends only on the text after it.  So where a
boundary of one chunk is a boundary of the next too, both agree from there on
and are stitched; where an overlap holds no common boundary, scanning goes on
from the last sure one until it meets the next chunk's.  The pieces are then
encoded, and decoding concatenates the raw bytes of the ids.

A match is sure if it ends before its chunk does, with one character to spare
for the pattern's look-ahead.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and how far it reaches into the next.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
#: Pieces that a worker remembers with their ids.
CACHE_PIECES = 200_000


class Codec:
    """Ids of pieces by a rank file, remembered in a bounded cache, and bytes of ids."""

    class _Cache(dict):
        def __init__(self, encode):
            self.encode = encode

        def __missing__(self, piece: str) -> bytes:
            ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
            if len(self) >= CACHE_PIECES:
                self.clear()
            if len(piece) <= 64:
                self[piece] = ids
            return ids

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = self._Cache(core.encode_single_piece)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def boundaries(pattern: regex.Pattern, chunk: str, last: bool) -> np.ndarray:
    """Starts of the sure matches of a chunk and the end of the last of them."""
    starts = [0]
    for m in pattern.finditer(chunk):
        if not last and m.end() >= len(chunk) - 1:
            break
        starts.append(m.end())
    return np.array(starts, np.int64)


def stitch(pattern: regex.Pattern, chunks: list[str], found: list[np.ndarray], chunk_chars: int) -> list[str]:
    """The pre-tokens of the text whose overlapping ``chunks`` have the boundaries ``found``."""
    text = "".join([c[:chunk_chars] for c in chunks[:-1]] + [chunks[-1]])
    cuts = [found[0]]
    end = int(found[0][-1])
    for k in range(1, len(chunks)):
        there = found[k] + k * chunk_chars
        behind = cuts[-1]
        common = np.intersect1d(behind[behind >= there[0]], there, assume_unique=True)
        if len(common):
            meet = int(common[0])
            cuts[-1] = behind[behind < meet]
        else:
            scanned, reached = [], set(there.tolist())
            while end < len(text) and end not in reached:
                m = pattern.match(text, end)
                end = m.end()
                scanned.append(end)
            cuts.append(np.array(scanned[:-1] if end in reached and scanned else scanned, np.int64))
            if end not in reached:
                break
            if not scanned:
                cuts[-2] = cuts[-2][cuts[-2] < end]
            meet = end
        rest = there[there >= meet]
        cuts.append(rest)
        end = int(rest[-1])
    at = np.concatenate(cuts).tolist()
    return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _row(c: Codec, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def _columns(ids: pa.Array, rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no tokens and the digests of nothing.  Rows with
    equal ids are encoded each on its own; other columns are ignored; an empty
    table gives an empty result.  ``rank_file`` must exist on every executor.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            yield _columns(b.column(0), [_row(c, c.encode(t.as_py())) for t in b.column(1)])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = codec(rank_file, pattern).pattern
        for b in batches:
            cuts = [boundaries(p, t.as_py(), x.as_py()).tobytes() for t, x in zip(b.column("chunk"), b.column("last"), strict=True)]
            yield b.append_column("cuts", pa.array(cuts, pa.binary()))

    def join_up(group: pa.Table) -> pa.Table:
        c = codec(rank_file, pattern)
        group = group.sort_by("k")
        found = [np.frombuffer(x, np.int64) for x in group.column("cuts").to_pylist()]
        ids = c.encode_pieces(stitch(c.pattern, group.column("chunk").to_pylist(), found, chunk_chars))
        return pa.Table.from_batches([_columns(group.column("doc_id").combine_chunks()[:1], [_row(c, ids)])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # A chunk more than overlaps would end inside its predecessor's overlap, so the count rounds down from there.
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(chunk_chars))).cast("int")
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, _RESULT)
    long = (
        rows.where(F.length("text") > chunk_chars)
        .select("doc_id", F.monotonically_increasing_id().alias("row"), "text", n.alias("n"))
        .select("doc_id", "row", "text", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .select("doc_id", "row", "k", (F.col("k") == F.col("n") - 1).alias("last"), F.expr(f"substring(text, k * {chunk_chars} + 1, {chunk_chars + overlap})").alias("chunk"))
        .repartition("doc_id", "row", "k")
        .mapInArrow(mark, "doc_id long, row long, k int, last boolean, chunk string, cuts binary")
        .groupBy("doc_id", "row")
        .applyInArrow(join_up, _RESULT)
    )
    return short.unionByName(long).withColumnRenamed("doc_id", id_col)


def _ids_of(rank_file: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            ids = [None if t is None else np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>); a null text stays null."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_ids_of(rank_file, pattern), f"`{id_col}` {kind}, ids array<int>")


def decode(ids: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the raw bytes of the ids one after another; null stays null, an unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            raw = [None if x is None else b"".join(c.bytes_of[i] for i in x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [b.schema.names[0], "bytes"])

    kind = ids.schema[id_col].dataType.simpleString()
    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")
