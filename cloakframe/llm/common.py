"""Helpers that the corpus operators share: tables, the shared folder, byte-level words."""

from __future__ import annotations

import ctypes
import inspect
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator between words here.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Bytes of text that a kernel holds as numpy temporaries at a time.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only if the session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("cloakframe.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("cloakframe.shared.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that ``materialize`` wrote and nobody has discarded yet.
_written: list[str] = []


#: Rows that go to a Python worker at once, at most: they hold texts and sets.
BATCH_ROWS = 2000


#: Whether the shuffle files of a write are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``release``, what the write shuffled is deleted when it ends; else it
    stays until the driver collects its garbage, which may be never.
    """
    spark = df.sparkSession
    path, setting = new_path(spark, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, cleanup = spark.conf.get(setting), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(setting, min(int(before) if int(before) > 0 else BATCH_ROWS, BATCH_ROWS))
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
        spark.conf.set(_CLEANUP, cleanup)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(since: int = 0) -> list[str]:
    return _written[since:]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` wrote; only once nothing that reads them will run again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run: Callable) -> Callable:
    """A kernel that gives freed memory back to the system when it ends: idle workers stay and would hold on to it."""

    def release() -> None:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
            trim(0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    def group_kernel(group: pa.Table) -> pa.Table:
        out = run(group)
        release()
        return out

    return kernel if inspect.isgeneratorfunction(run) else group_kernel


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column; null becomes empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def blocks(batch: pa.RecordBatch, col: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``col`` holds at most ``limit`` bytes (one row at least)."""
    at = batch.column(col)
    if not len(at):
        return
    offsets = _offsets(at)
    start = 0
    while start < len(at):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(at))
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and where each row begins (one more at the end)."""
    offsets = _offsets(arr)
    if arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (one more at the end)."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~gap
    first = word.copy()
    first[1:] &= gap[:-1]
    last = word.copy()
    last[:-1] &= gap[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = 0x9E3779B97F4A7C15 | 1) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each span: a polynomial over well-mixed values, made even by ``mix``."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)]
#: The same bytes with A-Z as a-z.
_LOWER = [np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.roll(t, -32), t) for t in _BYTES]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; ``which`` picks one of two independent functions."""
    out = np.empty(len(starts), np.uint64)
    lut = (_LOWER if lower else _BYTES)[which]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = span_hashes(lut[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


#: Bits of a membership filter (4 MB whatever the data's size), as a power of two.
FILTER_BITS = 25
_SLICES = 16


#: Parts that one task adds up.
FAN_IN = 64


def fold(parts: DataFrame, add: Callable[[pa.Table], bytes]) -> bytes:
    """One table of fixed size out of the tasks' tables, on the driver; empty without parts.

    ``parts`` (slice int, part int, bytes binary) holds each task's slices,
    compressed; ``add`` unites those of a group.  Groups of ``FAN_IN`` parts
    are united level by level, so no task gathers what grows with the input.
    """
    parts = parts.select("slice", "part", "bytes")

    def level(last: bool):
        def run(group: pa.Table) -> pa.Table:
            total = add(group)
            out = total if last else zlib.compress(total, 1)
            return pa.table({"slice": group.column("slice")[:1], "part": group.column("part")[:1], "bytes": pa.array([out], pa.binary())})

        return run

    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        most //= FAN_IN
        parts = parts.groupBy("slice", "part").applyInArrow(level(most == 0), "slice int, part int, bytes binary")
        if not most:
            break
        parts = materialize(parts, "folded")
    return b"".join(bytes(r["bytes"]) for r in sorted(parts.collect(), key=lambda r: r["slice"]))


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [filter_cells(b.column(0).to_numpy()).ravel() for b in batches]
    if sum(map(len, parts)):
        cells = np.unique(np.concatenate(parts))
        at = pa.array([TaskContext.get().partitionId()], pa.int32())
        width = (1 << FILTER_BITS) // _SLICES
        for k, own in enumerate(np.split(cells, np.searchsorted(cells, np.arange(1, _SLICES) * width))):
            bits = np.zeros(width, bool)
            bits[own - k * width] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), at, pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["slice", "part", "bytes"])


def _united(group: pa.Table) -> bytes:
    return np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for c in group.column("bytes").chunks for x in c]).tobytes()


def filter_cells(values: np.ndarray) -> np.ndarray:
    """The cells of each value, a row for each of three hash functions."""
    x = values.view(np.uint64)
    return np.stack([(mix(x ^ salt) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for salt in np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)])


def membership_filter(values: DataFrame) -> bytes:
    """A filter of fixed size over the one long column of ``values``: it never misses one, and lets others by chance pass.

    It only saves work: whatever passes is checked by what follows.
    """
    return fold(materialize(values.mapInArrow(_filter_parts, "slice int, part int, bytes binary"), "filter"), _united) or bytes(1 << (FILTER_BITS - 3))


def only(bits_var, column: str) -> Callable:
    """A kernel that lets rows through whose ``column`` passes the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bits_var.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(passes(bits, b.column(column).to_numpy())))

    return run


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the filter (its bytes as an array) lets through."""
    cell = filter_cells(values)
    return ((bits[cell >> 3] >> (7 - (cell & 7))) & 1 == 1).all(0)
