"""Reading and writing tables by format, many files at a time."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}


def format_of(path: str) -> str:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format of {path}")
    return kind


def sniff(spark: SparkSession, path: str) -> dict[str, str]:
    """Separator and quote by the first lines, read by Spark so that any store will do."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
    found = csv.Sniffer().sniff(head, delimiters=",;\t|")
    return {"sep": found.delimiter, "quote": found.quotechar or '"'}


def read(spark: SparkSession, path: str | Sequence[str], kind: str | None = None, columns: Sequence[str] | None = None, rows: int | None = None, schema: str | None = None, recursive: bool = False, ignore_errors: bool = False, **options) -> DataFrame:
    """A table, by the extension of the path (or ``kind``); paths may be many or hold patterns.

    A schema saves the pass that infers one.  Columns are pruned in the scan.
    """
    paths = [path] if isinstance(path, str) else list(path)
    kind = kind or format_of(paths[0])
    reader = spark.read.options(recursiveFileLookup=recursive, ignoreCorruptFiles=ignore_errors)
    if FORMATS[kind] == "csv":
        options = {"header": True, "sep": "\t" if kind in ("tsv", "txt") else ",", "quote": '"', "escape": '"', **options}
        if schema is None:
            options.setdefault("inferSchema", True)
    if kind == "json":
        options.setdefault("multiLine", True)
    reader = reader.options(**options)
    if schema:
        reader = reader.schema(schema)
    df = reader.format(FORMATS[kind]).load(paths)
    if columns:
        df = df.select(*columns)
    return df.limit(rows) if rows is not None else df


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "error", partition_by: Sequence[str] = (), **options) -> None:
    kind = kind or format_of(path)
    if FORMATS[kind] == "csv":
        options = {"header": True, "sep": "\t" if kind in ("tsv", "txt") else ",", "quote": '"', "escape": '"', **options}
    w = df.write.mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).format(FORMATS[kind]).save(path)


def common_columns(tables: Sequence[DataFrame]) -> list[str]:
    """Columns that all tables have, in the order of the first."""
    shared = reduce(lambda a, b: a & b, [set(t.columns) for t in tables])
    return [c for c in tables[0].columns if c in shared]


def stack(tables: Sequence[DataFrame], all_columns: bool = False) -> DataFrame:
    """All rows; only common columns, or all with nulls where missing."""
    if all_columns:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    names = common_columns(tables)
    return reduce(lambda a, b: a.unionByName(b), [t.select(*names) for t in tables])


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same each time: those whose key hashes lowest."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def read_oriented_json(spark: SparkSession, path: str, orient: str, schema: str) -> DataFrame:
    """JSON of one object: ``columns`` is {column: {row: value}}, ``index`` is {row: {column: value}}; others are read as they are.

    A file is one value here and is parsed by one task, as its form asks.
    """
    fields = spark.createDataFrame([], schema).schema
    if orient not in ("columns", "index"):
        return read(spark, path, "json", schema=schema)
    whole = spark.read.text(path, wholetext=True)
    if orient == "index":
        rows = whole.select(F.explode(F.from_json("value", f"map<string, struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in fields)}>>")))
        return rows.select("value.*")
    parts = whole.select(F.from_json("value", ", ".join(f"`{f.name}` map<string, {f.dataType.simpleString()}>" for f in fields)).alias("o"))
    keys = parts.select("o", F.explode(F.map_keys(F.col("o")[fields[0].name])).alias("k"))
    return keys.select(*[F.try_element_at(F.col("o")[f.name], F.col("k")).alias(f.name) for f in fields])


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in any store that Spark opens, read as a stream."""
    stream = _opened(spark, path)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def encoding_of(spark: SparkSession, path: str, head: int = 65_536) -> str:
    """By the byte order mark, else whether the first bytes are UTF-8, else Windows-1252."""
    stream = _opened(spark, path)
    try:
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, head)))
    finally:
        stream.close()
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if raw.startswith(mark):
            return name
    try:
        raw[: len(raw) - 3].decode("utf-8") if len(raw) == head else raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return "windows-1252"


def file_batches(spark: SparkSession, paths: Sequence[str], most_bytes: int) -> list[list[str]]:
    """Files in their order, in batches of at most ``most_bytes`` (one file at least)."""
    out: list[list[str]] = []
    room = 0
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        if not out or size > room:
            out.append([])
            room = most_bytes
        out[-1].append(path)
        room -= size
    return out


def pick_columns(df: DataFrame, columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Those columns; missing ones are an error, or are left out unless ``strict``."""
    missing = [c for c in columns if c not in df.columns]
    if strict and missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[c for c in columns if c in df.columns])


def merge_json(df: DataFrame, old: str | None, new: str, keys: Sequence[str]) -> None:
    """JSON lines of the table at ``old`` with the rows of ``df`` in place of those with equal keys, written to ``new``.

    Without ``old``, the rows of ``df`` alone.  Plain appending is ``write`` with mode ``append``.
    """
    rows = df
    if old is not None:
        before = df.sparkSession.read.schema(df.schema).json(old)
        rows = before.join(df.select(*keys), list(keys), "left_anti").select(*df.columns).unionByName(df)
    rows.write.json(new)


def encrypt_files(spark: SparkSession, paths: str | Sequence[str], out: str, key: bytes) -> None:
    """Whole files by AES-GCM, a row for each: name, size, content.  A file must fit a cell (2 GB)."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.aes_encrypt("content", F.lit(key)).alias("content")).write.parquet(out)


def decrypt_files(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """(name, size, content) of files that ``encrypt_files`` wrote."""
    return spark.read.parquet(path).withColumn("content", F.aes_decrypt("content", F.lit(key)))


def write_task_output(df: DataFrame, folder: str, name: str, metrics: dict | None = None) -> dict:
    """The table under ``folder``/output and a manifest (a one-row JSON table) beside it."""
    path = f"{folder}/output/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    manifest = {"name": name, "path": path, "columns": df.columns, "metrics": metrics or {}}
    df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest/{name}")
    return manifest


def chunks(df: DataFrame, n: int, key: str) -> Iterator[DataFrame]:
    """The table in ``n`` parts by a hash of ``key``, one after another; each is a lazy table of its own."""
    for k in range(n):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)


def encrypt_columns(df: DataFrame, fields: Sequence[str], key: bytes) -> DataFrame:
    for f in fields:
        df = df.withColumn(f, F.base64(F.aes_encrypt(F.col(f).cast("string").cast("binary"), F.lit(key))))
    return df


def decrypt_columns(df: DataFrame, fields: Sequence[str], key: bytes) -> DataFrame:
    for f in fields:
        df = df.withColumn(f, F.aes_decrypt(F.unbase64(f), F.lit(key)).cast("string"))
    return df
