"""Pseudonyms: salted hashes, keyed hashes, persistent one-to-one maps."""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conditions import composite_key
from .ordered import places

# The alphabet of base 58.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def sha2_pseudonym(df: DataFrame, field: str, salt: str = "", bits: int = 256, length: int | None = None, prefix: str = "", output: str | None = None) -> DataFrame:
    """Hex SHA-2 of the text and the salt; nulls stay null."""
    h = F.sha2(F.concat(F.col(field).cast("string"), F.lit(salt)).cast("binary"), bits)
    return df.withColumn(output or field, F.concat(F.lit(prefix), F.substring(h, 1, length) if length else h))


def base58(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def sha3_pseudonym(df: DataFrame, field: str, salt: bytes = b"", pepper: bytes | None = None, bits: int = 256, encoding: str = "hex", output: str | None = None) -> DataFrame:
    """SHA-3 of text and salt, hashed again with the pepper if there is one; encodings hex, base64, base32, base58."""
    code = {"hex": bytes.hex, "base64": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="), "base32": lambda b: base64.b32encode(b).decode().rstrip("="), "base58": base58}[encoding]
    name = f"sha3_{bits}"

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None:
                return None
            h = hashlib.new(name, v.encode() + salt).digest()
            return code(h if pepper is None else hashlib.new(name, h + pepper).digest())

        return values.map(one, na_action=None)

    return df.withColumn(output or field, digest(F.col(field).cast("string")))


def _xor_block(key: bytes, pad: int) -> bytes:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ pad for b in block)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex, composed of two SHA-2 calls so that it stays in the JVM."""
    inner = F.unhex(F.sha2(F.concat(F.lit(_xor_block(key, 0x36)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(_xor_block(key, 0x5C)), inner), 256)


def hmac_pseudonym(df: DataFrame, field: str, key: bytes, domain: str = "", output: str | None = None) -> DataFrame:
    """The first 16 bytes of the HMAC of ``domain:value``, in hex."""
    return df.withColumn(output or field, F.substring(hmac_sha256(F.concat(F.lit(f"{domain}:"), F.col(field).cast("string")), key), 1, 32))


def sequential_map(df: DataFrame, field: str, known: DataFrame | None = None, prefix: str = "ID", digits: int = 6) -> DataFrame:
    """(original, pseudonym): known pairs stay, new values are numbered on, in their order, from the greatest known number.

    Numbers are padded to ``digits`` digits and grow beyond them.
    """
    values = df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("original")).distinct()
    start = 0
    if known is not None:
        start = known.agg(F.max(F.regexp_extract("pseudonym", r"([0-9]+)$", 1).try_cast("long")).alias("n")).first()["n"] or 0
        values = values.join(known, "original", "left_anti")
    numbered = places(values, [F.col("original")], "number").select("original", (F.col("number") + start).cast("string").alias("number"))
    number = F.when(F.length("number") < digits, F.lpad("number", digits, "0")).otherwise(F.col("number"))
    new = numbered.select("original", F.concat(F.lit(f"{prefix}_" if prefix else ""), number).alias("pseudonym"))
    return new if known is None else known.select("original", "pseudonym").unionByName(new)


def hashed_map(df: DataFrame, field: str, salt: str, kind: str = "uuid") -> DataFrame:
    """(original, pseudonym) without an order: a UUID-like or random-looking text from a salted hash."""
    values = df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("original")).distinct()
    h = F.sha2(F.concat(F.col("original"), F.lit(salt)).cast("binary"), 256)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return values.select("original", (uuid if kind == "uuid" else F.substring(h, 1, 12)).alias("pseudonym"))


def apply_map(df: DataFrame, field: str, mapping: DataFrame, output: str | None = None) -> DataFrame:
    m = mapping.select(F.col("original").alias("__o"), F.col("pseudonym").alias("__p"))
    out = df.join(m, F.col(field).cast("string") == F.col("__o"), "left")
    names = [c for c in df.columns if c != (output or field)]
    return out.select(*names, F.col("__p").alias(output or field))


def reverse_map(df: DataFrame, field: str, mapping: DataFrame, output: str | None = None) -> DataFrame:
    return apply_map(df, field, mapping.select(F.col("pseudonym").alias("original"), F.col("original").alias("pseudonym")), output)


def save_map(mapping: DataFrame, path: str, key: bytes) -> None:
    """Originals encrypted by AES-GCM under a key of 16, 24 or 32 bytes."""
    mapping.select(F.aes_encrypt(F.col("original").cast("binary"), F.lit(key)).alias("original"), "pseudonym").write.mode("overwrite").parquet(path)


def load_map(spark, path: str, key: bytes) -> DataFrame:
    return spark.read.parquet(path).select(F.aes_decrypt(F.col("original"), F.lit(key)).cast("string").alias("original"), "pseudonym")


def compound_pseudonym(df: DataFrame, fields: Sequence[str], salt: str = "", separator: str = "|", output: str = "compound_id") -> DataFrame:
    """One pseudonym for several fields, of which all but the first become null."""
    key = composite_key(fields, separator, "replace")
    out = df.withColumn(output, F.sha2(F.concat(key, F.lit(salt)).cast("binary"), 256))
    for f in fields[1:]:
        out = out.withColumn(f, F.lit(None).cast(df.schema[f].dataType))
    return out


def collision_probability(n: int, bits: int) -> float:
    """The birthday bound."""
    return -math.expm1(-n * (n - 1) / 2 / 2.0**bits)


def collisions(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("pseudonym").agg(F.count_distinct("original").alias("originals")).where("originals > 1")


def save_salts(spark, salts: dict[str, str], path: str, key: bytes) -> None:
    """A salt for each field, encrypted by AES-GCM."""
    rows = spark.createDataFrame(sorted(salts.items()), "field string, salt string")
    rows.select("field", F.aes_encrypt(F.col("salt").cast("binary"), F.lit(key)).alias("salt")).write.mode("overwrite").parquet(path)


def load_salts(spark, path: str, key: bytes) -> dict[str, str]:
    rows = spark.read.parquet(path).select("field", F.aes_decrypt("salt", F.lit(key)).cast("string").alias("salt")).collect()
    return {r["field"]: r["salt"] for r in rows}


def salted_pseudonyms(df: DataFrame, salts: dict[str, str], pepper: str = "") -> DataFrame:
    """Each field hashed with a salt of its own and one pepper (HMAC-SHA-256 under the pepper, if there is one)."""
    for f, salt in salts.items():
        text = F.concat(F.col(f).cast("string"), F.lit(salt))
        df = df.withColumn(f, hmac_sha256(text, pepper.encode()) if pepper else F.sha2(text.cast("binary"), 256))
    return df
