"""Row conditions: single and several fields, risk thresholds, composite keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("in", "not_in", "eq", "ne", "gt", "lt", "ge", "le", "range", "all")


def condition(field: str, operator: str = "in", values: Sequence[Any] | None = None) -> Column:
    """A boolean column without nulls.  A null field fails every test but ``ne`` and ``not_in``."""
    col = F.col(field)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    if operator == "all" or operator == "in" and values is None:
        return F.lit(True)
    if not values:
        raise ValueError(f"operator {operator} needs values")
    if operator in ("in", "not_in"):
        hit = F.coalesce(col.isin(list(values)), F.lit(False))
        return hit if operator == "in" else ~hit
    if operator == "range":
        return F.coalesce(col.between(values[0], values[1]), F.lit(False))
    if operator == "ne":
        return F.coalesce(col != F.lit(values[0]), F.lit(True))
    x = F.lit(values[0])
    return F.coalesce({"eq": col == x, "gt": col > x, "lt": col < x, "ge": col >= x, "le": col <= x}[operator], F.lit(False))


def conditions(tests: Sequence[dict[str, Any]], logic: str = "and") -> Column:
    """Several tests ({field, operator, values}) joined by ``and`` or ``or``."""
    parts = [condition(t["field"], t.get("operator", "in"), t.get("values")) for t in tests]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if logic.lower() == "and" else (lambda a, b: a | b), parts)


def apply_where(df: DataFrame, field: str, new: Column, where: Column | None = None, output: str | None = None, scope: str = "case") -> DataFrame:
    """``field`` (or a new column) replaced by ``new`` in the rows that pass ``where``.

    scope ``case`` keeps the other rows unchanged, ``filter`` leaves only rows that pass.
    """
    if where is None:
        return df.withColumn(output or field, new)
    if scope == "filter":
        return df.where(where).withColumn(output or field, new)
    return df.withColumn(output or field, F.when(where, new).otherwise(F.col(field).cast(df.select(new.alias("x")).schema["x"].dataType)))


def composite_key(fields: Sequence[str], separator: str = "_", nulls: str = "skip", digest: str | None = None) -> Column:
    """Fields joined into one text.  nulls: ``skip`` (any null gives null), ``include`` (left out), ``replace`` (the text NULL)."""
    texts = [F.col(f).cast("string") for f in fields]
    if nulls == "replace":
        texts = [F.coalesce(t, F.lit("NULL")) for t in texts]
    key = F.concat_ws(separator, *texts)
    if nulls == "skip":
        key = F.when(reduce(lambda a, b: a & b, [t.isNotNull() for t in texts]), key)
    if digest:
        key = {"md5": F.md5, "sha1": F.sha1}[digest](key.cast("binary")) if digest in ("md5", "sha1") else F.sha2(key.cast("binary"), 256)
    return key


def reversible_key(fields: Sequence[str]) -> Column:
    return F.base64(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).cast("binary"))


def open_reversible_key(key: str, schema: str) -> Column:
    return F.from_json(F.unbase64(key).cast("string"), schema)


def vulnerable_rows(df: DataFrame, risk_field: str, threshold: float, field: str, strategy: str = "suppress", value: Any = None) -> DataFrame:
    """Rows whose k lies below ``threshold``: removed, or their ``field`` changed.

    Strategies: remove, suppress (null), mean and mode (of the safe rows), mask
    (two characters at either end stay), full_mask, custom (``value``).
    """
    risky = F.coalesce(F.col(risk_field) < threshold, F.lit(False))
    if strategy == "remove":
        return df.where(~risky)
    text = F.col(field).cast("string")
    if strategy in ("mean", "mode"):
        safe = df.where(~risky).agg((F.avg(field) if strategy == "mean" else F.mode(field, True)).alias("v")).first()["v"]
        return df.withColumn(field, F.when(risky, F.lit(safe)).otherwise(F.col(field)))
    if strategy == "mask":
        masked = F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), F.length(text) - 4), F.expr(f"right(cast(`{field}` as string), 2)"))).otherwise(F.repeat(F.lit("*"), F.length(text)))
        return df.withColumn(field, F.when(risky, masked).otherwise(text))
    if strategy == "full_mask":
        return df.withColumn(field, F.when(risky, F.lit("*****")).otherwise(text))
    new = F.lit(None) if strategy == "suppress" else F.lit(value)
    return df.withColumn(field, F.when(risky, new).otherwise(F.col(field)))


#: Risk bands by k and what is done to each: upper bound of k, strategy.
ADAPTIVE_BANDS = ((2, "suppress"), (5, "full_mask"), (10, "mask"))


def adaptive(df: DataFrame, risk_field: str, field: str, bands: Sequence[tuple[float, str]] = ADAPTIVE_BANDS) -> DataFrame:
    """``field`` changed by the first band whose bound lies above the row's k; safer rows stay."""
    text = F.col(field).cast("string")
    out = text
    for bound, strategy in reversed(list(bands)):
        if strategy == "mask":
            new = F.when(F.length(text) > 4, F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), F.length(text) - 4), F.expr(f"right(cast(`{field}` as string), 2)"))).otherwise(F.repeat(F.lit("*"), F.length(text)))
        else:
            new = {"suppress": F.lit(None).cast("string"), "full_mask": F.lit("*****")}[strategy]
        out = F.when(F.col(risk_field) < bound, new).otherwise(out)
    return df.withColumn(field, out)


def risk_filtered(df: DataFrame, risk_field: str, operator: str, threshold: float, where: Column | None = None) -> DataFrame:
    """Rows whose risk passes ``operator`` (ge, gt, le, lt) against ``threshold`` and that pass ``where``."""
    test = condition(risk_field, operator, [threshold])
    return df.where(test if where is None else test & F.coalesce(where, F.lit(False)))
