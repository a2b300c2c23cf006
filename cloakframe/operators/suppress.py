"""Suppression of columns, rows and cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conditions import condition


def suppress_columns(df: DataFrame, fields: Sequence[str], where: Column | None = None) -> DataFrame:
    """Without the columns; with ``where``, only rows that pass stay as well."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return (df if where is None else df.where(where)).drop(*fields)


def record_mask(field: str, kind: str = "null", values: Sequence[Any] = (), threshold: float = 5) -> Column:
    """Rows to remove: null, value, range, risk (k below threshold)."""
    if kind == "null":
        return F.col(field).isNull()
    if kind == "value":
        return condition(field, "in", values)
    if kind == "range":
        return condition(field, "range", values)
    if kind == "risk":
        return condition(field, "lt", [threshold])
    raise ValueError(f"unknown kind {kind}")


def suppress_records(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def suppressed_records(df: DataFrame, where: Column, reason: str) -> DataFrame:
    """The removed rows with the reason."""
    return df.where(F.coalesce(where, F.lit(False))).withColumn("suppression_reason", F.lit(reason))


def outlier_mask(df: DataFrame, field: str, method: str = "iqr", factor: float | None = None) -> Column:
    """Cells beyond ``factor`` interquartile ranges (1.5) or standard deviations (3); none with fewer than three values or no spread."""
    x = F.col(field).cast("double")
    if method == "iqr":
        r = df.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(x).alias("n")).first()
        if r["n"] < 3 or r["q"][0] == r["q"][1]:
            return F.lit(False)
        width = (r["q"][1] - r["q"][0]) * (1.5 if factor is None else factor)
        return F.coalesce((x < r["q"][0] - width) | (x > r["q"][1] + width), F.lit(False))
    r = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if not r["s"]:
        return F.lit(False)
    return F.coalesce(F.abs(x - r["m"]) / r["s"] > (3.0 if factor is None else factor), F.lit(False))


def suppress_cells(
    df: DataFrame, field: str, where: Column | str = "null", strategy: str = "null", value: Any = None, group: str | None = None, least: int = 10, min_group: int = 5, output: str | None = None
) -> DataFrame:
    """Cells that ``where`` marks (a column, or outlier / zscore / rare / null) replaced.

    Strategies: null, constant, mean, median, mode (smallest on ties),
    group_mean and group_mode (of the row's ``group`` if it has ``min_group``
    values or rows, else of all).  Statistics count the suppressed cells too.
    """
    x = F.col(field)
    if isinstance(where, str) and where == "rare":
        counts = df.where(x.isNotNull()).groupBy(x.alias("__v")).agg(F.count("*").alias("__n")).where(F.col("__n") < least)
        df = df.join(counts, df[field] == counts["__v"], "left").withColumn("__hit", F.col("__n").isNotNull()).drop("__v", "__n")
    else:
        mask = where if isinstance(where, Column) else {"null": lambda: x.isNull(), "outlier": lambda: outlier_mask(df, field), "zscore": lambda: outlier_mask(df, field, "zscore")}[where]()
        df = df.withColumn("__hit", F.coalesce(mask, F.lit(False)))
    if strategy == "null":
        new = F.lit(None)
    elif strategy == "constant":
        new = F.lit(value)
    elif strategy in ("mean", "median", "mode"):
        stat = {"mean": F.avg(field), "median": F.median(field), "mode": F.mode(field, True)}[strategy]
        new = F.lit(df.agg(stat.alias("v")).first()["v"])
    elif strategy == "group_mean":
        w = Window.partitionBy(group)
        new = F.when(F.count(field).over(w) >= min_group, F.avg(field).over(w)).otherwise(F.lit(df.agg(F.avg(field).alias("v")).first()["v"]))
    elif strategy == "group_mode":
        stats = df.groupBy(F.col(group).alias("__g")).agg(F.mode(field, True).alias("__mode"), F.count("*").alias("__rows"))
        df = df.join(stats, df[group].eqNullSafe(stats["__g"]), "left")
        new = F.when(F.col("__rows") >= min_group, F.col("__mode")).otherwise(F.lit(df.agg(F.mode(field, True).alias("v")).first()["v"]))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return df.withColumn(output or field, F.when(F.col("__hit"), new).otherwise(x)).drop("__hit", "__g", "__mode", "__rows")


def suppression_report(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """A row for each reason: rows it suppresses, and their share, in one scan."""
    cells = [F.struct(F.lit(r).alias("reason"), F.count_if(F.coalesce(m, F.lit(False))).alias("rows"), F.round(F.avg(F.coalesce(m, F.lit(False)).cast("double")), 6).alias("share")).alias(f"__{i}") for i, (r, m) in enumerate(masks.items())]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(masks))])).alias("x")).select("x.*")
