"""Noise on numbers and times, and the mechanisms of differential privacy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(lo: float, hi: float, seed: int) -> Column:
    return F.rand(seed) * (hi - lo) + lo


def laplace(scale: float, seed: int) -> Column:
    """By the inverse of its distribution function."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def noise(kind: str, seed: int, scale: float = 1.0, limits: tuple[float, float] = (-1.0, 1.0)) -> Column:
    return {"uniform": lambda: uniform(*limits, seed), "normal": lambda: F.randn(seed) * scale, "laplace": lambda: laplace(scale, seed)}[kind]()


def uniform_numeric_noise(
    df: DataFrame, field: str, limits: float | tuple[float, float], multiply: bool = False, scale: float = 1.0, by_std: bool = False, clip: tuple[float | None, float | None] = (None, None),
    decimals: int | None = None, keep_zero: bool = False, seed: int = 42, output: str | None = None,
) -> DataFrame:
    """x + n, or x (1 + n), with n uniform in the limits; then clipped and rounded.  Nulls stay null."""
    lo, hi = (-limits, limits) if isinstance(limits, (int, float)) else limits
    x = F.col(field).cast("double")
    if by_std:
        scale *= df.agg(F.stddev_samp(x).alias("s")).first()["s"] or 1.0
    n = uniform(lo, hi, seed) * scale
    new = x * (1 + n) if multiply else x + n
    if clip[0] is not None:
        new = F.greatest(new, F.lit(float(clip[0])))
    if clip[1] is not None:
        new = F.least(new, F.lit(float(clip[1])))
    if decimals is not None:
        new = F.bround(new, decimals)
    new = F.when(x.isNotNull(), new)
    return df.withColumn(output or field, F.when(x == 0, x).otherwise(new) if keep_zero else new)


def uniform_temporal_noise(
    df: DataFrame, field: str, seconds: float, direction: str = "both", bounds: tuple[datetime | None, datetime | None] = (None, None), special: Sequence[datetime] = (), keep_weekend: bool = False, seed: int = 42, output: str | None = None
) -> DataFrame:
    """Times shifted by up to ``seconds``; special days stay, and a weekend day stays one by moving up to three days on."""
    x = F.col(field).cast("timestamp")
    lo, hi = {"both": (-seconds, seconds), "forward": (0.0, seconds), "backward": (-seconds, 0.0)}[direction]
    new = F.timestamp_micros(F.unix_micros(x) + (uniform(lo, hi, seed) * 1_000_000).cast("long"))
    if bounds[0]:
        new = F.greatest(new, F.lit(bounds[0]).cast("timestamp"))
    if bounds[1]:
        new = F.least(new, F.lit(bounds[1]).cast("timestamp"))
    if keep_weekend:
        was = F.weekday(x) >= 5
        df, new_name = df.withColumn("__new", new), "__new"
        new = F.col(new_name)
        moved = F.when((F.weekday(new) >= 5) == was, new)
        for d in (1, -1, 2, -2, 3, -3):
            there = F.timestamp_micros(F.unix_micros(new) + d * 86_400_000_000)
            moved = moved.when((F.weekday(there) >= 5) == was, there)
        new = moved.otherwise(new)
    if special:
        new = F.when(F.to_date(x).isin([s.date() if isinstance(s, datetime) else s for s in special]), x).otherwise(new)
    return df.withColumn(output or field, F.when(x.isNotNull(), new).cast(df.schema[field].dataType)).drop("__new")


def differential_privacy(df: DataFrame, fields: Sequence[str], epsilon: float, sensitivity: float = 1.0, mechanism: str = "laplace", delta: float | None = None, seed: int = 42) -> DataFrame:
    """Laplace noise of scale sensitivity / epsilon, or Gaussian noise with sigma = sqrt(2 ln(1.25 / delta)) sensitivity / epsilon (delta 1 by default)."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    for k, f in enumerate(fields):
        x = F.col(f).cast("double")
        n = laplace(sensitivity / epsilon, seed + k) if mechanism == "laplace" else F.randn(seed + k) * math.sqrt(2 * math.log(1.25 / (delta or 1.0))) * sensitivity / epsilon
        df = df.withColumn(f, x + n)
    return df


def noise_impact(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: bias, mae, rmse, max_error, correlation, snr_db (population variances)."""
    x, y = F.col(before).cast("double"), F.col(after).cast("double")
    e = y - x
    return df.where(x.isNotNull() & y.isNotNull()).agg(
        F.round(F.avg(e), 6).alias("bias"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.max(F.abs(e)), 6).alias("max_error"),
        F.round(F.corr(x, y), 6).alias("correlation"), F.round(10 * F.log10(F.try_divide(F.var_pop(x), F.var_pop(e))), 6).alias("snr_db"),
    )


def suggested_range(df: DataFrame, field: str, snr: float = 10.0, kind: str = "uniform", multiply: bool = False) -> float:
    """Width of noise for a signal-to-noise ratio."""
    r = df.agg(F.stddev_samp(field).alias("s"), F.avg(field).alias("m")).first()
    s = (r["s"] or 0.0) / math.sqrt(snr)
    width = {"uniform": s * math.sqrt(12), "laplace": s / math.sqrt(2), "normal": s}[kind]
    return width / abs(r["m"]) if multiply and r["m"] else width


def keyed_uniform(key: Sequence[Column], seed: int) -> Column:
    """From 0 to below 1 by a hash of the row's key: the same on every run, engine and partitioning."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def keyed_noise(df: DataFrame, field: str, key: Sequence[str], kind: str = "uniform", width: float = 1.0, decimals: int | None = None, seed: int = 42, output: str | None = None) -> DataFrame:
    """x + n, where n depends on the row's key alone.

    kinds: uniform (from -width to width), laplace (scale width), normal (deviation width, by Box and Muller).
    """
    x, at = F.col(field).cast("double"), [F.col(k) for k in key]
    u = keyed_uniform(at, seed)
    if kind == "uniform":
        n = (2 * u - 1) * width
    elif kind == "laplace":
        n = -width * F.signum(u - 0.5) * F.log(F.greatest(1 - 2 * F.abs(u - 0.5), F.lit(1e-15)))
    elif kind == "normal":
        n = width * F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-15)))) * F.cos(2 * math.pi * keyed_uniform(at, seed + 1))
    else:
        raise ValueError(f"unknown kind {kind}")
    return df.withColumn(output or field, x + n if decimals is None else F.round(x + n, decimals))


def keyed_shift(df: DataFrame, field: str, key: Sequence[str], days: int, seed: int = 42, output: str | None = None) -> DataFrame:
    """Times moved by whole days, from ``-days`` to ``days``, by the row's key alone."""
    n = F.floor(keyed_uniform([F.col(k) for k in key], seed) * (2 * days + 1)) - days
    return df.withColumn(output or field, (F.col(field) + F.make_dt_interval(n.cast("int"))).cast(df.schema[field].dataType))


def noise_uniformity(df: DataFrame, before: str, after: str, width: float, bins: int = 10) -> DataFrame:
    """One row: chi-square of the differences over ``bins`` equal bins from -width to width, and its distance from the mean in deviations."""
    e = (F.col(after) - F.col(before)).cast("double")
    at = F.least(F.greatest(F.floor((e + width) / (2 * width / bins)), F.lit(0)), F.lit(bins - 1))
    c = df.where(e.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    # Empty bins add nothing but their expectation, so only the sum of squares is needed.
    s = c.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    chi = F.col("s2") * bins / F.col("t") - F.col("t")
    return s.select(F.col("t").cast("long").alias("n"), F.round(chi, 4).alias("chi2"), F.round((chi - (bins - 1)) / math.sqrt(2 * (bins - 1)), 4).alias("z"))


def temporal_impact(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: rows, mean and greatest shift in days, shares whose weekday, month and weekend stay."""
    x, y = F.col(before), F.col(after)
    shift = (F.unix_micros(y.cast("timestamp")) - F.unix_micros(x.cast("timestamp"))) / 86_400_000_000
    same = lambda f: F.round(F.avg((f(x) == f(y)).cast("double")), 6)
    return df.where(x.isNotNull() & y.isNotNull()).agg(
        F.count("*").alias("n"), F.round(F.avg(shift), 6).alias("mean_days"), F.round(F.max(F.abs(shift)), 6).alias("max_days"), same(F.weekday).alias("weekday_kept"), same(F.month).alias("month_kept"), same(lambda c: F.weekday(c) >= 5).alias("weekend_kept")
    )
