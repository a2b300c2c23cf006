"""Generalization of numbers, dates and categories.

Steps that need statistics of the whole column compute them in one aggregate
(a few scalars reach the driver); the change itself is an expression, so it
stays in whole-stage code and also runs on streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import places


def _text(x: float, whole: bool) -> str:
    return str(int(x)) if whole else f"{x:.2f}"


def label_bins(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (a, b] of each value, the lowest edge included; outside and null give null."""
    out = F.when(col < edges[0], None)
    for hi, label in zip(edges[1:], labels, strict=True):
        out = out.when(col <= hi, label)
    return out.otherwise(None)


def _bins(df: DataFrame, field: str, edges: list[float], output: str | None, whole: bool) -> DataFrame:
    labels = [f"{_text(a, whole)}-{_text(b, whole)}" for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return df.withColumn(output or field, label_bins(F.col(field).cast("double"), edges, labels))


def equal_width(df: DataFrame, field: str, bins: int = 10, output: str | None = None) -> DataFrame:
    """``bins`` bins of equal width from the least to the greatest value, labelled ``low-high``."""
    x = F.col(field).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.bool_and(x == F.floor(x)).alias("whole")).first()
    if r["lo"] is None:
        return df.withColumn(output or field, F.lit(None).cast("string"))
    lo, hi, whole = r["lo"], r["hi"], bool(r["whole"])
    if lo == hi:
        return df.withColumn(output or field, F.when(x.isNotNull(), f"{_text(lo, whole)}-{_text(hi, whole)}"))
    step = (hi - lo) / bins
    edges = [lo + k * step for k in range(bins)] + [hi + 0.001]
    return _bins(df, field, edges, output, whole)


def equal_frequency(df: DataFrame, field: str, bins: int = 10, output: str | None = None) -> DataFrame:
    """Bins between quantiles (linear interpolation); equal edges are merged."""
    x = F.col(field).cast("double")
    r = df.agg(F.percentile(x, F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("q"), F.bool_and(x == F.floor(x)).alias("whole")).first()
    if not r["q"] or r["q"][0] is None:
        return df.withColumn(output or field, F.lit(None).cast("string"))
    edges = sorted(set(r["q"]))
    if len(edges) == 1:
        edges = edges * 2
    edges[-1] += 0.001
    return _bins(df, field, edges, output, bool(r["whole"]))


def round_numbers(df: DataFrame, field: str, precision: int = 0, output: str | None = None) -> DataFrame:
    """Half-to-even rounding: to decimals, or for a negative precision to a power of ten."""
    x = F.col(field).cast("double")
    f = float(10 ** max(0, -precision))
    return df.withColumn(output or field, F.bround(x, precision) if precision >= 0 else F.bround(x / f) * f)


def ranges(df: DataFrame, field: str, limits: Sequence[tuple[float, float]], output: str | None = None) -> DataFrame:
    """One range: ``<a``, ``a-b`` (closed below), ``>=b``.  Several: right-closed bins between their lower bounds."""
    x = F.col(field)
    if len(limits) == 1:
        a, b = limits[0]
        new = F.when(x < a, f"<{a}").when(x < b, f"{a}-{b}").when(x >= b, f">={b}")
        return df.withColumn(output or field, new)
    new = F.when(x <= limits[0][0], f"<{limits[0][0]}")
    for k, (a, b) in enumerate(limits):
        top = limits[k + 1][0] if k + 1 < len(limits) else b
        new = new.when(x <= top, f"{a}-{b}")
    return df.withColumn(output or field, new.when(x > limits[-1][1], f">={limits[-1][1]}"))


UNITS = ("year", "quarter", "month", "week", "day", "hour")


def truncate_dates(df: DataFrame, field: str, unit: str = "month", pattern: str | None = None, output: str | None = None) -> DataFrame:
    """Down to the unit (weeks begin on Monday), optionally as text by a Java date pattern."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    x = F.date_trunc(unit, F.col(field))
    return df.withColumn(output or field, F.date_format(x, pattern) if pattern else x)


def bin_dates(df: DataFrame, field: str, kind: str, interval: int = 7, reference: datetime | None = None, edges: Sequence[tuple[datetime, str]] = (), output: str | None = None) -> DataFrame:
    """kinds: hour_range, day_range, business_period, seasonal, custom ((upper bound, label) pairs; the first bound opens)."""
    x = F.col(field)
    h = F.hour(x)
    if kind == "hour_range":
        top = F.greatest(F.lit(1), F.ceil(h / F.lit(float(interval)))).cast("int") * interval
        new = F.when(x.isNotNull(), F.format_string("%02d:00-%02d:00", top - interval, F.least(top, F.lit(24))))
    elif kind == "day_range":
        start = reference or df.agg(F.min(x).alias("m")).first()["m"]
        days = F.floor((F.unix_micros(x.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(86_400_000_000))
        low = (F.ceil(days / F.lit(float(interval))) - 1) * interval
        low = F.when(days == 0, F.lit(0)).otherwise(low) if reference is None else low
        new = F.when(x.isNotNull(), F.format_string("Day %d-%d", low.cast("long"), (low + interval).cast("long")))
    elif kind == "business_period":
        new = F.when((h >= 6) & (h < 12), "Morning").when((h >= 12) & (h < 18), "Afternoon").when(h.isNotNull(), "Night")
    elif kind == "seasonal":
        m = F.month(x)
        new = F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").when(m.isNotNull(), "Fall")
    elif kind == "custom":
        bounds = sorted(edges)
        new = F.when(x <= F.lit(bounds[0][0]), None)
        for bound, label in bounds[1:]:
            new = new.when(x <= F.lit(bound), label)
    else:
        raise ValueError(f"unknown kind {kind}")
    return df.withColumn(output or field, new)


#: Java patterns of the parts of a date that may be kept.
COMPONENTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm", "weekday": "EEEE"}


def keep_components(df: DataFrame, field: str, parts: Sequence[str] = ("year", "month"), output: str | None = None) -> DataFrame:
    x = F.col(field)
    return df.withColumn(output or field, F.when(x.isNotNull(), F.concat_ws("-", *[F.date_format(x, COMPONENTS[p]) for p in parts])))


def relative_dates(df: DataFrame, field: str, reference: datetime, output: str | None = None) -> DataFrame:
    """Words for the distance in days from ``reference``."""
    d = F.floor((F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(F.col(field).cast("timestamp"))) / F.lit(86_400_000_000))
    new = F.when(d == 0, "Today")
    for bound, past, future in ((7, "Within a week ago", "Within a week"), (30, "Within a month ago", "Within a month"), (365, "Within a year ago", "Within a year")):
        new = new.when((d > 0) & (d <= bound), past).when((d < 0) & (d >= -bound), future)
    return df.withColumn(output or field, new.when(d > 0, "More than a year ago").when(d < 0, "More than a year ahead"))


def group_rare(df: DataFrame, field: str, least: int = 10, style: str = "single", name: str = "OTHER", keep_top: int | None = None, output: str | None = None) -> DataFrame:
    """Values counted fewer than ``least`` times become one group (``single``) or numbered groups.

    ``keep_top`` values are kept whatever their count.  Numbered groups are
    dealt in turn to max(1, rare / 10) of them, in the order of counts.
    """
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    rare = counts.where(F.col("n") < least)
    if keep_top:
        top = counts.orderBy(F.desc("n"), "value").limit(keep_top).select("value")
        rare = rare.join(top, "value", "left_anti")
    if style == "single":
        named = rare.select("value", F.lit(name).alias("__new"))
    else:
        groups = max(1, rare.count() // 10)
        ranked = places(rare, [-F.col("n"), F.col("value")], "__rank")
        named = ranked.select("value", F.format_string(f"{name}%03d", ((F.col("__rank") - 1) % groups).cast("int")).alias("__new"))
    out = df.join(named, df[field] == named["value"], "left").withColumn("__new", F.coalesce("__new", F.col(field).cast("string")))
    columns = [F.col("__new").alias(c) if c == field and not output else df[c] for c in df.columns]
    return out.select(*columns, *([F.col("__new").alias(output)] if output else []))


def keep_frequent(df: DataFrame, field: str, categories: int, unknown: str = "OTHER", output: str | None = None) -> DataFrame:
    """The most frequent ``categories`` values stay (ties by value); all others become ``unknown``, nulls stay."""
    if categories > 10_000:
        raise ValueError("more categories than are held as constants; use group_rare")
    top = [r["value"] for r in df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).count().orderBy(F.desc("count"), "value").limit(categories).collect()]
    x = F.col(field)
    return df.withColumn(output or field, F.when(x.isNull(), None).when(x.isin(top), x.cast("string")).otherwise(unknown))


def normalize_category(col: Column, level: str = "basic") -> Column:
    """Levels: none; basic (trimmed, single spaces, lower case); advanced (marks become spaces); aggressive (letters and digits only)."""
    if level == "none":
        return col
    x = F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))
    if level == "basic":
        return x
    if level == "advanced":
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "")


def hierarchy(df: DataFrame, field: str, mapping: DataFrame, level: str, unknown: str | None = "OTHER", normal: str = "basic", similar: float | None = None, output: str | None = None) -> DataFrame:
    """A value's ancestor in ``mapping`` (columns value and levels).

    Values missing there are matched to the most similar dictionary value by
    edit distance if ``similar`` is given (each distinct missing value is
    compared with all of the dictionary whose length allows it), then become
    ``unknown``.
    """
    table = mapping.select(normalize_category(F.col("value"), normal).alias("__value"), F.col(level).alias("__level")).dropDuplicates(["__value"])
    rows = df.withColumn("__key", normalize_category(F.col(field).cast("string"), normal))
    out = rows.join(table, rows["__key"] == table["__value"], "left")
    new = F.col("__level")
    if similar is not None:
        missing = rows.select("__key").where("__key is not null").distinct().join(table, F.col("__key") == F.col("__value"), "left_anti")
        longer = F.greatest(F.length("__key"), F.length("__value"), F.lit(1))
        # The lengths' difference is the least distance.
        near = missing.join(table, 1 - F.abs(F.length("__key") - F.length("__value")) / longer >= similar)
        score = 1 - F.levenshtein("__key", "__value") / longer
        best = near.withColumn("__score", score).where(F.col("__score") >= similar).groupBy("__key").agg(F.max_by("__level", F.struct("__score", F.col("__value"))).alias("__near"))
        out = out.join(best, "__key", "left")
        new = F.coalesce(new, F.col("__near"))
    new = F.when(F.col(field).isNull(), None).otherwise(F.coalesce(new, F.lit(unknown) if unknown is not None else F.col(field).cast("string")))
    names = [c for c in df.columns if c != (output or field)]
    return out.withColumn("__out", new).select(*names, F.col("__out").alias(output or field))


def category_rules(df: DataFrame, field: str, rules: Sequence[tuple[int, Column, str]], default: str | None = None, output: str | None = None) -> DataFrame:
    """(priority, condition, value) rules: the first that holds, highest priority first."""
    new: Column | None = None
    for _, test, value in sorted(rules, key=lambda r: -r[0]):
        new = F.when(test, value) if new is None else new.when(test, value)
    rest = F.lit(default) if default is not None else F.col(field).cast("string")
    return df.withColumn(output or field, rest if new is None else new.otherwise(rest))


def split_categories(df: DataFrame, field: str, separator: str = "|", output: str = "parts") -> DataFrame:
    return df.withColumn(output, F.transform(F.split(F.col(field), rf"\Q{separator}\E"), lambda x: F.trim(x)))


def merge_categories(df: DataFrame, field: str, separator: str = "|", output: str | None = None) -> DataFrame:
    return df.withColumn(output or field, F.array_join(F.col(field), separator))


def category_distribution(df: DataFrame, field: str) -> DataFrame:
    """One row: n, distinct, entropy (bits), gini, share of the top value."""
    counts = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").cast("double").alias("c"))
    total = counts.agg(F.sum("c").alias("t"), F.count("*").alias("d"))
    p = F.col("c") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(
        F.sum("c").cast("long").alias("n"), F.count("*").alias("distinct_values"), F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.round(1 - F.sum(p * p), 6).alias("gini"), F.round(F.max(p), 6).alias("top_share")
    )
