"""Joins, aggregation, field changes, splits, cleaning and imputation."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import places


# ---- joins


def relationship(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> str:
    """one-to-one, one-to-many, many-to-one or many-to-many, by the uniqueness of either key."""

    def unique(df: DataFrame, key: str) -> bool:
        r = df.where(F.col(key).isNotNull()).groupBy(key).count().agg(F.max("count").alias("m")).first()
        return (r["m"] or 1) == 1

    return f"{'one' if unique(left, left_key) else 'many'}-to-{'one' if unique(right, right_key) else 'many'}"


def merge_datasets(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None, how: str = "left", suffixes: tuple[str, str] = ("_x", "_y"), expect: str | None = None, match_nulls: bool = True) -> DataFrame:
    """Join on one key pair; equal column names get the suffixes.

    Null keys match each other unless ``match_nulls`` is off.  ``expect``
    fails if the keys' relationship is another.  The broadcast is left to
    Spark, which knows the sizes.
    """
    right_key = right_key or left_key
    if expect and expect != "auto" and relationship(left, right, left_key, right_key) != expect:
        raise ValueError(f"the keys are not {expect}")
    shared = (set(left.columns) & set(right.columns)) - ({left_key} if left_key == right_key else set())
    a = left.select([F.col(c).alias(c + suffixes[0] if c in shared else c) for c in left.columns])
    b = right.select([F.col(c).alias("__rk" if c == right_key and left_key == right_key else c + suffixes[1] if c in shared else c) for c in right.columns])
    lk = left_key + suffixes[0] if left_key in shared else left_key
    rk = "__rk" if left_key == right_key else right_key + suffixes[1] if right_key in shared else right_key
    test = a[lk].eqNullSafe(b[rk]) if match_nulls else a[lk] == b[rk]
    out = a.join(b, test, {"outer": "full"}.get(how, how))
    if left_key == right_key:
        out = out.withColumn(lk, F.coalesce(lk, "__rk")).drop("__rk")
    return out


def overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: distinct keys in both, only left, only right."""
    a = left.where(F.col(left_key).isNotNull()).select(F.col(left_key).alias("k")).distinct().withColumn("a", F.lit(1))
    b = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("k")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )


def lookup(df: DataFrame, field: str, table: dict[Any, Any] | DataFrame, output: str) -> DataFrame:
    """Value by a dictionary or a DataFrame (key, value); missing keys give null."""
    if isinstance(table, dict):
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return df.withColumn(output, pairs[F.col(field)])
    t = table.select(F.col("key").alias("__k"), F.col("value").alias("__v")).dropDuplicates(["__k"])
    names = [c for c in df.columns if c != output]
    return df.join(t, F.col(field) == F.col("__k"), "left").select(*names, F.col("__v").alias(output))


# ---- aggregation

Aggregate = Callable[[str], Column]
AGGREGATES: dict[str, Aggregate] = {
    "count": F.count, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
    "mode": lambda c: F.mode(c, True), "range": lambda c: F.max(c) - F.min(c), "null_count": lambda c: F.count_if(F.col(c).isNull()), "iqr": lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)),
    "cv": lambda c: F.try_divide(F.stddev_samp(c), F.avg(c)),
}


def ordered(name: str, order: str) -> Aggregate:
    """first and last need an order column to be defined."""
    return (lambda c: F.min_by(c, order)) if name == "first" else (lambda c: F.max_by(c, order))


def aggregate_records(df: DataFrame, by: Sequence[str], aggregations: dict[str, Sequence[str]], custom: dict[str, Aggregate] | None = None, order: str | None = None, drop_null_groups: bool = True) -> DataFrame:
    """Columns named ``field_function``; rows with a null key are left out unless told otherwise."""
    columns = []
    for field, names in aggregations.items():
        for name in names:
            f = (custom or {}).get(name) or AGGREGATES.get(name) or (ordered(name, order) if name in ("first", "last") and order else None)
            if f is None:
                raise ValueError(f"unknown aggregate {name}")
            columns.append(f(field).alias(f"{field}_{name}"))
    rows = df.dropna(subset=list(by)) if drop_null_groups else df
    return rows.groupBy(*by).agg(*columns)


# ---- fields


def remove_fields(df: DataFrame, names: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*names, *([c for c in df.columns if re.search(pattern, c)] if pattern else []))


def add_or_modify(df: DataFrame, changes: dict[str, dict[str, Any]]) -> DataFrame:
    """field -> {operation, ...}; add_* need the field absent, modify_* present.

    Operations end in constant (value), lookup (key, table), conditional
    (condition: SQL, then, else) or expression (SQL).
    """
    for field, change in changes.items():
        kind = change["operation"]
        if kind.startswith("add") == (field in df.columns):
            continue
        if kind.endswith("constant"):
            df = df.withColumn(field, F.lit(change["value"]))
        elif kind.endswith("lookup"):
            df = lookup(df, change.get("key", field), change["table"], field)
        elif kind.endswith("conditional"):
            other = F.lit(change["else"]) if "else" in change else F.col(field) if field in df.columns else F.lit(None)
            df = df.withColumn(field, F.when(F.expr(change["condition"]), F.lit(change["then"])).otherwise(other))
        elif kind.endswith("expression"):
            df = df.withColumn(field, F.expr(change["expression"]))
        else:
            raise ValueError(f"unknown operation {kind}")
    return df


def split_fields(df: DataFrame, id_field: str, groups: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    return {name: df.select(id_field, *[f for f in fields if f != id_field]) for name, fields in groups.items()}


def split_by_values(df: DataFrame, field: str, groups: dict[str, Sequence[Any]], others: str = "others") -> dict[str, DataFrame]:
    listed = [v for values in groups.values() for v in values]
    out = {name: df.where(F.col(field).isin(list(values))) for name, values in groups.items()}
    return out | {others: df.where(~F.coalesce(F.col(field).isin(listed), F.lit(False)))}


def stack_parts(parts: dict[str, DataFrame], output: str = "part") -> DataFrame:
    """All parts in one table, with their names."""
    named = [df.withColumn(output, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def partition_number(df: DataFrame, field: str, parts: int, method: str = "modulo", seed: int = 42, output: str = "part") -> DataFrame:
    """Rows numbered by the part that their id falls in.

    equal_size cuts the distinct ids, in order, into parts that differ by one
    at most (a tie of rows stays together); random and modulo hash the id.
    """
    if method == "equal_size":
        ids = df.select(F.col(field).alias("__id")).distinct()
        n = ids.count()
        base, extra = divmod(n, parts)
        at, large = F.col("__at") - 1, extra * (base + 1)
        # The first parts have one more.
        tile = F.when(at < large, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - large) / max(base, 1)))
        numbered = places(ids, [F.col("__id")], "__at").select("__id", tile.cast("int").alias("__part"))
        return df.join(numbered, df[field].eqNullSafe(numbered["__id"])).select(*df.columns, F.col("__part").alias(output))
    if method == "modulo":
        kind = df.schema[field].dataType.typeName()
        x = F.col(field) if kind in ("integer", "long", "short", "byte") else F.xxhash64(field)
        return df.withColumn(output, F.pmod(x, F.lit(parts)).cast("int"))
    return df.withColumn(output, F.pmod(F.xxhash64(F.col(field), F.lit(seed)), F.lit(parts)).cast("int"))


# ---- cleaning


def clean_invalid(df: DataFrame, rules: dict[str, dict[str, Any]], strategy: str = "null", fill: dict[str, Any] | None = None) -> DataFrame:
    """Values that break a rule become null or the field's ``fill``.

    Rules: min, max, range, allowed, disallowed, pattern, min_length,
    max_length, date_format, min_date, max_date.
    """
    for field, rule in rules.items():
        x = F.col(field)
        text = x.cast("string")
        bad = F.lit(False)
        tests: dict[str, Callable[[Any], Column]] = {
            "min": lambda v: x < v, "max": lambda v: x > v, "range": lambda v: ~x.between(v[0], v[1]), "allowed": lambda v: ~x.isin(list(v)), "disallowed": lambda v: x.isin(list(v)), "pattern": lambda v: ~text.rlike(v),
            "min_length": lambda v: F.length(text) < v, "max_length": lambda v: F.length(text) > v, "date_format": lambda v: F.try_to_timestamp(text, F.lit(v)).isNull(),
            "min_date": lambda v: x < F.lit(v).cast("timestamp"), "max_date": lambda v: x > F.lit(v).cast("timestamp"),
        }
        for name, value in rule.items():
            bad = bad | F.coalesce(tests[name](value), F.lit(False))
        new = F.lit((fill or {}).get(field)) if strategy == "fill" else F.lit(None)
        df = df.withColumn(field, F.when(bad & x.isNotNull(), new).otherwise(x))
    return df


# ---- imputation

#: Slices of the known values' line that random samples are drawn from apart.
SLICES = 256


def impute(df: DataFrame, field: str, strategy: str, value: Any = None, invalid: Sequence[Any] = (), order: Sequence[str] = (), by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Nulls (and ``invalid`` values) of a field filled.

    constant, mean, median, mode (smallest on ties), min, max, random_sample
    (known values as often as they occur);
    with ``order``: ffill, bfill, interpolation (linear by row).  ``by`` keeps
    ordered fills inside a group, which is also what lets them scale.
    """
    x = F.when(F.col(field).isin(list(invalid)), None).otherwise(F.col(field)) if invalid else F.col(field)
    kind = df.schema[field].dataType
    if strategy == "constant":
        return df.withColumn(field, F.coalesce(x, F.lit(value).cast(kind)))
    if strategy in ("mean", "median", "mode", "min", "max"):
        src = df.select(x.cast("timestamp").cast("double").alias("v") if kind.typeName().startswith(("timestamp", "date")) and strategy in ("mean", "median") else x.alias("v"))
        stat = {"mean": F.avg("v"), "median": F.median("v"), "mode": F.mode("v", True), "min": F.min("v"), "max": F.max("v")}[strategy]
        got = src.agg(stat.alias("v")).first()["v"]
        new = F.timestamp_seconds(F.lit(got)) if kind.typeName().startswith(("timestamp", "date")) and strategy in ("mean", "median") else F.lit(got)
        return df.withColumn(field, F.coalesce(x, new.cast(kind) if kind.typeName() not in ("integer", "long") else new))
    if strategy == "random_sample":
        # Known values lie on a line, each as long as it is common, cut into slices of one length; each null falls on a
        # place of the line by a hash of its order columns (at random without them).
        known = df.select(x.alias("v")).dropna().groupBy("v").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(SLICES)).cast("int"))
        sizes = {r["part"]: r["n"] for r in known.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        total = sum(sizes.values())
        if not total:
            return df
        starts = F.array(*[F.lit(sum(n for p, n in sizes.items() if p < k)).cast("long") for k in range(SLICES)])
        width = -(-total // SLICES)
        end = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + starts[F.col("part")]
        line = known.select("v", (end - F.col("n")).alias("at"), end.alias("end"))
        line = line.select(F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("end") - 1) / width))).alias("slice"), "at", F.lit(0).alias("asks"), "v", F.lit(None).cast(df.schema).alias("row"))
        place = F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(total)) if order else F.floor(F.rand(seed) * total)
        asks = df.where(x.isNull()).withColumn("__at", place)
        asks = asks.select(F.floor(F.col("__at") / width).alias("slice"), F.col("__at").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("v"), F.struct(*df.columns).alias("row"))
        picked = F.last("v", True).over(Window.partitionBy("slice").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
        filled = line.unionByName(asks).withColumn("v", picked).where("asks = 1").select(*[F.col("v").alias(c) if c == field else F.col("row")[c].alias(c) for c in df.columns])
        return df.where(x.isNotNull()).unionByName(filled)
    w = Window.partitionBy(*by).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    if strategy == "ffill":
        return df.withColumn(field, F.last(x, True).over(back))
    if strategy == "bfill":
        return df.withColumn(field, F.first(x, True).over(ahead))
    if strategy == "interpolation":
        n = F.row_number().over(w)
        rows = df.withColumn("__x", x).withColumn("__n", n)
        at = F.when(F.col("__x").isNotNull(), F.col("__n"))
        a, b, i, j = F.last("__x", True).over(back), F.first("__x", True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
        between = a + (b - a) * (F.col("__n") - i) / (j - i)
        return rows.withColumn(field, F.coalesce("__x", between, a)).drop("__x", "__n")
    raise ValueError(f"unknown strategy {strategy}")


def parse_dates(df: DataFrame, field: str, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy/MM/dd"), output: str | None = None) -> DataFrame:
    """The first format that fits each value; unparsed values give null."""
    x = F.col(field).cast("string")
    return df.withColumn(output or field, F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]))


def compare_datasets(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows, columns and nulls of both sides and their differences."""

    def side(df: DataFrame, s: str) -> DataFrame:
        nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
        return df.agg(F.count("*").alias(f"rows_{s}"), nulls.alias(f"nulls_{s}")).withColumn(f"columns_{s}", F.lit(len(df.columns)))

    out = side(before, "before").crossJoin(side(after, "after"))
    return out.select("*", (F.col("rows_after") - F.col("rows_before")).alias("rows_delta"), (F.col("nulls_after") - F.col("nulls_before")).alias("nulls_delta"))


def handle_nulls(df: DataFrame, fields: Sequence[str], strategy: str = "preserve", value: Any = None) -> DataFrame:
    """preserve; exclude rows with a null; fill with ``value``; flag (adds ``<field>_is_null``)."""
    if strategy == "exclude":
        return df.dropna(subset=list(fields))
    if strategy == "fill":
        return df.withColumns({f: F.coalesce(F.col(f), F.lit(value).cast(df.schema[f].dataType)) for f in fields})
    if strategy == "flag":
        return df.withColumns({f"{f}_is_null": F.col(f).isNull() for f in fields})
    if strategy != "preserve":
        raise ValueError(f"unknown strategy {strategy}")
    return df


def to_number(df: DataFrame, field: str, kind: str = "double", default: Any = None, output: str | None = None) -> DataFrame:
    """Texts that are no number become ``default`` instead of an error."""
    return df.withColumn(output or field, F.coalesce(F.trim(F.col(field).cast("string")).try_cast(kind), F.lit(default).cast(kind)))


def lag_difference(df: DataFrame, field: str, by: Sequence[str], output: str = "step") -> DataFrame:
    """The difference to the row before in each group, in seconds for times."""
    x = F.col(field)
    if df.schema[field].dataType.typeName().startswith(("timestamp", "date")):
        x = F.unix_micros(x.cast("timestamp")) / 1_000_000
    return df.withColumn(output, x - F.lag(x).over(Window.partitionBy(*by).orderBy(field)))


def sampling_interval(df: DataFrame, field: str, by: Sequence[str]) -> DataFrame:
    """One row: the commonest step between rows of a group (the smallest on ties) and the share of steps that have it."""
    steps = lag_difference(df, field, by, "__step").where(F.col("__step").isNotNull()).groupBy("__step").agg(F.count("*").alias("n"))
    return steps.agg(F.max_by("__step", F.struct("n", -F.col("__step"))).alias("interval"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def one_hot(df: DataFrame, field: str, values: Sequence[Any], drop_first: bool = False) -> DataFrame:
    """A 0/1 column ``<field>_<value>`` for each listed value; others and nulls have zeros."""
    return df.withColumns({f"{field}_{v}": F.coalesce((F.col(field) == F.lit(v)).cast("int"), F.lit(0)) for v in list(values)[int(drop_first) :]}).drop(field)


def top_per_key(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, on ties with the smallest ``ties``; an aggregate, so no key's rows are sorted."""
    flat = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.max_by(flat, F.struct(F.col(order), *[-F.col(t) for t in ties])).alias("__r"))
    return best.select("__r.*")


def join_types(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(kind, rows): rows that an inner, left, right and full join would have, from key counts alone."""
    count = lambda df, n: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n))
    j = count(a, "x").join(count(b, "y"), "k", "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    inner, left, right = F.sum(F.col("x") * F.col("y")), F.sum(F.when(F.col("y") == 0, F.col("x")).otherwise(0)), F.sum(F.when(F.col("x") == 0, F.col("y")).otherwise(0))
    s = j.agg(inner.alias("inner"), (inner + left).alias("left"), (inner + right).alias("right"), (inner + left + right).alias("full"))
    kinds = ("inner", "left", "right", "full")
    return s.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("kind", "rows"))
