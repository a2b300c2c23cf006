"""Places and running sums in a global order, without putting all rows into one task.

Rows are cut into ranges of the order by values of a bounded sample.  Windows
run inside ranges, and what earlier ranges add up to is put in as constants.
The cuts only balance the ranges; the result does not depend on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most, and sampled rows for each cut.
RANGES, SAMPLED = 64, 40


def _ranged(df: DataFrame, order: Sequence[Column], ranges: int) -> DataFrame:
    """``df`` with the order as ``__key`` and its range as ``__range``."""
    rows = df.withColumn("__key", F.struct(*order))
    sample = rows.select("__key").orderBy(F.xxhash64("__key")).limit(ranges * SAMPLED).orderBy("__key").collect()
    kind = rows.schema["__key"].dataType
    cuts = [sample[len(sample) * k // ranges][0] for k in range(1, ranges)] if sample else []
    cuts = [c for k, c in enumerate(cuts) if not k or c != cuts[k - 1]]
    fixed = [F.struct(*[F.lit(v).cast(f.dataType) for v, f in zip(c, kind, strict=True)]).cast(kind) for c in cuts]
    place = F.size(F.filter(F.array(*fixed), lambda c: c <= F.col("__key"))) if fixed else F.lit(0)
    return rows.withColumn("__range", place)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], following: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds for each name the sum of its column over all rows up to this one, in an order without ties.

    ``following`` adds the next row's value of a column as ``__next``.
    """
    rows = _ranged(df, order, ranges)
    for k, c in enumerate(sums.values()):
        rows = rows.withColumn(f"__s{k}", c)
    if following is not None:
        rows = rows.withColumn("__f", following)
    cells = [F.sum(f"__s{k}").alias(f"t{k}") for k in range(len(sums))]
    totals = rows.groupBy("__range").agg(*cells, *([F.min_by("__f", "__key").alias("f")] if following is not None else [])).orderBy("__range").collect()
    w = Window.partitionBy("__range").orderBy("__key")
    out = rows
    for k, name in enumerate(sums):
        so_far, before = 0, F.lit(0)
        for r in totals:
            before = F.when(F.col("__range") == r["__range"], F.lit(so_far)).otherwise(before) if so_far else before
            so_far += r[f"t{k}"] or 0
        out = out.withColumn(name, F.sum(f"__s{k}").over(w.rowsBetween(Window.unboundedPreceding, 0)) + before)
    if following is not None:
        after = F.lit(None)
        for r, s in zip(totals[:-1], totals[1:], strict=True):
            after = F.when(F.col("__range") == r["__range"], F.lit(s["f"])).otherwise(after)
        out = out.withColumn("__next", F.coalesce(F.lead("__f").over(w), after))
    return out.drop("__key", "__range", "__f", *[f"__s{k}" for k in range(len(sums))])


def places(df: DataFrame, order: Sequence[Column], output: str, ranges: int = RANGES) -> DataFrame:
    """Adds each row's place in the order, from 1."""
    return running_sums(df, order, {output: F.lit(1).cast("long")}, ranges=ranges)
