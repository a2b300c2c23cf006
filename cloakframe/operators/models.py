"""Privacy models: k-anonymity, l-diversity, t-closeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "k") -> DataFrame:
    """Rows of each group of the quasi-identifiers; rows with a null key are in none."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias(name))


def k_evaluate(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """One row: groups, records, min_k, groups and records at risk, and the three attack models' risks in percent."""
    g = group_sizes(df, keys)
    risky = F.col("k") < k
    n = F.sum("k")
    return g.agg(
        F.count("*").alias("groups"), n.alias("records"), F.min("k").alias("min_k"), F.count_if(risky).alias("groups_at_risk"), F.coalesce(F.sum(F.when(risky, F.col("k"))), F.lit(0)).alias("records_at_risk"),
        F.round(100 * F.coalesce(F.sum(F.when(risky, F.col("k"))), F.lit(0)) / n, 4).alias("records_at_risk_pct"), F.round(100 / F.min("k"), 4).alias("prosecutor_risk"),
        F.round(100 * F.count("*") / n, 4).alias("journalist_risk"), F.round(100 * F.count_if(F.col("k") == 1) / n, 4).alias("marketer_risk"),
    )


def adaptive_k(df: DataFrame, keys: Sequence[str], k: int, overrides: DataFrame) -> DataFrame:
    """Groups with the k they need: ``overrides`` has the keys and needed_k."""
    return group_sizes(df, keys).join(overrides, list(keys), "left").withColumn("needed_k", F.coalesce("needed_k", F.lit(k)))


def enrich_k(df: DataFrame, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Every row with its group's size and risk 1 / k (null where a key is null)."""
    name = name or "K_" + "_".join(c[:3] for c in keys)
    known = sum((F.col(c).isNull().cast("int") for c in keys), F.lit(0)) == 0
    size = F.when(known, F.count("*").over(Window.partitionBy(*keys)))
    return df.withColumn(name, size).withColumn(f"{name}_risk", F.round(1 / F.col(name), 6))


def k_suppress(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of groups with at least ``k`` rows: by a semi-join with the aggregated groups, so rows are shuffled once at most."""
    safe = group_sizes(df, keys, "__k").where(F.col("__k") >= k).select(*keys)
    return df.join(safe, list(keys), "left_semi").select(df.columns)


def k_mask(df: DataFrame, keys: Sequence[str], k: int, fields: Sequence[str] | None = None, mask: str = "MASKED") -> DataFrame:
    """The fields (by default the keys) of rows in small groups become ``mask``; masked columns are text."""
    sizes = group_sizes(df, keys, "__k")
    out = df.join(sizes, list(keys), "left")
    risky = F.coalesce(F.col("__k") < k, F.lit(True))
    fields = list(keys) if fields is None else list(fields)
    return out.select([F.when(risky, mask).otherwise(F.col(c).cast("string")).alias(c) if c in fields else F.col(c) for c in df.columns])


def k_batch(df: DataFrame, keys: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """k, groups and records below it, for each k; groups are counted once."""
    g = group_sizes(df, keys).withColumn("need", F.explode(F.array(*[F.lit(k) for k in ks])))
    return g.groupBy("need").agg(F.count_if(F.col("k") < F.col("need")).alias("groups_below"), F.coalesce(F.sum(F.when(F.col("k") < F.col("need"), F.col("k"))), F.lit(0)).alias("records_below"))


def sensitive_counts(df: DataFrame, keys: Sequence[str], sensitive: str) -> DataFrame:
    return df.dropna(subset=[*keys, sensitive]).groupBy(*keys, sensitive).agg(F.count("*").alias("n"))


def l_diversity(df: DataFrame, keys: Sequence[str], sensitive: str, l: int = 3, c: float = 1.0) -> DataFrame:  # noqa: E741
    """Groups with size, distinct values, entropy (nats), and whether (c, l) holds over the l largest counts."""
    counts = sensitive_counts(df, keys, sensitive)
    total = F.sum("n").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), sensitive))
    p = F.col("n") / F.col("size")
    rows = counts.withColumn("size", total).withColumn("rank", rank)
    tail = F.coalesce(F.sum(F.when(F.col("rank").between(2, l), F.col("n"))), F.lit(0))
    out = rows.groupBy(*keys).agg(F.max("size").alias("size"), F.count("*").alias("distinct_l"), F.round(-F.sum(p * F.log(p)), 6).alias("entropy"), F.max("n").alias("top"), tail.alias("tail"))
    return out.select(*keys, "size", "distinct_l", "entropy", ((F.col("distinct_l") >= l) & (F.col("top") <= c * F.col("tail"))).alias("recursive_ok"))


def risk_of_diversity(col: Column, kind: str = "distinct") -> Column:
    x = col if kind == "distinct" else F.exp(col)
    return F.when(x <= 0, 100.0).otherwise(F.least(F.lit(100.0), 100 / x))


def l_risk(df: DataFrame, keys: Sequence[str], sensitive: str, l: int = 3) -> DataFrame:  # noqa: E741
    """One row: least, mean and median diversity, the attack models' risks, and groups below l."""
    g = l_diversity(df, keys, sensitive, l)
    d = F.col("distinct_l")
    return g.agg(F.min(d).alias("min_l"), F.avg(d).alias("avg_l"), F.median(d).alias("median_l"), F.count_if(d < l).alias("groups_below"), F.count("*").alias("groups")).select(
        "min_l", F.round("avg_l", 6).alias("avg_l"), "median_l", "groups_below", "groups", F.round(risk_of_diversity(F.col("min_l")), 4).alias("prosecutor"), F.round(risk_of_diversity(F.col("avg_l")), 4).alias("journalist"), F.round(risk_of_diversity(F.col("median_l")), 4).alias("marketer")
    )


def attribute_risk(df: DataFrame, keys: Sequence[str], sensitive: str, l: int = 3) -> DataFrame:  # noqa: E741
    """One row: homogeneous %, mean top frequency, baseline, gain, vulnerability and overall risk of a sensitive attribute."""
    counts = sensitive_counts(df, keys, sensitive)
    g = counts.groupBy(*keys).agg(F.count("*").alias("d"), (F.max("n") / F.sum("n")).alias("top"))
    per = g.agg(F.min("d").alias("min_d"), (100 * F.avg((F.col("d") == 1).cast("double"))).alias("homogeneous"), (100 * F.avg("top")).alias("avg_top"))
    whole = counts.groupBy(sensitive).agg(F.sum("n").alias("n"))
    base = whole.agg((100 * F.max("n") / F.sum("n")).alias("baseline"))
    gain = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("avg_top") - F.col("baseline")))
    short = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (l - F.col("min_d")) / l * 100))
    return per.crossJoin(base).select(
        "min_d", F.round("homogeneous", 4).alias("homogeneous"), F.round("avg_top", 4).alias("avg_top"), F.round("baseline", 4).alias("baseline"), F.round(gain, 4).alias("gain"),
        F.round(0.4 * short + 0.3 * F.col("homogeneous") + 0.2 * gain, 4).alias("vulnerability"), F.round(0.5 * F.least(F.lit(100.0), 100 / F.col("min_d")) + 0.2 * F.col("homogeneous") + 0.2 * gain, 4).alias("overall"),
    )


def l_suppress(df: DataFrame, keys: Sequence[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    """Rows of groups with at least ``l`` distinct sensitive values."""
    safe = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct(sensitive).alias("__d")).where(F.col("__d") >= l).select(*keys)
    return df.join(safe, list(keys), "left_semi").select(df.columns)


def l_mask(df: DataFrame, keys: Sequence[str], sensitive: str, l: int, partial: bool = False, mask: str = "MASKED") -> DataFrame:  # noqa: E741
    """The sensitive value of rows in less diverse groups becomes ``mask``, or keeps its first character only."""
    sizes = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct(sensitive).alias("__d"))
    text = F.col(sensitive).cast("string")
    new = F.concat(F.substring(text, 1, 1), F.lit("***")) if partial else F.lit(mask)
    out = df.join(sizes, list(keys), "left")
    risky = F.coalesce(F.col("__d") < l, F.lit(True))
    return out.select([F.when(risky, new).otherwise(text).alias(c) if c == sensitive else F.col(c) for c in df.columns])


def t_closeness_ordered_emd(df: DataFrame, keys: Sequence[str], sensitive: str) -> DataFrame:
    """Each group's ordered earth mover's distance: the sum of differences between distribution functions over sorted values.

    Groups are spread over the grid of distinct sensitive values, so that
    column must have few of them.
    """
    counts = sensitive_counts(df, keys, sensitive)
    values = counts.groupBy(sensitive).agg(F.sum("n").alias("all_n"))
    groups = counts.select(*keys).distinct()
    grid = groups.crossJoin(F.broadcast(values)).join(counts, [*keys, sensitive], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy(*keys).orderBy(sensitive).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    gap = F.abs(F.sum("n").over(run) / F.sum("n").over(whole) - F.sum("all_n").over(run) / F.sum("all_n").over(whole))
    return grid.withColumn("gap", gap).groupBy(*keys).agg(F.round(F.sum("gap"), 6).alias("t"))


def t_closeness_probability_values(df: DataFrame, keys: Sequence[str], sensitive: str) -> DataFrame:
    """Each group's mean difference between the sorted probabilities of group and table."""
    counts = sensitive_counts(df, keys, sensitive)
    values = counts.groupBy(sensitive).agg(F.sum("n").alias("all_n"))
    groups = counts.select(*keys).distinct()
    grid = groups.crossJoin(F.broadcast(values)).join(counts, [*keys, sensitive], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = grid.groupBy(*keys).agg(F.sum("n").alias("g"), F.sum("all_n").alias("w"), F.array_sort(F.collect_list("n")).alias("a"), F.array_sort(F.collect_list("all_n")).alias("b"))
    gaps = F.zip_with(F.transform("a", lambda x: x / F.col("g")), F.transform("b", lambda x: x / F.col("w")), lambda x, y: F.abs(x - y))
    return sums.select(*keys, F.round(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size("a"), 6).alias("t"))


def t_suppress(df: DataFrame, keys: Sequence[str], sensitive: str, t: float) -> DataFrame:
    """Rows of groups whose ordered distance is at most ``t``."""
    return df.join(t_closeness_ordered_emd(df, keys, sensitive).where(F.col("t") <= t).select(*keys), list(keys), "left_semi").select(df.columns)


def k_compare(before: DataFrame, after: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """(side, ...): ``k_evaluate`` of both tables."""
    return k_evaluate(before, keys, k).withColumn("side", F.lit("before")).unionByName(k_evaluate(after, keys, k).withColumn("side", F.lit("after")))


def group_information_loss(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: distinct values before and after, and the share lost."""
    def side(df: DataFrame, s: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.count_distinct(F.col(f)).alias(s)).alias(f"__{f}") for f in fields]
        return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{f}") for f in fields])).alias("x")).select("x.*")

    both = side(before, "distinct_before").join(side(after, "distinct_after"), "field")
    return both.withColumn("lost", F.round(1 - F.try_divide(F.col("distinct_after"), F.col("distinct_before")), 6))


def adaptive_k(df: DataFrame, keys: Sequence[str], k: int, own: DataFrame) -> DataFrame:
    """Groups with size, the k asked of them (``own``: keys and k, else ``k``) and whether they have it."""
    sizes = group_sizes(df, keys)
    asked = own.select(*keys, F.col("k").alias("__asked"))
    out = sizes.join(asked, list(keys), "left").withColumn("asked", F.coalesce("__asked", F.lit(k)))
    return out.select(*keys, F.col("k").alias("size"), "asked", (F.col("k") >= F.col("asked")).alias("ok"))


def high_risk_groups(df: DataFrame, keys: Sequence[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    """Groups with fewer than ``l`` sensitive values: size, distinct values, the commonest value's share."""
    counts = sensitive_counts(df, keys, sensitive)
    g = counts.groupBy(*keys).agg(F.sum("n").alias("size"), F.count("*").alias("distinct_l"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"))
    return g.where(F.col("distinct_l") < l)


def compare_attributes(df: DataFrame, keys: Sequence[str], sensitive: Sequence[str], l: int = 3) -> DataFrame:  # noqa: E741
    """``attribute_risk`` of each sensitive attribute, with its rank by vulnerability, then name."""
    parts = [attribute_risk(df, keys, s, l).select(F.lit(s).alias("attribute"), "*") for s in sensitive]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # One row an attribute.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("vulnerability"), "attribute")))
