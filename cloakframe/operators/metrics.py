"""Privacy, fidelity, utility and quality metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import group_sizes
from .ordered import running_sums


# ---- privacy


def disclosure_risk(df: DataFrame, keys: Sequence[str], threshold: float = 20.0) -> DataFrame:
    """One row in percent: prosecutor 100 / least k; journalist, the mean of 100 / k over records; marketer, records alone in their group; at risk, k < 100 / threshold."""
    g = group_sizes(df, keys)
    n = F.sum("k")
    return g.agg(
        F.round(100 / F.min("k"), 2).alias("prosecutor"), F.round(100 * F.count("*") / n, 2).alias("journalist"), F.round(100 * F.count_if(F.col("k") == 1) / n, 2).alias("marketer"),
        F.coalesce(F.sum(F.when(F.col("k") < 100 / threshold, F.col("k"))), F.lit(0)).alias("at_risk_records"),
    )


def uniqueness(df: DataFrame, keys: Sequence[str], ks: Sequence[int] = (2, 5, 10)) -> DataFrame:
    """One row: share of groups of one among records, and share of groups below each k, in percent."""
    g = group_sizes(df, keys)
    return g.agg(F.round(100 * F.count_if(F.col("k") == 1) / F.sum("k"), 4).alias("identity_rate"), *[F.round(100 * F.avg((F.col("k") < k).cast("double")), 4).alias(f"below_{k}") for k in ks])


def coverage(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row of rows paired by position or key: total, changed, suppressed and unchanged shares of non-null originals."""
    b, a = F.col(before).cast("string"), F.col(after).cast("string")
    n = F.count(b)
    return pairs.agg(
        F.round(1 - F.count_if(a.isNull()) / F.count("*"), 6).alias("total"), F.round(F.count_if(b.isNotNull() & a.isNotNull() & (a != b)) / n, 6).alias("changed"),
        F.round(F.count_if(b.isNotNull() & a.isNull()) / n, 6).alias("suppressed"), F.round(F.count_if(a == b) / n, 6).alias("unchanged"),
    )


def generalization_level(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row: level clip((u0 - u1) / (u0 - 1)) and value reduction clip((u0 - u1) / u0)."""
    c = pairs.agg(F.count_distinct(before).alias("u0"), F.count_distinct(after).alias("u1"))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return c.select("u0", "u1", F.round(clip(F.try_divide(F.col("u0") - F.col("u1"), F.col("u0") - 1)), 6).alias("level"), F.round(clip(F.try_divide(F.col("u0") - F.col("u1"), F.col("u0"))), 6).alias("reduction"))


def simple_disclosure_risk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = group_sizes(df, keys)
    return g.agg(F.round(F.least(F.lit(1.0), F.count("*") / F.sum("k")), 6).alias("risk"), F.min("k").alias("min_group"))


def masking_ratio(df: DataFrame, field: str, char: str = "*") -> DataFrame:
    return df.agg(F.round(F.count_if(F.col(field).contains(char)) / F.count("*"), 6).alias("masked"))


def full_risk(df: DataFrame, keys: Sequence[str], sensitive: str) -> DataFrame:
    """One row: 0.40 / least k, 0.10 (1 - H / Hmax), 0.30 attribute disclosure, 0.20 membership; a score from 0 to 100.

    Attribute disclosure is the share of records in groups with one sensitive
    value; membership the share alone in their group.
    """
    counts = df.dropna(subset=[*keys, sensitive]).groupBy(*keys, sensitive).agg(F.count("*").alias("n"))
    g = counts.groupBy(*keys).agg(F.sum("n").alias("k"), F.count("*").alias("d"))
    per = g.agg(F.min("k").alias("min_k"), F.sum(F.when(F.col("d") == 1, F.col("k")).otherwise(0)).alias("same"), F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("alone"), F.sum("k").alias("t"))
    s = counts.groupBy(sensitive).agg(F.sum("n").alias("n"))
    total = s.agg(F.sum("n").alias("tt"), F.count("*").alias("values"))
    p = F.col("n") / F.col("tt")
    h = s.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log(p))).alias("h"), F.max("values").alias("values"))
    balance = F.when(F.col("values") > 1, 1 - F.col("h") / F.log("values")).otherwise(1.0)
    score = 0.4 / F.col("min_k") + 0.1 * balance + 0.3 * F.col("same") / F.col("t") + 0.2 * F.col("alone") / F.col("t")
    return per.crossJoin(h).select("min_k", F.round(F.col("same") / F.col("t"), 6).alias("attribute"), F.round(F.col("alone") / F.col("t"), 6).alias("membership"), F.round(score * 100, 4).alias("score"))


def provisional_risk(df: DataFrame, quasi: Sequence[str], direct: Sequence[str] = (), sensitive: Sequence[str] = ()) -> DataFrame:
    """One row: sigmoid of the coverage of direct, quasi and all identifying columns, weighted 0.5, 0.3, 0.2, and 0.1 more with sensitive ones."""
    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-10 * (x - 0.5)))

    def cover(fields: Sequence[str]) -> Column:
        return sum((F.count(f) / F.count("*") for f in fields), F.lit(0.0)) / len(fields) if fields else F.lit(0.0)

    r = df.agg(cover(direct).alias("d"), cover(quasi).alias("q"), cover([*direct, *quasi]).alias("a"))
    score = 0.5 * sigmoid(F.col("d")) + 0.3 * sigmoid(F.col("q")) + 0.2 * sigmoid(F.col("a")) + (0.1 if sensitive else 0.0)
    return r.select(F.round(F.least(F.lit(1.0), score), 6).alias("risk"))


# ---- fidelity


def _counts(df: DataFrame, field: str, name: str) -> DataFrame:
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count("*").alias(name))


def distributions(a: DataFrame, b: DataFrame, field: str, other: str | None = None) -> DataFrame:
    """(v, n_a, n_b) over the union of values."""
    return _counts(a, field, "n_a").join(_counts(b, other or field, "n_b"), "v", "full").select("v", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def kl_js(a: DataFrame, b: DataFrame, field: str, floor: float = 0.01) -> DataFrame:
    """One row: Kullback-Leibler divergence (nats) of the floored distributions, and Jensen-Shannon distance."""
    d = distributions(a, b, field)
    # Totals are one row each: constants for what follows, so the values are counted once a pass.
    t = [df.where(F.col(field).isNotNull()).count() or 1 for df in (a, b)]
    d = d.select(F.greatest(F.col("n_a") / F.lit(t[0]), F.lit(floor)).alias("p"), F.greatest(F.col("n_b") / F.lit(t[1]), F.lit(floor)).alias("q"))
    s = d.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    d = d.crossJoin(F.broadcast(s)).select(F.greatest(F.col("p") / F.col("sp"), F.lit(floor)).alias("p"), F.greatest(F.col("q") / F.col("sq"), F.lit(floor)).alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    return d.agg(F.round(F.sum(p * F.log(p / q)), 6).alias("kl"), F.round(F.sqrt(F.greatest(F.lit(0.0), (F.sum(p * F.log(p / m)) + F.sum(q * F.log(q / m))) / 2)), 6).alias("js_distance"))


def _gaps(d: DataFrame) -> DataFrame:
    """(v, step, ca, cb, na, nb): both distribution functions at each value and the distance to the next."""
    t = d.agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb")).first()
    run = running_sums(d, [F.col("v")], {"ca": F.col("n_a"), "cb": F.col("n_b")}, following=F.col("v").cast("double"))
    na, nb = F.lit(t["ta"]).cast("double"), F.lit(t["tb"]).cast("double")
    return run.select("v", (F.col("__next") - F.col("v").cast("double")).alias("step"), F.try_divide("ca", na).alias("ca"), F.try_divide("cb", nb).alias("cb"), na.alias("na"), nb.alias("nb"))


def ks(a: DataFrame, b: DataFrame, field: str, other: str | None = None, normalize: str | None = None) -> DataFrame:
    """One row: the two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value.

    ``normalize``: ``zscore`` standardizes each side by its own mean and
    sample deviation, ``minmax`` both by the limits of the two together.
    Values are counted before the running sums.
    """
    other = other or field
    if normalize == "zscore":
        def scaled(df: DataFrame, f: str) -> DataFrame:
            r = df.agg(F.avg(f).alias("m"), F.stddev_samp(f).alias("s")).first()
            return df.select(((F.col(f) - F.lit(r["m"])) / F.lit(r["s"] or 1.0)).alias("x"))
        a, b, field, other = scaled(a, field), scaled(b, other), "x", "x"
    elif normalize == "minmax":
        r = a.select(F.col(field).alias("x")).unionByName(b.select(F.col(other).alias("x"))).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        a, b = (df.select(((F.col(f) - F.lit(r["lo"])) / F.lit((r["hi"] - r["lo"]) or 1.0)).alias("x")) for df, f in ((a, field), (b, other)))
        field, other = "x", "x"
    r = _gaps(distributions(a, b, field, other)).agg(F.max(F.abs(F.col("ca") - F.col("cb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return r.select(F.round("d", 6).alias("statistic"), F.round(_ks_p("d", "na", "nb"), 6).alias("p_value"))


def _ks_p(d: str, na: str, nb: str) -> Column:
    x = F.col(d) * F.sqrt(F.col(na) * F.col(nb) / (F.col(na) + F.col(nb)))
    p = 2 * sum(((-1) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ks_keyed(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """One row: statistic, p_value and effect (statistic in units of its critical value at 5 percent) of a value aggregated by keys.

    Keys of both tables stand in their order; the statistic is the largest gap of the two cumulated shares.
    """
    stat = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    side = lambda df, n: df.dropna(subset=list(keys)).groupBy(*keys).agg(stat(value).cast("double").alias(n))
    d = side(a, "n_a").join(side(b, "n_b"), list(keys), "full").select(F.struct(*keys).alias("v"), F.coalesce("n_a", F.lit(0.0)).alias("n_a"), F.coalesce("n_b", F.lit(0.0)).alias("n_b"))
    t = d.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"), F.count_if(F.col("n_a") != 0).alias("ka"), F.count_if(F.col("n_b") != 0).alias("kb")).first()
    run = running_sums(d, [F.col("v")[k] for k in keys], {"ca": F.col("n_a"), "cb": F.col("n_b")})
    r = run.agg(F.max(F.abs(F.try_divide("ca", F.lit(t["a"])) - F.try_divide("cb", F.lit(t["b"])))).alias("d"))
    r = r.select("d", F.lit(float(t["ka"] or 0)).alias("na"), F.lit(float(t["kb"] or 0)).alias("nb"))
    critical = 1.358 * F.sqrt((F.col("na") + F.col("nb")) / (F.col("na") * F.col("nb")))
    return r.select(F.round("d", 6).alias("statistic"), F.round(_ks_p("d", "na", "nb"), 6).alias("p_value"), F.round(F.col("d") / critical, 6).alias("effect"))


def wasserstein(a: DataFrame, b: DataFrame, field: str, other: str | None = None) -> DataFrame:
    """One row: the integral of the difference of the two distribution functions."""
    return _gaps(distributions(a, b, field, other)).agg(F.round(F.coalesce(F.sum(F.col("step") * F.abs(F.col("ca") - F.col("cb"))), F.lit(0.0)), 6).alias("distance"))


def statistical_fidelity(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: mean, variance and correlation kept, in percent, and their mean weighted 0.4, 0.3, 0.3."""
    names = list(fields)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.agg(*[F.avg(f).alias(f"m{i}{s}") for i, f in enumerate(names)], *[F.var_samp(f).alias(f"v{i}{s}") for i, f in enumerate(names)], *[F.coalesce(F.corr(x, y), F.lit(0.0)).alias(f"c{i}{s}") for i, (x, y) in enumerate(pairs)])

    both = side(a, "a").crossJoin(side(b, "b"))
    kept = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.lit(1e-10)))
    mean = sum((kept(F.col(f"m{i}a"), F.col(f"m{i}b")) for i in range(len(names))), F.lit(0.0)) / len(names)
    var = sum((kept(F.col(f"v{i}a"), F.col(f"v{i}b")) for i in range(len(names))), F.lit(0.0)) / len(names)
    cor = 1 - sum((F.abs(F.col(f"c{i}a") - F.col(f"c{i}b")) for i in range(len(pairs))), F.lit(0.0)) / (2 * max(1, len(pairs)))
    return both.select(F.round(100 * mean, 4).alias("mean_kept"), F.round(100 * var, 4).alias("variance_kept"), F.round(100 * cor, 4).alias("correlation_kept"), F.round(100 * (0.4 * mean + 0.3 * var + 0.3 * cor), 4).alias("fidelity"))


# ---- utility


def information_loss(a: DataFrame, b: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """One row: record, numeric (1 - variance ratio) and categorical (1 - distinct ratio) loss, and their sum weighted 0.4, 0.3, 0.3 (renormalized)."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"n{s}"), *[F.var_samp(f).alias(f"v{i}{s}") for i, f in enumerate(numeric)], *[F.count_distinct(f).alias(f"d{i}{s}") for i, f in enumerate(categorical)])

    r = side(a, "a").crossJoin(side(b, "b"))
    loss = lambda x, y: F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(y, x), F.lit(1.0)))
    parts: list[tuple[str, float, Column]] = [("record_loss", 0.4, loss(F.col("na"), F.col("nb")))]
    if numeric:
        parts.append(("numeric_loss", 0.3, sum((loss(F.col(f"v{i}a"), F.col(f"v{i}b")) for i in range(len(numeric))), F.lit(0.0)) / len(numeric)))
    if categorical:
        parts.append(("categorical_loss", 0.3, sum((loss(F.col(f"d{i}a"), F.col(f"d{i}b")) for i in range(len(categorical))), F.lit(0.0)) / len(categorical)))
    whole = sum(w for _, w, _ in parts)
    return r.select(*[F.round(c, 6).alias(n) for n, _, c in parts], F.round(sum((w / whole * c for _, w, c in parts), F.lit(0.0)), 6).alias("total_loss"))


def suppression_loss(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: nulls before and after, and the share newly null."""
    def side(df: DataFrame, s: str) -> DataFrame:
        n = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"x_{f}") for f in fields])
        return n.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"x_{f}") for f in fields]))).alias("field", f"nulls_{s}"))

    out = side(a, "before").join(side(b, "after").drop("n"), "field")
    return out.select("field", "nulls_before", "nulls_after", F.round((F.col("nulls_after") - F.col("nulls_before")) / F.col("n"), 6).alias("loss"))


def errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: mse, mae, r2."""
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    return df.agg(F.round(F.avg((y - p) * (y - p)), 6).alias("mse"), F.round(F.avg(F.abs(y - p)), 6).alias("mae"), F.round(1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)), 6).alias("r2"))


def classification_scores(df: DataFrame, truth: str, guess: str, positive: object = 1) -> DataFrame:
    """One row: accuracy, precision, recall, f1."""
    y, p = F.col(truth) == F.lit(positive), F.col(guess) == F.lit(positive)
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    pre, rec = zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
    acc = zero(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    return c.select(F.round(acc, 4).alias("accuracy"), F.round(pre, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(zero(F.try_divide(2 * pre * rec, pre + rec)), 4).alias("f1"))


def model_utility(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, regression: bool = False, seed: int = 42) -> dict[str, float]:
    """A model trained on one table and tested on another: accuracy and f1, or r2 and rmse."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import LinearRegression

    stages = [VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")]
    if regression:
        model = Pipeline(stages=[*stages, LinearRegression(featuresCol="__x", labelCol=label)]).fit(train)
        out = model.transform(test)
        return {m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(out) for m in ("r2", "rmse")}
    stages += [StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip"), RandomForestClassifier(featuresCol="__x", labelCol="__y", seed=seed, numTrees=20)]
    out = Pipeline(stages=stages).fit(train).transform(test)
    return {m: MulticlassClassificationEvaluator(labelCol="__y", metricName=m).evaluate(out) for m in ("accuracy", "f1")}


# ---- quality


def quality_score(df: DataFrame, fields: Sequence[str], valid: dict[str, Column] | None = None) -> DataFrame:
    """A row for each field: completeness, validity, diversity, and 0.5, 0.3, 0.2 of them as the score."""
    valid = valid or {}
    cells = []
    for f in fields:
        ok = F.coalesce(valid.get(f, F.lit(True)), F.lit(False)) & F.col(f).isNotNull()
        cells.append(F.struct(F.lit(f).alias("field"), F.count(f).alias("c"), F.count_if(ok).alias("v"), F.count_distinct(f).alias("d")).alias(f"__{f}"))
    r = df.agg(F.count("*").alias("n"), *cells).select("n", F.explode(F.array(*[F.col(f"__{f}") for f in fields])).alias("x"))
    full, good, many = F.coalesce(F.try_divide("x.c", "n"), F.lit(0.0)), F.coalesce(F.try_divide("x.v", "x.c"), F.lit(0.0)), F.coalesce(F.try_divide("x.d", "x.c"), F.lit(0.0))
    return r.select(F.col("x.field").alias("field"), F.round(full, 6).alias("completeness"), F.round(good, 6).alias("validity"), F.round(many, 6).alias("diversity"), F.round(100 * (0.5 * full + 0.3 * good + 0.2 * many), 4).alias("score"))


def rule_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each named rule: rows that pass and fail (null counts as failing), in one scan."""
    cells = [F.struct(F.lit(n).alias("rule"), F.count_if(F.coalesce(c, F.lit(False))).alias("passed"), F.count_if(~F.coalesce(c, F.lit(False))).alias("failed")).alias(f"__{i}") for i, (n, c) in enumerate(rules.items())]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(rules))])).alias("x")).select("x.*")


def predicted_utility(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row: completeness, diversity, balance (1 - share of the commonest value), each a mean over fields, and a quarter of each with schema richness."""
    rich = min(1.0, len(fields) / 10)
    parts = []
    for f in fields:
        c = df.groupBy(f).agg(F.count("*").alias("n"))
        known = F.col(f).isNotNull()
        parts.append(c.agg((F.sum(F.when(known, F.col("n")).otherwise(0)) / F.sum("n")).alias("full"), (F.count_if(known) / F.sum("n")).alias("many"), (1 - F.max(F.when(known, F.col("n"))) / F.sum("n")).alias("even")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    r = u.agg(F.avg("full").alias("full"), F.avg("many").alias("many"), F.avg("even").alias("even"))
    return r.select(F.round("full", 6).alias("completeness"), F.round("many", 6).alias("diversity"), F.round("even", 6).alias("balance"), F.round(0.25 * (F.col("full") + F.col("many") + F.col("even") + rich), 6).alias("utility"))


# ---- inequality


def inequality(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """One row over the counts of a key: gini, hhi, normalized hhi, share of the ``top`` keys, entropy in bits."""
    c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias("n"))
    # Counts are summed up by size first, so the ordered pass is over distinct sizes.
    by = c.groupBy("n").agg(F.count("*").cast("double").alias("m"))
    t = by.agg(F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("m").alias("k"))
    r = running_sums(by, [F.col("n")], {"upto": F.col("m")}).select("n", "m", (F.col("upto") - F.col("m")).alias("below")).crossJoin(F.broadcast(t))
    # Ranks of equal sizes are below + 1 .. below + m; their sum is m * (2 * below + m + 1) / 2.
    ranked = F.sum(F.col("n") * F.col("m") * (2 * F.col("below") + F.col("m") + 1) / 2)
    p = F.col("n") / F.col("t")
    one = r.agg(F.max("t").alias("t"), F.max("k").alias("k"), ranked.alias("rs"), F.sum(F.col("m") * p * p).alias("s2"), (-F.sum(F.col("m") * p * F.log2(p))).alias("h"))
    best = c.orderBy(F.desc("n")).limit(top).agg(F.sum("n").alias("top_n"))
    return one.crossJoin(best).select(
        F.round(2 * F.col("rs") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k"), 6).alias("gini"), F.round(10000 * F.col("s2"), 6).alias("hhi"),
        F.round(F.coalesce(F.try_divide(F.col("s2") - 1 / F.col("k"), 1 - 1 / F.col("k")), F.lit(1.0)), 6).alias("hhi_normalized"), F.round(100 * F.col("top_n") / F.col("t"), 6).alias("top_share"), F.round("h", 6).alias("entropy"),
    )


def lorenz(df: DataFrame, key: str, points: int = 10) -> DataFrame:
    """(share of keys, share of rows) at equal steps, interpolated linearly."""
    c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias("n")).groupBy("n").agg(F.count("*").cast("double").alias("m"))
    r = running_sums(c, [F.col("n")], {"cm": F.col("m"), "cn": F.col("n") * F.col("m")})
    t = r.agg(F.max("cm").alias("k"), F.max("cn").alias("t"))
    at = r.sparkSession.range(points + 1).select((F.col("id") / points).alias("x"))
    # Inside a run of equal sizes the curve is a straight line.
    j = at.crossJoin(F.broadcast(t)).withColumn("want", F.col("x") * F.col("k")).join(r, (F.col("want") <= F.col("cm")) & (F.col("want") > F.col("cm") - F.col("m")), "left")
    y = (F.col("cn") - (F.col("cm") - F.col("want")) * F.col("n")) / F.col("t")
    return j.select(F.round("x", 6).alias("keys_share"), F.round(F.coalesce(y, F.lit(0.0)), 6).alias("rows_share"))


def collision_free_bits(n: int, risk: float = 1e-6) -> int:
    return math.ceil(math.log2(max(2, n) ** 2 / (2 * risk)))


# ---- validation rules

#: name -> column of a test, to be used with ``rule_checks``.
RULES = {
    "not_null": lambda f: F.col(f).isNotNull(),
    "not_empty": lambda f: F.trim(F.col(f)) != "",
    "positive": lambda f: F.col(f) > 0,
    "not_negative": lambda f: F.col(f) >= 0,
    "integer": lambda f: F.col(f) == F.floor(F.col(f)),
    "in_range": lambda f, a, b: F.col(f).between(a, b),
    "in_set": lambda f, values: F.col(f).isin(list(values)),
    "not_in_set": lambda f, values: ~F.col(f).isin(list(values)),
    "matches": lambda f, pattern: F.col(f).rlike(pattern),
    "length": lambda f, a, b: F.length(f).between(a, b),
    "email": lambda f: F.col(f).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    "number": lambda f: F.col(f).try_cast("double").isNotNull(),
    "date": lambda f, pattern: F.try_to_timestamp(F.col(f), F.lit(pattern)).isNotNull(),
    "not_future": lambda f, now: F.col(f) <= F.lit(now).cast("timestamp"),
    "upper_case": lambda f: F.col(f) == F.upper(F.col(f)),
    "fields_ordered": lambda f, other: F.col(f) <= F.col(other),
    "expression": lambda f, sql: F.expr(sql),
}


def unique_violations(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: groups of the fields that occur more than once, and their rows."""
    g = df.groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def reference_violations(df: DataFrame, field: str, other: DataFrame, other_field: str) -> DataFrame:
    """One row: rows whose non-null value the other table lacks."""
    keys = other.select(F.col(other_field).alias(field)).distinct()
    return df.where(F.col(field).isNotNull()).join(keys, field, "left_anti").agg(F.count("*").alias("missing"))


def l_diversity_loss(a: DataFrame, b: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """One row: mean squared difference of group means before and after, capped at 100."""
    x = a.groupBy(*keys).agg(F.avg(field).alias("ma"))
    y = b.groupBy(*keys).agg(F.avg(field).alias("mb"))
    return x.join(y, list(keys)).agg(F.round(F.least(F.lit(100.0), F.avg((F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb")))), 6).alias("loss"))


def distribution_fidelity(a: DataFrame, b: DataFrame, field: str) -> DataFrame:
    """One row: 0.6 (1 - KS) + 0.4 of how near the quartiles are, relative to the range before."""
    points = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])
    q = a.agg(F.percentile(field, points).alias("qa"), (F.max(field) - F.min(field)).cast("double").alias("w")).crossJoin(b.agg(F.percentile(field, points).alias("qb")))
    gap = sum((F.abs(F.col("qa")[i] - F.col("qb")[i]) for i in range(3)), F.lit(0.0)) / 3
    near = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(gap, F.col("w")), F.lit(0.0)))
    return ks(a, b, field).crossJoin(q).select(F.round(0.6 * (1 - F.col("statistic")) + 0.4 * near, 6).alias("fidelity"))


def composite(scores: dict[str, tuple[float, float]]) -> float:
    """Weighted mean of name -> (score, weight)."""
    total = sum(w for _, w in scores.values())
    return sum(s * w for s, w in scores.values()) / total if total else 0.0


def risk_bands(df: DataFrame, keys: Sequence[str], bounds: Sequence[int] = (2, 5, 10, 50)) -> DataFrame:
    """(band, groups, records): groups by the first bound above their k."""
    band = F.lit(f">={bounds[-1]}")
    for b in reversed(list(bounds)):
        band = F.when(F.col("k") < b, f"<{b}").otherwise(band)
    return group_sizes(df, keys).groupBy(band.alias("band")).agg(F.count("*").alias("groups"), F.sum("k").alias("records"))


def generalization_loss(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: distinct values before and after, and the share of distinctions lost."""
    def side(df: DataFrame, s: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.count_distinct(F.col(f)).alias(s)).alias(f"__{i}") for i, f in enumerate(fields)]
        return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(fields))])).alias("x")).select("x.*")

    d0, d1 = F.col("distinct_before"), F.col("distinct_after")
    loss = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(d0 - d1, d0 - 1), F.lit(0.0)))
    return side(a, "distinct_before").join(side(b, "distinct_after"), "field").select("field", "distinct_before", "distinct_after", F.round(loss, 6).alias("loss"))


def l_diversity_kl(a: DataFrame, b: DataFrame, keys: Sequence[str], sensitive: str, floor: float = 1e-10) -> DataFrame:
    """One row: over the groups of ``b``, weighted by size, how far their sensitive values are from those of the whole of ``a`` (KL in nats)."""
    whole = a.where(F.col(sensitive).isNotNull()).groupBy(sensitive).agg(F.count("*").alias("na"))
    n_all = a.where(F.col(sensitive).isNotNull()).count() or 1
    g = b.dropna(subset=[*keys, sensitive]).groupBy(*keys, sensitive).agg(F.count("*").alias("n"))
    size = g.groupBy(*keys).agg(F.sum("n").alias("size"))
    # Values that a group lacks add nothing.
    j = g.join(size, list(keys)).join(whole, sensitive, "left")
    p, q = F.col("n") / F.col("size"), F.greatest(F.coalesce(F.col("na") / F.lit(n_all), F.lit(0.0)), F.lit(floor))
    return j.agg(F.round(F.sum(F.col("n") * F.log(p / q)) / F.sum("n"), 6).alias("kl"))


def uniqueness_lt(df: DataFrame, keys: Sequence[str], sensitive: str, ls: Sequence[int] = (2, 3), t: float = 0.2) -> DataFrame:
    """One row: percent of groups with fewer than each l sensitive values, and with a value whose share leaves the table's by more than ``t``."""
    counts = df.dropna(subset=[*keys, sensitive]).groupBy(*keys, sensitive).agg(F.count("*").alias("n"))
    whole = counts.groupBy(sensitive).agg(F.sum("n").alias("all_n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 1
    size = counts.groupBy(*keys).agg(F.sum("n").alias("size"), F.count("*").alias("l"))
    away = counts.join(size, list(keys)).join(whole, sensitive).groupBy(*keys).agg(F.max("l").alias("l"), F.max(F.abs(F.col("n") / F.col("size") - F.col("all_n") / total)).alias("away"))
    return away.agg(F.count("*").alias("groups"), *[F.round(100 * F.avg((F.col("l") < n).cast("double")), 4).alias(f"below_l{n}") for n in ls], F.round(100 * F.avg((F.col("away") > t).cast("double")), 4).alias("beyond_t"))


def pearson_columns(pairs: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each (before, after) pair of columns of paired rows: their correlation and mean absolute difference."""
    cells = [F.struct(F.lit(a).alias("field"), F.round(F.corr(a, b), 6).alias("r"), F.round(F.avg(F.abs(F.col(a) - F.col(b))), 6).alias("mae")).alias(f"__{i}") for i, (a, b) in enumerate(fields)]
    return pairs.agg(*cells).select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(fields))])).alias("x")).select("x.*")


def dataset_quality(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = (), valid: dict[str, Column] | None = None) -> DataFrame:
    """One row: mean field score, consistency (share of rows that pass all rules) and uniqueness of ``keys``, in percent."""
    mean = quality_score(df, fields, valid).agg(F.round(F.avg("score"), 4).alias("mean_score"))
    every = F.lit(True)
    for c in (valid or {}).values():
        every = every & F.coalesce(c, F.lit(False))
    rows = df.agg(F.round(100 * F.avg(every.cast("double")), 4).alias("consistency"), F.count("*").alias("__n"))
    out = mean.crossJoin(rows)
    if keys:
        out = out.crossJoin(df.select(*keys).distinct().agg(F.count("*").alias("__d"))).withColumn("uniqueness", F.round(100 * F.col("__d") / F.col("__n"), 4)).drop("__d")
    return out.drop("__n")


def effectiveness(privacy_before: float, privacy_after: float, utility_after: float, weight: float = 0.5) -> float:
    """``weight`` of the share of risk removed and the rest of the utility kept."""
    gain = 0.0 if privacy_before <= 0 else max(0.0, min(1.0, (privacy_before - privacy_after) / privacy_before))
    return weight * gain + (1 - weight) * utility_after


#: Risk in percent from which each advice holds, most severe first.
ADVICE = ((50.0, "critical", "suppress or generalize the quasi-identifiers further"), (20.0, "high", "raise k and suppress small groups"), (9.0, "moderate", "generalize the rarest values"), (0.0, "low", "release under the usual conditions"))


def interpret(df: DataFrame, risk: str) -> DataFrame:
    """Rows with the ``level`` and ``advice`` that their risk in percent asks for."""
    level, advice = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bound, name, text in reversed(ADVICE):
        level, advice = F.when(F.col(risk) >= bound, name).otherwise(level), F.when(F.col(risk) >= bound, text).otherwise(advice)
    return df.withColumn("level", level).withColumn("advice", advice)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve by ranks with ties halved; scores are counted before they are ordered."""
    c = df.dropna(subset=[score, label]).groupBy(F.col(score).alias("v")).agg(F.sum(F.col(label).cast("long")).alias("yes"), F.sum(1 - F.col(label).cast("long")).alias("no"))
    run = running_sums(c, [F.col("v")], {"below": F.col("no")})
    r = run.agg(F.sum(F.col("yes") * (F.col("below") - F.col("no") / 2)).alias("u"), F.sum("yes").alias("p"), F.sum("no").alias("q"))
    return r.select(F.round(F.try_divide("u", F.col("p") * F.col("q")), 6).alias("auc"))


def field_types(df: DataFrame) -> DataFrame:
    """(field, kind): numeric, date, boolean, text or other, from the schema."""
    kinds = []
    for f in df.schema:
        name = f.dataType.typeName()
        kind = "numeric" if name in ("byte", "short", "integer", "long", "float", "double") or name.startswith("decimal") else "date" if name.startswith(("date", "timestamp")) else name if name == "boolean" else "text" if name == "string" else "other"
        kinds.append((f.name, kind))
    return df.sparkSession.createDataFrame(kinds, "field string, kind string")
