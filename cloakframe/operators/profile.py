"""Profiles of columns and tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import group_sizes
from .ordered import running_sums


def numeric_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field, all in one scan: counts, mean, deviation, quartiles, bias-corrected skewness, zeros, IQR outliers need ``outliers``."""
    cells = []
    for f in fields:
        x = F.col(f).cast("double")
        n = F.count(x)
        skew = F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1).cast("double")), n - 2)
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        cells.append(
            F.struct(
                F.lit(f).alias("field"), n.alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 4).alias("mean"),
                F.round(F.stddev_samp(x), 4).alias("std"), F.round(q[0], 4).alias("q1"), F.round(q[1], 4).alias("median"), F.round(q[2], 4).alias("q3"), F.round(skew, 4).alias("skewness"),
            ).alias(f"__{f}")
        )
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{f}") for f in fields])).alias("x")).select("x.*")


def outliers(df: DataFrame, field: str) -> DataFrame:
    """One row: IQR fences and the values beyond them."""
    x = F.col(field).cast("double")
    q = df.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    fences = q.select((F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    return df.select(x.alias("x")).crossJoin(F.broadcast(fences)).agg(F.round(F.max("low"), 4).alias("low"), F.round(F.max("high"), 4).alias("high"), F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outliers"))


def histogram(df: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """(bin, n): bins of equal width, closed below, the last closed above too."""
    x = F.col(field).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    width = ((r["hi"] or 0.0) - (r["lo"] or 0.0)) / bins or 1.0
    return df.where(x.isNotNull()).groupBy(F.least(F.floor((x - (r["lo"] or 0.0)) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def categorical_profile(df: DataFrame, field: str, top: int = 10) -> DataFrame:
    """(value, n, share): the commonest values, ties by value."""
    c = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    return c.crossJoin(F.broadcast(t)).orderBy(F.desc("n"), "value").limit(top).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def typo_candidates(df: DataFrame, field: str, rare: int = 2, common: int = 10, distance: int = 2) -> DataFrame:
    """(value, like, distance): rare values within an edit distance of common ones, or that hold or are held by one.

    Nothing is lost and no product of values is formed.  Of the ``distance`` + 1
    segments of a common value, edits leave one whole, which a rare value holds
    at most ``distance`` places away; very short values have empty segments and
    meet all others of about their length.  A held value is found by the
    rarest of its runs of three characters (or by all of a shorter one).
    """
    c = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    a = c.where(F.col("n") <= rare).select("value")
    b = c.where(F.col("n") >= common).select(F.col("value").alias("like"))
    parts = range(distance + 1)
    bound = lambda length, i: F.floor(length * i / (distance + 1)).cast("int")
    n = F.length("like")
    segments = F.array(*[F.xxhash64(n, F.lit(i), F.substring("like", bound(n, i) + 1, bound(n, i + 1) - bound(n, i))) for i in parts])

    def places(length: Column, i: int) -> Column:
        first, size = bound(length, i), bound(length, i + 1) - bound(length, i)
        # Of the edits, i lie before the first whole segment that has as many before it as segments, the others after it.
        more = F.length("value") - length
        low, high = first + F.greatest(F.lit(-i), more - (distance - i)), first + F.least(F.lit(i), more + (distance - i))
        at = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda p: (p >= 0) & (p + size <= F.length("value")))
        return F.transform(at, lambda p: F.xxhash64(length, F.lit(i), F.substring(F.col("value"), p + 1, size)))

    lengths = F.sequence(F.greatest(F.length("value") - distance, F.lit(0)), F.length("value") + distance)
    held = F.array_distinct(F.flatten(F.transform(lengths, lambda length: F.concat(*[places(length, i) for i in parts]))))
    near = a.select("value", F.explode(held).alias("key")).join(b.select("like", F.explode(segments).alias("key")), "key").where(F.levenshtein("value", "like", distance) >= 0).select("value", "like")

    def inside(short: DataFrame, long: DataFrame, s: str, w: str) -> DataFrame:
        runs = lambda x, size: F.when(F.length(x) >= size, F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda p: F.substring(F.col(x), p, F.lit(size)))).otherwise(F.array().cast("array<string>"))
        grams = long.select(w, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[runs(w, k) for k in (1, 2, 3)]))).alias("gram"))
        counts = grams.groupBy("gram").agg(F.count("*").alias("m"))
        own = F.when(F.length(s) < 3, F.array(F.col(s))).otherwise(runs(s, 3))
        # A run that no long value holds makes the pair impossible.
        asked = short.select(s, F.explode(F.array_distinct(own)).alias("gram")).join(counts, "gram", "left").groupBy(s).agg(F.min_by("gram", F.struct(F.coalesce("m", F.lit(0)), "gram")).alias("gram"))
        return asked.join(grams, "gram").where(F.col(w).contains(F.col(s))).select("value", "like")

    pairs = near.unionByName(inside(a, b, "value", "like")).unionByName(inside(b, a, "like", "value")).distinct()
    return pairs.where("value <> like").select("value", "like", F.levenshtein("value", "like").alias("distance"))


def correlation_matrix(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of fields, in one scan."""
    pairs = list(combinations(fields, 2))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation with mean ranks for ties; ranks come from counts of distinct values."""
    rows = df.dropna(subset=[a, b]).select(F.col(a).alias("a"), F.col(b).alias("b"))

    def ranks(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count("*").alias("n"))
        return running_sums(n, [F.col(c)], {"upto": F.col("n")}).select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))

    return rows.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and V of two categories."""
    c = df.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    t = ra.agg(F.sum("na").alias("t"), F.count("*").alias("r")).crossJoin(rb.agg(F.count("*").alias("k")))
    # chi2 = t * (sum n^2 / (na nb) - 1) needs only cells that occur.
    s = c.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s")).crossJoin(t)
    chi2 = F.greatest(F.lit(0.0), F.col("t") * (F.col("s") - 1))
    return s.select(F.round(chi2, 4).alias("chi2"), F.round(F.coalesce(F.sqrt(F.try_divide(chi2, F.col("t") * (F.least("r", "k") - 1))), F.lit(0.0)), 6).alias("v"))


def correlation_ratio(df: DataFrame, category: str, field: str) -> DataFrame:
    """One row: eta, the share of deviation between categories."""
    rows = df.dropna(subset=[category, field])
    g = rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(field).alias("m"))
    t = rows.agg(F.avg(field).alias("tm"), (F.var_pop(field) * F.count("*")).alias("ss"))
    return g.crossJoin(F.broadcast(t)).agg(F.round(F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("m") - F.col("tm")) * (F.col("m") - F.col("tm"))), F.max("ss"))), 6).alias("eta"))


def date_profile(df: DataFrame, field: str) -> DataFrame:
    """One row: range, nulls, and counts of years, months and weekdays seen."""
    x = F.col(field)
    return df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x.isNull()).alias("nulls"), F.count_distinct(F.year(x)).alias("years"), F.count_distinct(F.month(x)).alias("months"), F.count_if(F.weekday(x) >= 5).alias("weekend"))


def date_distribution(df: DataFrame, field: str, part: str = "year") -> DataFrame:
    x = F.col(field)
    key = {"year": F.year(x), "month": F.month(x), "weekday": F.weekday(x), "decade": (F.floor(F.year(x) / 10) * 10).cast("int")}[part]
    return df.where(x.isNotNull()).groupBy(key.alias(part)).agg(F.count("*").alias("n"))


def date_anomalies(df: DataFrame, field: str, oldest: int = 1940, youngest: int = 2005, today: str = "2025-01-01") -> DataFrame:
    """(kind, n) over texts or dates: invalid, too_old, future, too_young, negative_year, valid; null texts are left out."""
    x = F.col(field)
    text = isinstance(df.schema[field].dataType, T.StringType)
    d = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")]) if text else x
    y = F.year(d)
    kind = F.when(x.cast("string").startswith("-"), "negative_year").when(d.isNull(), "invalid").when(d > F.lit(today).cast("timestamp"), "future").when(y < oldest, "too_old").when(y > youngest, "too_young").otherwise("valid")
    return df.where(x.isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def group_profile(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each field: groups, share of groups in which it varies, mean distinct values in a group."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_distinct(f).alias(f) for f in fields])
    cells = [F.struct(F.lit(f).alias("field"), F.count("*").alias("groups"), F.round(F.avg((F.col(f) > 1).cast("double")), 6).alias("varying"), F.round(F.avg(f), 6).alias("mean_distinct")).alias(f"__{f}") for f in fields]
    return g.agg(*cells).select(F.explode(F.array(*[F.col(f"__{f}") for f in fields])).alias("x")).select("x.*")


def identity_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys, values, keys with several values, values with several keys."""
    pairs = df.dropna(subset=[key, value]).select(F.col(key).alias("k"), F.col(value).alias("v")).distinct()
    a = pairs.groupBy("k").count().agg(F.count("*").alias("keys"), F.count_if(F.col("count") > 1).alias("keys_with_several"))
    b = pairs.groupBy("v").count().agg(F.count("*").alias("values"), F.count_if(F.col("count") > 1).alias("values_with_several"))
    return a.crossJoin(b)


def k_profile(df: DataFrame, sets: Sequence[Sequence[str]], threshold: int = 5) -> DataFrame:
    """A row for each set of quasi-identifiers: groups, least, mean and greatest k, vulnerable records, and percent of records and groups."""
    out = None
    for keys in sets:
        g = group_sizes(df, keys)
        low = F.col("k") < threshold
        r = g.agg(F.count("*").alias("groups"), F.min("k").alias("min_k"), F.round(F.avg("k"), 4).alias("mean_k"), F.max("k").alias("max_k"), F.coalesce(F.sum(F.when(low, F.col("k"))), F.lit(0)).alias("vulnerable"), F.sum("k").alias("t"), F.count_if(low).alias("lg"))
        r = r.select(F.lit("+".join(keys)).alias("fields"), "groups", "min_k", "mean_k", "max_k", "vulnerable", F.round(100 * F.col("vulnerable") / F.col("t"), 4).alias("record_pct"), F.round(100 * F.col("lg") / F.col("groups"), 4).alias("group_pct"))
        out = r if out is None else out.unionByName(r)
    return out


def field_sets(fields: Sequence[str], sizes: Sequence[int] = (2, 3), most: int = 50) -> list[tuple[str, ...]]:
    return [c for n in sizes for c in combinations(fields, n)][:most]


EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def email_profile(df: DataFrame, field: str) -> DataFrame:
    """(domain, n) of the valid addresses."""
    x = F.trim(F.col(field))
    return df.where(x.rlike(EMAIL)).groupBy(F.lower(F.regexp_extract(x, r"@(.+)$", 1)).alias("domain")).agg(F.count("*").alias("n"))


def phone_profile(df: DataFrame, field: str) -> DataFrame:
    """One row: texts, valid ones (7 to 15 digits), with country code."""
    x = F.col(field).cast("string")
    digits = F.length(F.regexp_replace(x, r"\D", ""))
    ok = digits.between(7, 15) & x.rlike(r"^[+\d\s().-]+$")
    return df.agg(F.count(x).alias("n"), F.count_if(ok).alias("valid"), F.count_if(ok & x.startswith("+")).alias("with_country"))


def parse_currency(col: Column) -> Column:
    """Amounts such as ``$1,000.00``, ``1.234,56 EUR`` or ``(5.00)``; null where none can be read."""
    x = F.regexp_replace(F.trim(col), r"[^0-9.,()\-]", "")
    negative = x.rlike(r"^\(.*\)$") | x.startswith("-")
    x = F.regexp_replace(x, r"[()\-]", "")
    european = x.rlike(r",\d{1,2}$")
    plain = F.when(european, F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(x, ",", ""))
    value = plain.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def currency_profile(df: DataFrame, field: str) -> DataFrame:
    x = parse_currency(F.col(field))
    return df.agg(F.count(field).alias("n"), F.count_if(x.isNull() & F.col(field).isNotNull()).alias("invalid"), F.round(F.min(x), 4).alias("min"), F.round(F.avg(x), 4).alias("mean"), F.round(F.max(x), 4).alias("max"))


def parse_mvf(col: Column) -> Column:
    """Values of texts such as ``['A', 'B']``, ``["A"]`` or ``A; B``."""
    x = F.regexp_replace(F.trim(col), r"^\[|\]$", "")
    parts = F.transform(F.split(x, r"[,;|]"), lambda p: F.regexp_replace(F.trim(p), r"^['\"]|['\"]$", ""))
    return F.filter(parts, lambda p: p != "")


def mvf_profile(df: DataFrame, values: Column) -> DataFrame:
    """(value, n): rows that hold each value."""
    return df.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


#: Words in column names that tell a role.
ROLE_WORDS = {"DIRECT": ("name", "email", "phone", "ssn", "passport", "address"), "INDIRECT": ("key", "id", "code"), "QUASI": ("age", "birth", "gender", "sex", "city", "zip", "nation", "segment", "date"), "SENSITIVE": ("salary", "income", "bal", "price", "diagnosis", "religion")}


def attribute_roles(df: DataFrame, fields: Sequence[str] | None = None, unique_high: float = 0.9, unique_low: float = 0.2) -> DataFrame:
    """(field, uniqueness, role): by name, else by the share of distinct values, in one scan."""
    fields = list(fields or df.columns)
    cells = []
    for f in fields:
        by_name = next((role for role, words in ROLE_WORDS.items() if any(w in f.lower() for w in words)), None)
        u = F.coalesce(F.try_divide(F.count_distinct(F.col(f)), F.count(f)), F.lit(0.0))
        role = F.lit(by_name) if by_name else F.when(u > unique_high, "INDIRECT").when(u > unique_low, "QUASI").otherwise("NON_SENSITIVE")
        cells.append(F.struct(F.lit(f).alias("field"), F.round(u, 6).alias("uniqueness"), role.alias("role")).alias(f"__{f}"))
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"__{f}") for f in fields])).alias("x")).select("x.*")


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, numeric columns."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), missing.alias("missing")).select("rows", F.lit(len(df.columns)).alias("columns"), "missing", F.lit(numeric).alias("numeric_columns"))


def _exploded(df: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """One aggregate of structs as a row each."""
    return df.agg(*[c.alias(f"__{i}") for i, c in enumerate(cells)]).select(F.explode(F.array(*[F.col(f"__{i}") for i in range(len(cells))])).alias("x")).select("x.*")


def infer_types(df: DataFrame, fields: Sequence[str] | None = None, few: int = 10, share: float = 0.05, long_text: float = 100.0) -> DataFrame:
    """(field, kind): categorical, numeric, date, boolean, mvf, long_text or text.

    Whole numbers are categorical; other numbers too, with at most
    min(``few``, ``share`` of the rows) distinct values.  Texts are mvf where
    more than half are written as lists, long_text by mean length, else
    categorical where at most half of the known values are distinct.
    """
    cells = []
    for f in fields or df.columns:
        kind, x = df.schema[f].dataType, F.col(f)
        n, d = F.count(x), F.count_distinct(x)
        if isinstance(kind, T.BooleanType):
            name = F.lit("boolean")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            name = F.lit("date")
        elif isinstance(kind, T.IntegralType):
            name = F.lit("categorical")
        elif isinstance(kind, T.NumericType):
            name = F.when(d <= F.least(F.lit(few), n * share), "categorical").otherwise("numeric")
        else:
            text = x.cast("string")
            lists = F.avg(text.rlike(r"^\s*\[.*\]\s*$").cast("double"))
            name = F.when(n == 0, "text").when(lists > 0.5, "mvf").when(F.avg(F.length(text)) > long_text, "long_text").when(d <= n * 0.5, "categorical").otherwise("text")
        cells.append(F.struct(F.lit(f).alias("field"), name.alias("kind")))
    return _exploded(df, cells)


def entropy_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: known values, distinct ones, entropy in bits, normalized (by the logarithm of distinct values), uniqueness."""
    out = None
    for f in fields:
        c = df.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("v")).agg(F.count("*").cast("double").alias("c"))
        # Entropy from sums alone: log2 n - sum(c log2 c) / n.
        r = c.agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum(F.col("c") * F.log2("c")).alias("s"))
        h = F.log2("n") - F.col("s") / F.col("n")
        r = r.select(F.lit(f).alias("field"), F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n"), F.col("d").alias("distinct_values"), F.round(h, 6).alias("entropy"), F.round(F.when(F.col("d") > 1, h / F.log2(F.col("d").cast("double"))).otherwise(0.0), 6).alias("normalized"), F.round(F.try_divide("d", "n"), 6).alias("uniqueness"))
        out = r if out is None else out.unionByName(r)
    return out


#: Confidence of a role by name: whole words of the column's name, else parts of it.
NAME_WORD, NAME_PART = 0.9, 0.7


def resolve_roles(df: DataFrame, fields: Sequence[str], words: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(field, by_name, name_confidence, by_statistics, role): a role by name from 0.7 on wins, else the role by uniqueness and entropy."""
    words = words or ROLE_WORDS
    e = entropy_profile(df, fields)
    by_name, sure = F.lit(None).cast("string"), F.lit(0.0)
    for f in fields:
        parts = f.lower().split("_")
        whole = next((r for r, ws in words.items() if any(w in parts for w in ws)), None)
        part = next((r for r, ws in words.items() if any(w in f.lower() for w in ws)), None)
        by_name = F.when(F.col("field") == f, F.lit(whole or part)).otherwise(by_name)
        sure = F.when(F.col("field") == f, F.lit(NAME_WORD if whole else NAME_PART if part else 0.0)).otherwise(sure)
    stat = F.when(F.col("uniqueness") > 0.9, "INDIRECT").when((F.col("uniqueness") > 0.2) | (F.col("entropy") > 4), "QUASI").otherwise("NON_SENSITIVE")
    return e.select("field", by_name.alias("by_name"), sure.alias("name_confidence"), stat.alias("by_statistics"), F.when(sure >= 0.7, by_name).otherwise(stat).alias("role"))


def outlier_counts(df: DataFrame, fields: Sequence[str], z: float = 3.0, modified: float = 3.5) -> DataFrame:
    """A row for each field: values beyond ``z`` sample deviations, and those whose 0.6745 |x - median| / (1.4826 MAD) exceeds ``modified``."""
    xs = {f: F.col(f).cast("double") for f in fields}
    a = df.agg(*[c for i, x in enumerate(xs.values()) for c in (F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.median(x).alias(f"d{i}"))]).first()
    away = {f: F.abs(x - F.lit(a[f"d{i}"])) for i, (f, x) in enumerate(xs.items())}
    mad = df.agg(*[F.median(d).alias(f"a{i}") for i, d in enumerate(away.values())]).first()
    cells = []
    for i, (f, x) in enumerate(xs.items()):
        zs = F.count_if(F.abs(x - F.lit(a[f"m{i}"])) / F.lit(a[f"s{i}"] or float("inf")) > z)
        ms = F.count_if(0.6745 * away[f] / F.lit(1.4826 * mad[f"a{i}"] or float("inf")) > modified)
        cells.append(F.struct(F.lit(f).alias("field"), zs.alias("z_outliers"), ms.alias("modified_z_outliers")))
    return _exploded(df, cells)


def normality(df: DataFrame, fields: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """A row for each field: skewness, excess kurtosis, the Jarque-Bera statistic over all values, its p-value, whether normality stands."""
    cells = []
    for f in fields:
        x = F.col(f).cast("double")
        s, k, n = F.skewness(x), F.kurtosis(x), F.count(x)
        jb = n / 6.0 * (s * s + k * k / 4)
        cells.append(F.struct(F.lit(f).alias("field"), n.alias("n"), F.round(s, 6).alias("skewness"), F.round(k, 6).alias("kurtosis"), F.round(jb, 4).alias("statistic"), F.round(F.exp(-jb / 2), 6).alias("p_value"), (F.exp(-jb / 2) > alpha).alias("normal")))
    return _exploded(df, cells)


def significant_pairs(df: DataFrame, fields: Sequence[str], least: float = 0.7, nulls: str = "pairwise", fill: float = 0.0) -> DataFrame:
    """(a, b, r, n, t): pairs of fields correlated by ``least`` or more either way, with the t statistic.

    nulls: ``pairwise`` (rows where both are known), ``drop`` (rows where all are), ``fill`` (nulls become ``fill``).
    """
    if nulls == "drop":
        df = df.dropna(subset=list(fields))
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(fill)) if nulls == "fill" else F.col(f).cast("double") for f in fields}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(x[a], x[b]).alias("r"), F.count_if(x[a].isNotNull() & x[b].isNotNull()).alias("n")) for a, b in combinations(fields, 2)]
    r = F.col("r")
    t = r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))
    return _exploded(df, cells).where(F.abs(r) >= least).select("a", "b", F.round("r", 6).alias("r"), "n", F.round(t, 4).alias("t"))


def point_biserial(df: DataFrame, flag: Column, field: str) -> DataFrame:
    """One row: the correlation of a condition with a number."""
    return df.agg(F.round(F.corr(flag.cast("double"), F.col(field).cast("double")), 6).alias("r"))


def k_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(k, groups, records): how many groups have each size."""
    return group_sizes(df, keys).groupBy("k").agg(F.count("*").alias("groups"), F.sum("k").alias("records"))


def date_changes(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row: groups, those with several days, and the greatest span in days."""
    day = F.to_date(field)
    g = df.dropna(subset=[key, field]).groupBy(key).agg(F.count_distinct(day).alias("d"), F.datediff(F.max(day), F.min(day)).alias("span"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("d") > 1).alias("changing"), F.max("span").alias("longest"))


def ages(df: DataFrame, field: str, today: str, output: str = "age") -> DataFrame:
    """Whole years up to ``today`` added to the rows; null where the date is later."""
    months = F.months_between(F.lit(today).cast("date"), F.to_date(field))
    return df.withColumn(output, F.when(months >= 0, F.floor(months / 12).cast("int")))


def phone_dictionary(df: DataFrame, field: str) -> DataFrame:
    """(country, area, n): country codes after a plus and the three digits that follow, of valid numbers; blank where there is none."""
    x = F.col(field).cast("string")
    ok = F.length(F.regexp_replace(x, r"\D", "")).between(7, 15) & x.rlike(r"^[+\d\s().-]+$")
    country = F.regexp_extract(x, r"^\+(\d{1,3})(?=\D)", 1)
    area = F.regexp_extract(F.regexp_replace(x, r"^\+\d{1,3}(?=\D)", ""), r"^\D*(\d{3})", 1)
    return df.where(ok).groupBy(country.alias("country"), area.alias("area")).agg(F.count("*").alias("n"))


def mvf_combinations(df: DataFrame, values: Column) -> DataFrame:
    """(combination, size, n): sets of values that occur together, in order."""
    c = F.array_join(F.array_sort(F.array_distinct(values)), " | ")
    return df.where(values.isNotNull()).groupBy(c.alias("combination")).agg(F.max(F.size(F.array_distinct(values))).alias("size"), F.count("*").alias("n"))


def mvf_sizes(df: DataFrame, values: Column) -> DataFrame:
    """(size, n): rows by the number of their values; null counts as none."""
    return df.groupBy(F.coalesce(F.when(values.isNotNull(), F.size(values)), F.lit(0)).alias("size")).agg(F.count("*").alias("n"))


def group_variation(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each field: mean over groups of (distinct - 1) / (rows - 1), weighted by rows too; groups of one row vary by nothing."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), *[F.count_distinct(f).alias(f"d{i}") for i, f in enumerate(fields)])
    v = lambda i: F.when(F.col("__n") > 1, F.greatest(F.col(f"d{i}") - 1, F.lit(0)) / (F.col("__n") - 1)).otherwise(0.0)
    return _exploded(g, [F.struct(F.lit(f).alias("field"), F.round(F.avg(v(i)), 6).alias("variation"), F.round(F.sum(v(i) * F.col("__n")) / F.sum("__n"), 6).alias("weighted")) for i, f in enumerate(fields)])


def change_frequency(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row for each field: steps from row to row of a group, and the share of them that change the field."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.where(F.col(key).isNotNull()).select(F.row_number().over(w).alias("__at"), *[(~F.col(f).eqNullSafe(F.lag(f).over(w))).alias(f"c{i}") for i, f in enumerate(fields)]).where("__at > 1")
    return _exploded(rows, [F.struct(F.lit(f).alias("field"), F.count("*").alias("steps"), F.round(F.avg(F.col(f"c{i}").cast("double")), 6).alias("changing")) for i, f in enumerate(fields)])


def cross_groups(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: value combinations of the fields, those in several groups, and how many groups they join at most."""
    g = df.dropna(subset=[key]).groupBy(*fields).agg(F.count_distinct(key).alias("g"))
    return g.agg(F.count("*").alias("combinations"), F.count_if(F.col("g") > 1).alias("shared"), F.max("g").alias("most_groups"))


def collapsibility(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: groups of several rows, those in which no field varies, and the rows saved by making one of each."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*fields)).alias("d")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("d") == 1).alias("collapsible"), F.coalesce(F.sum(F.when(F.col("d") == 1, F.col("n") - 1)), F.lit(0)).alias("rows_saved"))


def identity_consistency(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """A row for each field: keys of several rows, and the share of them for which the field has one value."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), *[F.count_distinct(f).alias(f"d{i}") for i, f in enumerate(fields)]).where("__n > 1")
    return _exploded(g, [F.struct(F.lit(f).alias("field"), F.count("*").alias("keys"), F.round(F.avg((F.col(f"d{i}") <= 1).cast("double")), 6).alias("consistent")) for i, f in enumerate(fields)])


def field_level(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row for each field: type, known values, nulls in percent, distinct values, and the least and greatest as text."""
    cells = [
        F.struct(F.lit(f).alias("field"), F.lit(df.schema[f].dataType.simpleString()).alias("type"), F.count(f).alias("n"), F.round(100 * F.avg(F.col(f).isNull().cast("double")), 4).alias("null_pct"), F.count_distinct(f).alias("distinct_values"), F.min(f).cast("string").alias("least"), F.max(f).cast("string").alias("greatest"))
        for f in fields
    ]
    return _exploded(df, cells)
