"""Synthetic replacement values: the same value always gets the same replacement.

A pick is a keyed hash of the value modulo a list's length; lists are short
constants of the caller or the small ones here, so all of it is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import places

# Small lists of invented defaults; callers bring their own.
FIRST_F = ("Ada", "Berta", "Clara", "Dora", "Edith", "Frieda", "Gerda", "Hanna")
FIRST_M = ("Anton", "Boris", "Carl", "David", "Emil", "Fritz", "Georg", "Hugo")
LAST = ("Abel", "Brandt", "Corte", "Dahl", "Ebner", "Falk", "Grimm", "Holt", "Iversen", "Jansen", "Keller", "Lorenz")
DOMAINS = ("example.com", "example.org", "example.net")
ORG_STEMS = ("Nord", "Alpha", "Linden", "Orion", "Delta", "Quartz", "Silver", "Union")
ORG_KINDS = {"bank": "Bank", "school": "Academy", "hospital": "Clinic", "shop": "Stores"}
_FEMALE, _MALE = ("f", "female", "w", "ж", "жен"), ("m", "male", "м", "муж")


def pick_number(value: Column, salt: str, n: int) -> Column:
    """From 0 to n - 1, by the first 32 bits of SHA-256 of salt and value."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(value.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def pick(value: Column, salt: str, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), pick_number(value, salt, len(options)) + 1)


def fake_name(df: DataFrame, field: str, gender: str | None = None, form: str = "first last", seed: str = "42", first_f: Sequence[str] = FIRST_F, first_m: Sequence[str] = FIRST_M, last: Sequence[str] = LAST, output: str | None = None) -> DataFrame:
    """Forms: ``first last``, ``last first``, ``first``, ``last``.  Without a known gender, one is picked with the name."""
    x = F.col(field)
    g = F.lower(F.col(gender).cast("string")) if gender else F.lit(None).cast("string")
    female, male = pick(x, f"{seed}-f", first_f), pick(x, f"{seed}-m", first_m)
    first = F.when(g.isin(*_FEMALE), female).when(g.isin(*_MALE), male).when(pick_number(x, f"{seed}-g", 2) == 0, female).otherwise(male)
    parts = {"first": first, "last": pick(x, f"{seed}-l", last)}
    return df.withColumn(output or field, F.when(x.isNotNull(), F.concat_ws(" ", *[parts[p] for p in form.split()])))


def fake_email(df: DataFrame, field: str, form: str = "name_surname", separator: str = ".", digits: int = 0, seed: str = "42", domains: Sequence[str] = DOMAINS, output: str | None = None) -> DataFrame:
    """Forms: name_surname, surname_name, nickname, existing_domain (the value's own domain stays)."""
    x = F.col(field).cast("string")
    first, last = F.lower(pick(x, f"{seed}-f", FIRST_F + FIRST_M)), F.lower(pick(x, f"{seed}-l", LAST))
    local = {"name_surname": F.concat(first, F.lit(separator), last), "existing_domain": F.concat(first, F.lit(separator), last), "surname_name": F.concat(last, F.lit(separator), first), "nickname": F.concat(last, F.substring(first, 1, 1))}[form]
    if digits:
        local = F.concat(local, F.lpad(pick_number(x, f"{seed}-n", 10**digits).cast("string"), digits, "0"))
    domain = pick(x, f"{seed}-d", domains)
    if form == "existing_domain":
        own = F.regexp_extract(x, r"@([^@\s]+\.[^@\s]+)$", 1)
        domain = F.when(own != "", own).otherwise(domain)
    return df.withColumn(output or field, F.when(x.isNotNull(), F.concat(local, F.lit("@"), domain)))


def fake_phone(df: DataFrame, field: str, keep_country: bool = True, keep_area: bool = False, seed: str = "42", output: str | None = None) -> DataFrame:
    """Each digit that is not kept becomes one picked by the whole value and its place; the format stays."""
    x = F.col(field).cast("string")
    country = F.regexp_extract(x, r"^(\+\d{1,3})", 1) if keep_country else F.lit("")
    area = F.regexp_extract(F.substring(x, F.length(country) + 1, F.length(x)), r"^(\D*\d{3})", 1) if keep_area else F.lit("")
    head = F.concat(country, area)
    h = F.sha2(F.concat(F.lit(seed), x).cast("binary"), 256)
    rest = F.split(F.substring(x, F.length(head) + 1, F.length(x)), "")
    # The digit at a place is picked by four hex digits of the hash, from a place of their own.
    own = lambda i: F.conv(F.substring(h, (i % 60) + 1, F.lit(4)), 16, 10).cast("long") + F.floor(i / 60)
    new = F.array_join(F.transform(rest, lambda c, i: F.when(c.rlike(r"^\d$"), F.pmod(own(i), F.lit(10)).cast("string")).otherwise(c)), "")
    return df.withColumn(output or field, F.when(x.isNotNull(), F.concat(head, new)))


def fake_organization(df: DataFrame, field: str, seed: str = "42", output: str | None = None) -> DataFrame:
    """The kind of organization that the name tells stays."""
    x = F.col(field).cast("string")
    kind = F.lit("Group")
    for key, word in ORG_KINDS.items():
        kind = F.when(F.lower(x).contains(key), word).otherwise(kind)
    return df.withColumn(output or field, F.when(x.isNotNull(), F.concat_ws(" ", pick(x, f"{seed}-o", ORG_STEMS), pick(x, f"{seed}-l", LAST), kind)))


def one_to_one(df: DataFrame, field: str, options: DataFrame, seed: int = 42) -> DataFrame:
    """(original, pseudonym): each distinct value gets an option of its own (column value), never itself where another is left.

    Both sides are ordered by a hash of the value and paired by place.
    """
    a = df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("original")).distinct()
    b = options.select(F.col("value").cast("string").alias("pseudonym")).distinct().join(a, F.col("pseudonym") == F.col("original"), "left_anti")
    shuffled = lambda c: [F.md5(F.concat(F.lit(f"{seed}:"), F.col(c)).cast("binary")), F.col(c)]
    a, b = places(a, shuffled("original"), "n"), places(b, shuffled("pseudonym"), "n")
    return a.join(b, "n", "left").select("original", "pseudonym")


def resolve_chains(mapping: DataFrame, most: int = 32) -> DataFrame:
    """(original, pseudonym, steps, cycle): pseudonyms that are originals themselves are followed to the end of their chain."""
    m = mapping.select(F.col("original").alias("__o"), F.col("pseudonym").alias("__p"))
    now = mapping.select("original", "pseudonym", F.lit(1).alias("steps"), F.lit(False).alias("cycle"))
    for _ in range(most):
        step = now.join(m, (now["pseudonym"] == m["__o"]) & ~now["cycle"] & (m["__o"] != m["__p"]), "left")
        now = step.select("original", F.coalesce("__p", "pseudonym").alias("pseudonym"), (F.col("steps") + F.col("__p").isNotNull().cast("int")).alias("steps"), (F.col("cycle") | (F.coalesce("__p", "pseudonym") == F.col("original"))).alias("cycle"), F.col("__p").isNotNull().alias("__more"))
        if now.where(F.col("__more") & ~F.col("cycle")).isEmpty():
            break
        now = now.drop("__more").checkpoint() if mapping.sparkSession.sparkContext.getCheckpointDir() else now.drop("__more")
    return now.select("original", "pseudonym", "steps", "cycle")


def merge_maps(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    a, b = old.toDF("original", "__a"), new.toDF("original", "__b")
    first, second = ("__b", "__a") if overwrite else ("__a", "__b")
    return a.join(b, "original", "full").select("original", F.coalesce(first, second).alias("pseudonym"))


def generation_metrics(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: rows, share replaced, distinct values before and after."""
    changed = F.coalesce(F.col(before).cast("string") != F.col(after), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.round(F.avg(changed.cast("double")), 6).alias("replaced"), F.count_distinct(before).alias("distinct_before"), F.count_distinct(after).alias("distinct_after"))


@dataclass(frozen=True)
class Generator:
    """A kind of value: a column made of a key column, and the pattern that its values match."""

    name: str
    make: Callable[[Column, str], Column]
    pattern: str

    def generate(self, spark: SparkSession, n: int, seed: str = "42") -> DataFrame:
        """(value) of ``n`` rows."""
        return spark.range(n).select(self.make(F.col("id").cast("string"), seed).alias("value"))

    def generate_like(self, value: Column, seed: str = "42") -> Column:
        """The same replacement for the same value; nulls stay null."""
        return F.when(value.isNotNull(), self.make(value.cast("string"), seed))

    def transform(self, df: DataFrame, field: str, mode: str = "REPLACE", seed: str = "42", mapping: DataFrame | None = None) -> DataFrame:
        """REPLACE changes the field, ENRICH adds ``_field``; a ``mapping`` (original, pseudonym) goes before generated values."""
        out = self.generate_like(F.col(field), seed)
        if mapping is not None:
            df = df.join(mapping.select(F.col("original").alias("__o"), F.col("pseudonym").alias("__p")), F.col(field).cast("string") == F.col("__o"), "left")
            out = F.coalesce(F.col("__p"), out)
        return df.withColumn(field if mode == "REPLACE" else f"_{field}", out).drop("__o", "__p")

    def validate(self, value: Column) -> Column:
        return F.coalesce(value.rlike(f"^(?:{self.pattern})$"), F.lit(False))


# What syllable names are made of.
_HEADS = ("Al", "Be", "Ca", "Do", "El", "Fa", "Gi", "Ha", "Il", "Jo", "Ka", "Lu", "Ma", "No", "Or", "Pa")
_MIDDLES = ("ba", "di", "fe", "go", "ki", "la", "mi", "ne", "ra", "ri", "sa", "so", "ta", "ti", "va", "ve")
_TAILS = ("n", "na", "ra", "s", "lo", "ta", "rin", "la", "mir", "da", "vo", "sk", "ner", "man", "tti", "ez")


def syllable_name(key: Column, seed: str) -> Column:
    """One of 4096 invented names."""
    return F.concat(pick(key, f"{seed}-h", _HEADS), pick(key, f"{seed}-m", _MIDDLES), pick(key, f"{seed}-t", _TAILS))


GENERATORS = {
    g.name: g
    for g in (
        Generator("name", lambda k, s: F.concat_ws(" ", syllable_name(k, f"{s}-first"), syllable_name(k, f"{s}-last")), r"[A-Z][a-z]+ [A-Z][a-z]+"),
        Generator("email", lambda k, s: F.concat(F.lower(syllable_name(k, f"{s}-first")), F.lit("."), F.lower(syllable_name(k, f"{s}-last")), F.lit("@"), pick(k, f"{s}-d", DOMAINS)), r"[a-z]+\.[a-z]+@example\.(com|org|net)"),
        Generator("organization", lambda k, s: F.concat_ws(" ", syllable_name(k, f"{s}-org"), pick(k, f"{s}-kind", tuple(ORG_KINDS.values()))), r"[A-Z][a-z]+ [A-Z][a-z]+"),
        Generator("phone", lambda k, s: F.concat(F.lit("+1-555-"), F.lpad(pick_number(k, f"{s}-a", 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(pick_number(k, f"{s}-b", 10000).cast("string"), 4, "0")), r"\+1-555-\d{3}-\d{4}"),
    )
}
