"""Full and partial masking by expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators that position masking keeps, and the patterns by name.
SEPARATORS = r"\-_.@/\\:; ()\[\]"
PATTERNS = {
    "email": r"^([^@\s]+)(@)([^@\s]+\.[^@\s]+)$",
    "phone": r"^(\+?\d{0,3}[\s-]?)(\(?\d{3}\)?)([\s.-]?)(\d{3})([\s.-]?)(\d{4})$",
    "ssn": r"^(\d{3})(-?)(\d{2})(-?)(\d{4})$",
    "credit_card": r"^(\d{4})([\s-]?)(\d{4})([\s-]?)(\d{4})([\s-]?)(\d{4})$",
    "ipv4": r"^(\d{1,3})(\.)(\d{1,3})(\.)(\d{1,3})(\.)(\d{1,3})$",
    "date_iso": r"^(\d{4})(-)(\d{2})(-)(\d{2})$",
    "date_us": r"^(\d{1,2})(/)(\d{1,2})(/)(\d{4})$",
    "iban": r"^([A-Z]{2})(\d{2})([A-Z0-9]{11,30})$",
    "url": r"^(https?)(://)(\S+)$",
}
#: Which groups of a pattern stay when it is masked partially.
KEPT_GROUPS = {
    "email": (2, 3), "phone": (1, 3, 5, 6), "ssn": (2, 4, 5), "credit_card": (2, 4, 6, 7), "ipv4": (1, 2, 3, 4, 6), "date_iso": (1, 2, 4), "date_us": (2, 4, 5), "iban": (1,), "url": (1, 2),
}


def stars(length: Column, char: str = "*") -> Column:
    return F.repeat(F.lit(char), length.cast("int"))


def full_mask(df: DataFrame, field: str, char: str = "*", keep_length: bool = True, length: int | None = None, output: str | None = None) -> DataFrame:
    """Every character masked; of a fixed length, or as long as the text, or 8.  Nulls stay null."""
    text = F.col(field).cast("string")
    size = F.lit(length) if length is not None else F.length(text) if keep_length else F.lit(8)
    return df.withColumn(output or field, F.when(text.isNotNull(), stars(size, char)))


def mask_groups(text: Column, pattern: str, kept: Sequence[int] = (), char: str = "*", groups: int | None = None) -> Column:
    """Groups of a matching pattern masked one by one, but those ``kept``."""
    n = groups if groups is not None else pattern.replace(r"\(", "").replace("(?", "").count("(")
    parts = []
    for k in range(1, n + 1):
        part = F.regexp_extract(text, pattern, k)
        parts.append(part if k in kept else F.regexp_replace(part, r"[\p{L}\p{N}]", char))
    return F.concat(*parts)


def mask_by_format(df: DataFrame, field: str, names: Sequence[str] = tuple(PATTERNS), char: str = "*", output: str | None = None) -> DataFrame:
    """Letters and digits of the first pattern that matches are masked, its separators stay; other texts are masked whole."""
    text = F.col(field).cast("string")
    new: Column | None = None
    for name in names:
        p = PATTERNS[name]
        got = mask_groups(text, p, (), char)
        new = F.when(text.rlike(p), got) if new is None else new.when(text.rlike(p), got)
    rest = stars(F.length(text), char)
    return df.withColumn(output or field, F.when(text.isNotNull(), rest if new is None else new.otherwise(rest)))


def mask_numbers(df: DataFrame, field: str, digit: str = "9", output: str | None = None) -> DataFrame:
    """Digits become ``digit``; sign, point and type stay."""
    kind = df.schema[field].dataType
    text = F.regexp_replace(F.col(field).cast("string"), r"\d", digit)
    return df.withColumn(output or field, text.try_cast(kind) if kind.typeName() not in ("string",) else text)


def detect_pattern(text: Column) -> Column:
    """Name of the first pattern that matches, else null."""
    out: Column | None = None
    for name, p in PATTERNS.items():
        out = F.when(text.rlike(p), name) if out is None else out.when(text.rlike(p), name)
    return out


def mask_middle(df: DataFrame, field: str, prefix: int = 0, suffix: int = 0, char: str = "*", keep_separators: bool = True, output: str | None = None) -> DataFrame:
    """``prefix`` and ``suffix`` characters stay; a text no longer than both stays whole."""
    text = F.col(field).cast("string")
    middle = F.substring(text, F.lit(prefix + 1), F.greatest(F.length(text) - prefix - suffix, F.lit(0)))
    masked = F.regexp_replace(middle, f"[^{SEPARATORS}]" if keep_separators else r"(?s).", char)
    new = F.concat(F.substring(text, 1, prefix), masked, F.substring(text, F.length(text) - suffix + 1, F.lit(suffix)))
    return df.withColumn(output or field, F.when(F.length(text) <= prefix + suffix, text).otherwise(new))


def mask_positions(df: DataFrame, field: str, kept: Sequence[int], char: str = "*", output: str | None = None) -> DataFrame:
    """Characters at the places ``kept`` (from 0) stay, separators too."""
    text = F.col(field).cast("string")
    new = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i.isin(list(kept)) | c.rlike(f"^[{SEPARATORS}]$"), c).otherwise(char)), "")
    return df.withColumn(output or field, new)


def mask_pattern(df: DataFrame, field: str, name: str, kept: Sequence[int] | None = None, char: str = "*", output: str | None = None) -> DataFrame:
    """A named pattern masked but for its kept groups; texts that do not match are masked whole."""
    text = F.col(field).cast("string")
    p = PATTERNS[name]
    got = mask_groups(text, p, KEPT_GROUPS[name] if kept is None else kept, char)
    return df.withColumn(output or field, F.when(text.rlike(p), got).otherwise(stars(F.length(text), char)))


def mask_regex(df: DataFrame, field: str, pattern: str, replacement: str = "*", output: str | None = None) -> DataFrame:
    return df.withColumn(output or field, F.regexp_replace(F.col(field).cast("string"), pattern, replacement))


def mask_share(df: DataFrame, field: str, percent: float, seed: int = 42, char: str = "*", output: str | None = None) -> DataFrame:
    """A share of the characters, chosen by a hash of text, place and seed: the same each time."""
    text = F.col(field).cast("string")
    n = F.floor(F.length(text) * percent / 100).cast("int")
    order = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), i, text).cast("binary")).alias("h"), i.alias("i")))
    hit = F.transform(F.slice(F.array_sort(order), F.lit(1), F.greatest(n, F.lit(0))), lambda s: s["i"])
    new = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(F.array_contains(hit, i), char).otherwise(c)), "")
    return df.withColumn(output or field, F.when((text == "") | text.isNull(), text).otherwise(new))


def mask_words(df: DataFrame, field: str, prefix: int = 1, suffix: int = 0, char: str = "*", output: str | None = None) -> DataFrame:
    """Words of up to three characters are masked whole, longer ones keep their ends; white space becomes one space."""
    text = F.col(field).cast("string")

    def one(w: Column) -> Column:
        ends = F.concat(F.substring(w, 1, prefix), stars(F.greatest(F.length(w) - prefix - suffix, F.lit(0)), char), F.substring(w, F.length(w) - suffix + 1, F.lit(suffix)))
        return F.when(F.length(w) <= 3, stars(F.length(w), char)).otherwise(ends)

    return df.withColumn(output or field, F.array_join(F.transform(F.split(F.trim(text), r"\s+"), one), " "))


def mask_alphanumeric(df: DataFrame, field: str, char: str = "*", output: str | None = None) -> DataFrame:
    return df.withColumn(output or field, F.regexp_replace(F.col(field).cast("string"), r"[\p{L}\p{N}]", char))


def mask_email(df: DataFrame, field: str, preset: str = "full_local", output: str | None = None) -> DataFrame:
    """Presets: full_local, first_char, first_two, domain_only (local part hidden), partial_domain (first character; last domain label hidden).

    Texts without exactly one ``@`` stay unchanged.
    """
    text = F.col(field).cast("string")
    parts = F.split(text, "@")
    local, domain = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    kept = {"full_local": 0, "domain_only": 0, "first_char": 1, "first_two": 2, "partial_domain": 1}[preset]
    shown = F.concat(F.substring(local, 1, kept), stars(F.greatest(F.length(local) - kept, F.lit(0))))
    if preset == "partial_domain":
        last = F.regexp_extract(domain, r"([^.]*)$", 1)
        domain = F.concat(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), stars(F.length(last)))
    return df.withColumn(output or field, F.when(F.size(parts) == 2, F.concat(shown, F.lit("@"), domain)).otherwise(text))


def mask_phone(df: DataFrame, field: str, preset: str = "last_four", output: str | None = None) -> DataFrame:
    """Presets: full, last_four, area_code.  Fewer than ten digits: unchanged; all but digits stays."""
    text = F.col(field).cast("string")
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    # A digit is hidden if enough digits follow it (last_four) or precede it (area_code: the first three stay).
    hidden = {"full": r"\d", "last_four": r"\d(?=(?:\D*\d){4})", "area_code": r"(?<=\d\D{0,3}\d\D{0,3}\d\D{0,40})\d"}[preset]
    if preset == "area_code":
        head = F.regexp_extract(text, r"^((?:\D*\d){3})", 1)
        new = F.concat(head, F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), r"\d", "*"))
    else:
        new = F.regexp_replace(text, hidden, "*")
    return df.withColumn(output or field, F.when(digits < 10, text).otherwise(new))


def mask_card(df: DataFrame, field: str, keep_first: int = 0, keep_last: int = 4, output: str | None = None) -> DataFrame:
    """Card numbers of 13 to 19 digits: all digits but the first and last ones hidden, separators kept."""
    text = F.col(field).cast("string")
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    head = F.regexp_extract(text, rf"^((?:\D*\d){{{keep_first}}})", 1) if keep_first else F.lit("")
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    new = F.concat(head, F.regexp_replace(rest, rf"\d(?=(?:\D*\d){{{keep_last}}})" if keep_last else r"\d", "*"))
    return df.withColumn(output or field, F.when(digits.between(13, 19), new).otherwise(text))


def mask_ip(df: DataFrame, field: str, preset: str = "subnet", output: str | None = None) -> DataFrame:
    """Presets: subnet (two numbers stay), network (one stays), zero (0.0.0.0); other texts stay."""
    text, p = F.col(field).cast("string"), PATTERNS["ipv4"]
    new = {"zero": F.lit("0.0.0.0"), "subnet": F.regexp_replace(text, p, "$1.$3.*.*"), "network": F.regexp_replace(text, p, "$1.*.*.*")}[preset]
    return df.withColumn(output or field, F.when(text.rlike(p), new).otherwise(text))
