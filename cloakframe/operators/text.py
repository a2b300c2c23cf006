"""Text: normalization, words, n-grams, similarity, dictionaries, languages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import steps

#: Cells of hashes that words are counted in: a power of two.
COUNT_CELLS = 1 << 21
# A few function words of each language, for votes.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was"),
    "fr": ("le", "la", "les", "des", "et", "un", "une", "est", "pour", "que"),
    "de": ("der", "die", "das", "und", "ist", "von", "mit", "nicht", "ein", "zu"),
    "es": ("el", "los", "las", "del", "y", "un", "una", "es", "por", "con"),
}


def words(col: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


@F.pandas_udf(T.StringType())
def strip_accents(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)), na_action="ignore")


def word_frequency(df: DataFrame, field: str, least_length: int = 1, stop: Sequence[str] = (), top: int | None = None) -> DataFrame:
    w = df.select(F.explode(words(F.col(field))).alias("word")).where(F.length("word") >= least_length)
    if stop:
        w = w.where(~F.col("word").isin(list(stop)))
    c = w.groupBy("word").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "word").limit(top) if top else c


def ngrams(col: Column, n: int) -> Column:
    w = words(col)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def ngram_counts(df: DataFrame, field: str, n: int = 2, least: int = 2) -> DataFrame:
    """(ngram, n) of those that occur ``least`` times."""
    w = df.select(words(F.col(field)).alias("w")).where(F.size("w") >= n)
    grams = w.select(F.explode(F.arrays_zip(*[F.slice("w", F.lit(k + 1), F.size("w") - n + 1).alias(f"g{k}") for k in range(n)])).alias("g"))
    return grams.groupBy(F.concat_ws(" ", *[F.col(f"g.g{k}") for k in range(n)]).alias("ngram")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: Hashes are taken modulo a prime below 2**31, so products fit a long; a gram's words are digits of a number to this base.
HASH_PRIME, GRAM_FACTOR = 2**31 - 1, 1_000_003


def minhash(col: Column, seeds: int = 128, n: int = 3) -> Column:
    """Least hash of the word n-grams for each seed; shorter texts are one gram of all their words, without words all is the prime itself.

    A word counts as the first 31 bits of its MD5; seed s maps a gram x to
    (7919 s + 104729) x + 15485863 s modulo the prime.
    """
    s = np.arange(1, seeds + 1, dtype=np.int64)
    factor, shift = s * 7919 + 104_729, s * 15_485_863

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def signature(words: pd.Series) -> pd.Series:
        def least(x: np.ndarray | None) -> np.ndarray | None:
            if x is None:
                return None
            out = np.full(seeds, HASH_PRIME, np.int64)
            x = np.array(x, np.int64) % HASH_PRIME
            k = min(n, len(x))
            grams = x[: len(x) - k + 1]
            for j in range(1, k):
                grams = (grams * GRAM_FACTOR + x[j : len(x) - k + 1 + j]) % HASH_PRIME
            for i in range(0, len(grams) if k else 0, 4096):
                out = np.minimum(out, ((grams[i : i + 4096][None] * factor[:, None] + shift[:, None]) % HASH_PRIME).min(1))
            return out

        return words.map(least)

    return signature(F.transform(words(col), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(2**31 - 1)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(0.0))


def dictionary_match(df: DataFrame, id_field: str, field: str, entries: DataFrame) -> DataFrame:
    """(id, category): the entry (keyword, category, level) whose keyword the text holds as a word, deepest level, then longest keyword, first.

    Words are joined to keywords, so neither table is compared in full.
    """
    w = df.select(F.col(id_field), F.explode(F.array_distinct(words(F.col(field)))).alias("keyword"))
    hit = w.join(entries, "keyword")
    rank = F.row_number().over(Window.partitionBy(id_field).orderBy(F.desc("level"), F.desc(F.length("keyword")), "keyword"))
    return hit.withColumn("__r", rank).where("__r = 1").select(id_field, "keyword", "category")


def language_vote(df: DataFrame, id_field: str, field: str) -> DataFrame:
    """(id, language): the language with the most function words, ties by name; null without any."""
    w = words(F.col(field))

    def votes(vocabulary: Sequence[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(list(vocabulary))))

    counts = [F.struct(votes(v).alias("n"), F.lit(k).alias("language")) for k, v in FUNCTION_WORDS.items()]
    best = F.array_sort(F.array(*counts), lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"])).otherwise(F.when(a["language"] < b["language"], -1).otherwise(1)))[0]
    return df.select(id_field, F.when(best["n"] > 0, best["language"]).alias("language"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def diversity(df: DataFrame, id_field: str, field: str) -> DataFrame:
    """(id, tokens, types, ttr, root_ttr, simpson) of each text."""
    w = df.select(id_field, F.explode(words(F.col(field))).alias("w")).groupBy(id_field, "w").agg(F.count("*").alias("c"))
    n = F.sum("c")
    g = w.groupBy(id_field).agg(n.alias("tokens"), F.count("*").alias("types"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    return g.select(id_field, "tokens", "types", F.round(F.col("types") / F.col("tokens"), 6).alias("ttr"), F.round(F.col("types") / F.sqrt("tokens"), 6).alias("root_ttr"), F.round(1 - F.col("s2") / (F.col("tokens") * F.col("tokens")), 6).alias("simpson"))


@F.pandas_udf(T.DoubleType())
def mtld(texts: pd.Series) -> pd.Series:
    """Mean of the forward and backward lengths of stretches until the type-token ratio falls to 0.72."""

    def one_way(w: list[str]) -> float:
        factors, seen, n = 0.0, set(), 0
        for x in w:
            n += 1
            seen.add(x)
            if len(seen) / n <= 0.72:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - 0.72)
        return len(w) / factors if factors else float(len(w))

    return texts.map(lambda t: (one_way(t.split()) + one_way(t.split()[::-1])) / 2 if t and t.split() else 0.0)


def collocations(df: DataFrame, field: str, least: int = 5) -> DataFrame:
    """(a, b, n, pmi): word pairs side by side, with their pointwise mutual information in bits."""
    w = df.select(words(F.col(field)).alias("w"))
    single = w.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    total = single.agg(F.sum("c").cast("double").alias("t"))
    pairs = w.where(F.size("w") >= 2).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    n = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = n.join(single.toDF("a", "ca"), "a").join(single.toDF("b", "cb"), "b").crossJoin(F.broadcast(total))
    return both.select("a", "b", "n", F.round(F.log2(F.col("n") * F.col("t") / (F.col("ca") * F.col("cb"))), 6).alias("pmi"))


# What entities look like, by kind.
ENTITY_PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "url": r"https?://[A-Za-z0-9./?=&_%#\-]+",
    "amount": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
}


def entities(df: DataFrame, id_field: str, field: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, value) of everything in the text that a pattern matches, in one pass."""
    found = [F.transform(F.regexp_extract_all(F.col(field), F.lit(p), F.lit(0)), _kind(k)) for k, p in (patterns or ENTITY_PATTERNS).items()]
    return df.select(id_field, F.explode(F.concat(*found)).alias("e")).select(id_field, "e.kind", "e.value")


def _kind(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def _similar_sets(keyed: DataFrame, threshold: float) -> tuple[DataFrame, list[str]]:
    """(id_a, id_b), each pair once, that may reach the threshold by Jaccard: all that do, and few others; and the paths that it lies in.

    Words are ordered by the count of their cell of hashes, which need not be
    exact, only the same for all.  A pair has to share one of the rarest words
    of both, at a place that leaves enough words behind it, and the parities
    of its words' hashes must not differ in more bits than it may in words.
    """
    spark = keyed.sparkSession
    hashed = keyed.where(F.size("set") > 0).select("id", F.transform("set", lambda w: F.xxhash64(w)).alias("h"))
    size = COUNT_CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            np.add.at(seen, b.column("h").flatten().to_numpy() & (size - 1), 1)
        cells = np.flatnonzero(seen)
        for k in range(0, len(cells), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cells[k : k + 100_000].astype(np.int32)), pa.array(seen[cells[k : k + 100_000]])], ["cell", "c"])

    counted, path = steps.write(hashed.select("h").mapInArrow(count, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")), "counts", 1000)
    table = counted.toArrow()
    steps.delete(spark, path)
    counts = np.zeros(size, np.int32)
    counts[table.column("cell").to_numpy()] = np.minimum(table.column("c").to_numpy(), 2**31 - 1)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, n = b.column("h").flatten().to_numpy(), b.column("h").value_lengths().to_numpy()
            row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            bits = np.left_shift(1, np.clip(np.ceil(np.log2(n)), 6, 16).astype(np.int64))
            base = np.cumsum(bits) - bits
            parity = np.packbits((np.bincount(base[row] + (h & (bits[row] - 1)), minlength=bits.sum()) & 1).astype(np.uint8), bitorder="little").tobytes()
            c = counts[h & (size - 1)]
            by = np.lexsort((h, c, row))
            i = np.arange(len(h)) - start[row]
            # A word of one text makes no pair.
            kept = (i < (n - np.ceil(n * threshold - 1e-9) + 1)[row]) & (c[by] > 1)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row[kept], minlength=len(n)))).astype(np.int32))
            words = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[by][kept], i[kept].astype(np.int32))]
            marks = pa.array([parity[s // 8 : (s + t) // 8] for s, t in zip(base, bits, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n.astype(np.int32)), marks, *words], ["id", "n", "bits", "word", "i"])

    marks, marks_path = steps.write(hashed.mapInArrow(marked, "id binary, n int, bits binary, word array<long>, i array<int>"), "marks", 1000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs within the rows of a word, which lie side by side in the order of ids."""

        def within(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            ids = t.column("id").combine_chunks().cast(pa.binary(16))
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            halves = np.frombuffer(ids.buffers()[1], "<u8")[2 * ids.offset : 2 * (ids.offset + len(ids))].reshape(-1, 2)
            word, n, i = (t.column(c).to_numpy() for c in ("word", "n", "i"))
            new = np.append(True, (word[1:] != word[:-1]) | (halves[1:] != halves[:-1]).any(1))
            at = np.flatnonzero(new)
            word, n, i = word[at], n[at].astype(np.int64), i[at].astype(np.int64)
            left, k, out, many = np.arange(len(at)), 0, [], 0
            while len(left):
                k += 1
                left = left[left + k < len(at)]
                left = left[word[left] == word[left + k]]
                most = np.minimum(n[left] - i[left], n[left + k] - i[left + k])
                good = left[most >= threshold * (n[left] + n[left + k] - most) - 1e-9]
                out.append((good, good + k))
                many += len(good)
                if many > 50_000 or not len(left):
                    x, y = (pa.array(at[np.concatenate(z)]) for z in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(x).cast(pa.binary()), ids.take(y).cast(pa.binary())], ["id_a", "id_b"])
                    out, many = [], 0

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column("word").to_numpy()
            last = int(np.searchsorted(word, word[-1]))
            if held and (last or held[-1].column("word")[-1].as_py() != word[0]):
                yield from within(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            elif last:
                yield from within(pa.Table.from_batches([b.slice(0, last)]))
            held.append(b.slice(last))
        if held:
            yield from within(pa.Table.from_batches(held))

    places = marks.select("id", "n", F.explode(F.arrays_zip("word", "i")).alias("x")).select("x.word", "id", "n", "x.i")
    pairs, pairs_path = steps.write(places.repartition("word").sortWithinPartitions("word", "id").mapInArrow(meet, "id_a binary, id_b binary").distinct(), "pairs")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def apart(a: bytes, b: bytes) -> int:
            short, long = sorted((a, b), key=len)
            x = int.from_bytes(short, "little")
            for k in range(0, len(long), len(short)):
                x ^= int.from_bytes(long[k : k + len(short)], "little")
            return x.bit_count()

        for b in batches:
            both = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            most = (both - np.array([apart(p, q) for p, q in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)], np.int64)) // 2
            at = pa.array(np.flatnonzero(most >= threshold * (both - most) - 1e-9))
            yield pa.RecordBatch.from_arrays([b.column("id_a").take(at), b.column("id_b").take(at)], ["id_a", "id_b"])

    once = marks.select("id", "n", "bits").dropDuplicates(["id"])
    for k in "ab":
        pairs = pairs.join(once.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "bits")]), f"id_{k}")
    close, close_path = steps.write(pairs.mapInArrow(near, "id_a binary, id_b binary"), "close")
    for path in (marks_path, pairs_path):
        steps.delete(spark, path)
    return close, [close_path]


def leader_clusters(df: DataFrame, field: str, threshold: float = 0.7) -> DataFrame:
    """(value, leader): each distinct value joins the first leader, in the order of values, whose words are similar enough, else leads.

    Values of the same words stand for each other.  Two sets can only be
    similar enough if they share one of their rarest words, as many as the
    threshold leaves open, so common words make no pairs.  Of the similar
    pairs, those whose earlier value is known to lead or to follow are settled
    in rounds, until all are; values without words lead alone.  Words and
    texts are read from ``df`` again where a step needs them, so that only the
    texts of pairs, and those of the result once, are moved.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    split = F.filter(F.split(F.lower("value"), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    values = df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value")).withColumn("set", F.array_sort(F.array_distinct(split)))
    # No word holds a space, so texts of equal words, and only they, have one name.
    values = values.withColumn("id", F.unhex(F.md5(F.array_join("set", " "))))
    pairs, paths = _similar_sets(values.select("id", "set"), threshold)
    paired = pairs.select(F.col("id_a").alias("id")).union(pairs.select("id_b")).distinct()
    sets, path = steps.write(values.join(paired, "id", "left_semi").groupBy("id").agg(F.min("value").alias("v"), F.first("set").alias("set")), "sets")
    paths.append(path)
    for k in "ab":
        pairs = pairs.join(sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "v", "set")]), f"id_{k}")
    both = F.size(F.array_intersect("set_a", "set_b"))
    pairs = pairs.where(both >= threshold * (F.size("set_a") + F.size("set_b") - both))
    links, path = steps.write(pairs.select(F.when(F.col("v_a") < F.col("v_b"), F.col("id_a")).otherwise(F.col("id_b")).alias("early"), F.when(F.col("v_a") < F.col("v_b"), F.col("id_b")).otherwise(F.col("id_a")).alias("late")), "links")
    paths.append(path)
    # Values with nothing similar before them lead.  A value follows if one before it leads, and leads if all before it
    # follow; each round settles the first unsettled value at least.
    state, path = steps.write(links.select(F.col("late").alias("id")).distinct().withColumn("leads", F.lit(None).cast("boolean")), "state")
    while state.where("leads is null").limit(1).count():
        early = state.select(F.col("id").alias("early"), F.coalesce(F.col("leads").cast("int"), F.lit(-1)).alias("is"))
        known = links.join(state.where("leads is null").select(F.col("id").alias("late")), "late").join(early, "early", "left").withColumn("is", F.coalesce("is", F.lit(1)))
        new = known.groupBy("late").agg(F.when(F.max("is") == 1, False).when(F.min("is") == 0, True).alias("new"))
        before = path
        state, path = steps.write(state.join(new.withColumnRenamed("late", "id"), "id", "left").select("id", F.coalesce("leads", "new").alias("leads")), "state")
        steps.delete(df.sparkSession, before)
    paths.append(path)
    followers = state.where("not leads").select("id")
    led = links.join(followers.withColumnRenamed("id", "early"), "early", "left_anti").join(followers.withColumnRenamed("id", "late"), "late")
    first, _ = steps.write(led.join(sets.select(F.col("id").alias("early"), "v"), "early").groupBy(F.col("late").alias("id")).agg(F.min("v").alias("first")), "leaders")
    for path in paths:
        steps.delete(df.sparkSession, path)
    # Rows of a name lie together once, for the distinct values, their first one and its leader.
    each = values.select("id", "value", F.size("set").alias("size")).repartition("id").dropDuplicates(["id", "value"])
    own = F.when(F.col("size") > 0, F.min("value").over(Window.partitionBy("id"))).otherwise(F.col("value"))
    return each.withColumn("own", own).join(first, "id", "left").select("value", F.coalesce("first", "own").alias("leader"))


def closest_match(df: DataFrame, field: str, options: Sequence[str], threshold: float = 0.0, output: str = "closest") -> DataFrame:
    """The most similar of a short list of options by edit distance (the first on ties), null below the threshold."""
    scored = F.array(*[F.struct((-similarity(F.lower(F.col(field)), F.lit(o.lower()))).alias("s"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    best = F.array_min(scored)
    return df.withColumn(output, F.when(-best["s"] >= threshold, best["o"]))


# Words too common to tell texts apart, by language.
STOP_WORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"),
    "fr": ("au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pour", "que", "qui", "sur", "un", "une"),
    "de": ("als", "am", "an", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es", "im", "in", "ist", "mit", "nicht", "sie", "und", "von", "zu"),
    "es": ("al", "como", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "o", "para", "por", "que", "se", "su", "un", "una", "y"),
}
#: Levels of normalization, each with what the one before it does: trimmed, lower case, single spaces; punctuation gone; digits gone.
LEVELS = ("none", "basic", "advanced", "aggressive")


def normalize_text(col: Column, level: str = "basic") -> Column:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    x = col
    if level != "none":
        x = F.lower(x)
    if level in ("advanced", "aggressive"):
        x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]+", " ")
    if level == "aggressive":
        x = F.regexp_replace(x, r"\p{N}+", " ")
    return x if level == "none" else F.trim(F.regexp_replace(x, r"\s+", " "))


def without_stop_words(col: Column, languages: Sequence[str] = ("en",), more: Sequence[str] = ()) -> Column:
    """Words of a text that are no stop word of the languages."""
    stop = sorted({w for k in languages for w in STOP_WORDS[k]} | set(more))
    return F.array_except(words(col), F.array(*[F.lit(w) for w in stop])) if not stop else F.filter(words(col), lambda w: ~w.isin(stop))


def lemmatize(df: DataFrame, id_field: str, field: str, lemmas: DataFrame) -> DataFrame:
    """(id, lemmas): words in their order, those of the dictionary (word, lemma) by their lemma."""
    w = df.select(F.col(id_field), F.posexplode(words(F.col(field))).alias("at", "word"))
    found = w.join(lemmas.select("word", "lemma").dropDuplicates(["word"]), "word", "left").groupBy(id_field).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("lemma", "word").alias("w")))).alias("x"))
    return found.select(id_field, F.col("x.w").alias("lemmas"))


def token_similarity(a: Column, b: Column) -> Column:
    """Common words of two texts by all of them."""
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def partial_similarity(a: Column, b: Column) -> Column:
    """1 where one text holds the other, else the similarity by edit distance."""
    x, y = F.lower(a), F.lower(b)
    return F.when((F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x)), 1.0).otherwise(similarity(x, y))


def character_shingles(col: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters of the lower-case text; a shorter text is one run."""
    x = F.lower(col)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def key_phrases(df: DataFrame, id_field: str, field: str, languages: Sequence[str] = ("en",), least: int = 2, most: int = 4) -> DataFrame:
    """(id, phrase, words, n): runs of ``least`` to ``most`` words between stop words and marks, with their number in the text."""
    stop = sorted({w for k in languages for w in STOP_WORDS[k]})
    cut = F.regexp_replace(F.lower(F.col(field)), r"[^\p{L}\p{N}\s]+", "|")
    marked = F.regexp_replace(F.regexp_replace(cut, r"\s+", "  "), rf"(^|[\s|])({'|'.join(stop)})(?=$|[\s|])", "$1|")
    p = df.select(id_field, F.explode(F.split(marked, r"\|")).alias("p")).select(id_field, F.trim(F.regexp_replace("p", r"\s+", " ")).alias("phrase"))
    p = p.withColumn("words", F.size(F.split("phrase", " "))).where((F.col("phrase") != "") & F.col("words").between(least, most))
    return p.groupBy(id_field, "phrase", "words").agg(F.count("*").alias("n"))


def msttr(df: DataFrame, id_field: str, field: str, segment: int = 50) -> DataFrame:
    """(id, segments, msttr): the mean type-token ratio of whole segments of words; null for shorter texts."""
    w = df.select(id_field, words(F.col(field)).alias("w"))
    n = F.floor(F.size("w") / segment).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.size(F.array_distinct(F.slice("w", k * segment + 1, F.lit(segment)))) / segment))
    return w.select(id_field, F.coalesce(n, F.lit(0)).alias("segments"), F.round(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / n, 6).alias("msttr"))


def sentiment(df: DataFrame, id_field: str, field: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """(id, positive, negative, score): words of two lists, and their difference by their sum."""
    w = words(F.col(field))
    many = lambda ws: F.size(F.filter(w, lambda x: x.isin(list(ws))))
    p, n = many(positive), many(negative)
    return df.select(id_field, p.alias("positive"), n.alias("negative")).withColumn("score", F.round(F.coalesce(F.try_divide(F.col("positive") - F.col("negative"), F.col("positive") + F.col("negative")), F.lit(0.0)), 6))


def categorize_texts(df: DataFrame, field: str, entries: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(value, category, how): each distinct value by the dictionary (keyword, category, level), else by what it looks like, else unresolved.

    A value holds a keyword as a run of characters; the deepest level, then
    the longest keyword, wins.  The dictionary is small: its size is checked.
    """
    if entries.count() > 10_000:
        raise ValueError("more entries than every value is compared with; use dictionary_match")
    values = df.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value")).distinct()
    held = values.join(F.broadcast(entries), F.lower("value").contains(F.lower("keyword")))
    best = held.groupBy("value").agg(F.max_by("category", F.struct("level", F.length("keyword"), "keyword")).alias("c"))
    look = F.lit(None).cast("string")
    for kind, p in reversed((patterns or ENTITY_PATTERNS).items()):
        look = F.when(F.col("value").rlike(p), kind).otherwise(look)
    out = values.join(best, "value", "left").withColumn("look", look)
    return out.select("value", F.coalesce("c", "look", F.lit("unresolved")).alias("category"), F.when(F.col("c").isNotNull(), "dictionary").when(F.col("look").isNotNull(), "pattern").otherwise("none").alias("how"))


def unprocessed(df: DataFrame, field: str, marker: str = "~") -> DataFrame:
    """Rows whose text does not carry the marker of work already done; nulls have nothing to do."""
    return df.where(F.col(field).isNotNull() & ~F.col(field).startswith(marker))


def mark_processed(col: Column, marker: str = "~") -> Column:
    return F.when(col.startswith(marker), col).otherwise(F.concat(F.lit(marker), col))


def tf_idf(df: DataFrame, id_field: str, fields: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """(id, token, weight): ``field:value`` tokens weighted by ln((1 + n) / (1 + df)) + 1, the weights of a row of length one.

    ``fit`` (else the rows themselves) tells n and df; tokens that it lacks are left out.
    """
    def tokens(rows: DataFrame) -> DataFrame:
        parts = F.array(*[F.concat(F.lit(f"{f}:"), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
        return rows.select(id_field, F.explode(parts).alias("token")).groupBy(id_field, "token").agg(F.count("*").alias("tf"))

    base = df if fit is None else fit
    n = base.count()
    known = tokens(base).groupBy("token").agg(F.count("*").alias("df")).select("token", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tokens(df).join(known, "token").select(id_field, "token", (F.col("tf") * F.col("idf")).alias("w"))
    size = w.groupBy(id_field).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return w.join(size, id_field).select(id_field, "token", F.round(F.col("w") / F.col("size"), 6).alias("weight"))


# Words that name entities, by kind; callers bring their own lists.
ENTITY_WORDS = {
    "job": ("engineer", "manager", "director", "analyst", "developer", "nurse", "teacher", "accountant", "lawyer", "clerk"),
    "organization": ("inc", "ltd", "gmbh", "corp", "university", "bank", "hospital", "ministry", "institute", "company"),
    "skill": ("python", "sql", "java", "excel", "accounting", "design", "marketing", "statistics", "negotiation", "leadership"),
    "transaction": ("payment", "transfer", "deposit", "withdrawal", "refund", "invoice", "purchase", "loan", "salary", "fee"),
}


def named_entities(df: DataFrame, id_field: str, field: str, kinds: dict[str, Sequence[str]] | None = None, context: int = 1) -> DataFrame:
    """(id, kind, word, phrase, n): listed words of a text with up to ``context`` words before them, in one pass."""
    listed = kinds or ENTITY_WORDS
    table = F.create_map(*[x for kind, ws in sorted(listed.items()) for w in ws for x in (F.lit(w), F.lit(kind))])
    w = df.select(id_field, words(F.col(field)).alias("w"))
    at = w.select(id_field, "w", F.posexplode("w").alias("i", "word")).withColumn("kind", F.try_element_at(table, F.col("word"))).where("kind is not null")
    first = F.greatest(F.col("i") - context, F.lit(0))
    phrase = F.array_join(F.slice("w", first + 1, F.col("i") - first + 1), " ")
    return at.groupBy(id_field, "kind", "word", phrase.alias("phrase")).agg(F.count("*").alias("n"))
