"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all training words are gathered in one table.  The commonest words
are symbols of their own; every other word belongs to one of a fixed number of
classes by its ending, and is drawn inside its class by its smoothed count.
The model predicts a symbol from the two before it: a linear map of each
context vector, added up, times the vector of every symbol, plus a bias.

Training is numpy: each task runs over all training tokens of its partition,
telling each from noise symbols drawn by their frequency; the tasks'
parameters are averaged, weighted by tokens, and the next pass goes on from
the average.  Scores are normalised exactly:
batched matrix products give the normaliser of every pair of context symbols,
so the probabilities of all tokens add up to one.

Scale: words are counted before they are shuffled; what is broadcast are the
model, its normalisers and a table of ``COMMON_WORDS`` words, all of fixed
size; the counts of all other words are joined, never gathered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold, materialize, text_bytes, tidy

#: Words with a symbol of their own, classes of other words, and words whose counts every task holds.
SYMBOL_WORDS, ENDING_CLASSES, COMMON_WORDS = 1024, 256, 65_536
#: Length of vectors, tokens a step, noise symbols a step, step size.
DIMENSIONS, STEP_TOKENS, NOISE, RATE = 16, 4096, 48, 0.08
#: Passes over all training tokens.
PASSES = 2
#: Words counted or remembered by a task at a time.
HELD_WORDS = 400_000
#: Smoothing of counts.
ALPHA = 0.1
#: Not a word, since words hold no white space.
END = b" "
SYMBOLS = SYMBOL_WORDS + ENDING_CLASSES + 2
END_SYMBOL, BEGIN_SYMBOL = SYMBOLS - 2, SYMBOLS - 1


def words_of(text: pa.BinaryScalar) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.as_py().lower().split()


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDING_CLASSES


class WordTable(dict):
    """Word -> symbol + (place among the common words << 16); END has the last symbol but one."""

    def __init__(self, common: list[bytes]):
        super().__init__()
        self.none = COMMON_WORDS
        for k, w in enumerate(common):
            self[w] = (k if k < SYMBOL_WORDS else SYMBOL_WORDS + ending_class(w)) | (k << 16)
        self[END] = END_SYMBOL | (COMMON_WORDS << 16)
        self.limit = len(self) + HELD_WORDS
        self.fixed = dict(self)

    def __missing__(self, word: bytes) -> int:
        found = (SYMBOL_WORDS + ending_class(word)) | (self.none << 16)
        if len(self) >= self.limit:
            self.clear()
            self.update(self.fixed)
        if len(word) <= 48:
            self[word] = found
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        words, n = list(counts), list(counts.values())
        for i in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 100_000], pa.binary()), pa.array(n[i : i + 100_000], pa.int64())], ["word", "n"])
        counts.clear()

    for b in batches:
        for text in b.column("text"):
            counts.update(words_of(text))
            if len(counts) > HELD_WORDS:
                yield from flush()
        counts[END] += b.num_rows
    yield from flush()


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, words = np.zeros(ENDING_CLASSES, np.int64), np.zeros(ENDING_CLASSES, np.int64)
    for b in batches:
        at = np.fromiter(map(ending_class, b.column("word").to_pylist()), np.int64, b.num_rows)
        tokens += np.bincount(at, b.column("c").to_numpy(), ENDING_CLASSES).astype(np.int64)
        words += np.bincount(at, minlength=ENDING_CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDING_CLASSES, dtype=np.int32)), pa.array(tokens), pa.array(words)], ["k", "tokens", "words"])


class LogBilinear:
    """Parameters: symbol vectors, biases, and one map for each of the two context places; with each, the squared gradients so far."""

    SHAPES = ((SYMBOLS, DIMENSIONS), (SYMBOLS,), (DIMENSIONS, DIMENSIONS), (DIMENSIONS, DIMENSIONS))

    def __init__(self, parameters: list[np.ndarray], grown: list[np.ndarray] | None = None):
        self.vectors, self.bias, self.near, self.far = self.parameters = parameters
        self.grown = grown or [np.full(x.shape, 1e-6, np.float32) for x in parameters]

    @classmethod
    def initial(cls, frequency: np.ndarray, seed: int = 7) -> LogBilinear:
        rng = np.random.default_rng(seed)
        shapes = cls.SHAPES
        return cls([x.astype(np.float32) for x in (rng.normal(0, 0.1, shapes[0]), np.log(frequency), np.eye(DIMENSIONS) * 0.5, np.eye(DIMENSIONS) * 0.5)])

    @classmethod
    def load(cls, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for s in cls.SHAPES * 2:
            out.append(np.array(flat[at : at + int(np.prod(s))], np.float32).reshape(s))
            at += int(np.prod(s))
        return cls(out[: len(cls.SHAPES)], out[len(cls.SHAPES) :])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.parameters, *self.grown)]).astype(np.float64)

    def train(self, tokens: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], frequency: np.ndarray, seed: int) -> int:
        """One pass over (symbol, one before, two before) arrays; returns the number of tokens."""
        rng = np.random.default_rng(seed)
        total, grown = 0, self.grown
        log_noise = np.log(frequency * NOISE).astype(np.float32)
        cumulated = np.cumsum(frequency)
        lane = np.arange(DIMENSIONS)

        def scattered(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            flat = (at[:, None] * DIMENSIONS + lane).ravel()
            return np.bincount(flat, rows.ravel(), SYMBOLS * DIMENSIONS).reshape(SYMBOLS, DIMENSIONS)

        for w, one, two in tokens:
            order = rng.permutation(len(w))
            total += len(w)
            for i in range(0, len(w), STEP_TOKENS):
                t = order[i : i + STEP_TOKENS]
                a, b, c = w[t], one[t], two[t]
                v, rb, rc = self.vectors[a], self.vectors[b], self.vectors[c]
                q = rb @ self.near + rc @ self.far
                noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]), SYMBOLS - 1)
                vn = self.vectors[noise]
                data = 1 / (1 + np.exp(np.clip((q * v).sum(1) + self.bias[a] - log_noise[a], -30, 30)))
                fake = -1 / (1 + np.exp(-np.clip(q @ vn.T + self.bias[noise] - log_noise[noise], -30, 30)))
                dq = data[:, None] * v + fake @ vn
                d_vectors = scattered(np.concatenate([a, b, c]), np.concatenate([data[:, None] * q, dq @ self.near.T, dq @ self.far.T]))
                np.add.at(d_vectors, noise, fake.T @ q)
                d_bias = np.bincount(a, data, SYMBOLS) + np.bincount(noise, fake.sum(0), SYMBOLS)
                for x, g, s in zip(self.parameters, (d_vectors, d_bias, rb.T @ dq, rc.T @ dq), grown, strict=True):
                    g = (g / len(t)).astype(np.float32)
                    s += g * g
                    x += np.float32(RATE) * g / np.sqrt(s)
        return total

    def pair_scores(self) -> tuple[np.ndarray, np.ndarray]:
        """[context symbol, symbol] for both context places; biases are in the first."""
        near = self.vectors @ self.near @ self.vectors.T + self.bias
        far = self.vectors @ self.far @ self.vectors.T
        return near.astype(np.float32), far.astype(np.float32)


def log_normaliser(near: np.ndarray, far: np.ndarray, one: int) -> np.ndarray:
    """ln of the sum over all symbols but BEGIN, for the context symbol ``one`` after each symbol."""
    logits = near[one, :BEGIN_SYMBOL] + far[:, :BEGIN_SYMBOL]
    top = logits.max(1)
    return top + np.log(np.exp(logits - top[:, None]).sum(1, dtype=np.float64))


def _tokens(b: pa.RecordBatch, table: WordTable) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with END after each text, their number by text, symbols, the two before each, places among the common words."""
    words: list[bytes] = []
    n = []
    for text in b.column("text"):
        own = words_of(text)
        own.append(END)
        n.append(len(own))
        words += own
    packed = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    symbol, place = packed & 0xFFFF, packed >> 16
    n = np.array(n, np.int64)
    first = np.cumsum(n) - n
    one = np.append(BEGIN_SYMBOL, symbol[:-1])
    one[first] = BEGIN_SYMBOL
    two = np.append(BEGIN_SYMBOL, one[:-1])
    two[first] = BEGIN_SYMBOL
    return words, n, symbol, one, two, place


def train(training: DataFrame, common: list[bytes], frequency: np.ndarray, passes: int = PASSES) -> LogBilinear:
    """The averaged model over ``training`` (text: binary) after some passes."""
    model = LogBilinear.initial(frequency)
    for k in range(passes):
        held = training.sparkSession.sparkContext.broadcast((common, frequency, model.flat()))

        def run(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            common, frequency, flat = held.value
            table, model = WordTable(common), LogBilinear.load(flat)
            part = TaskContext.get().partitionId()
            n = model.train((_tokens(x, table)[2:5] for b in batches for x in blocks(b, "text")), frequency, (k << 32) + part)
            if n:
                weighed = np.append(model.flat() * n, float(n))
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(weighed.tobytes(), 1)], pa.binary())], ["slice", "part", "bytes"])

        total = np.frombuffer(fold(materialize(training.mapInArrow(tidy(run), "slice int, part int, bytes binary"), "pass"), _sum))
        if not len(total):
            break
        model = LogBilinear.load(total[:-1] / total[-1])
    return model


def _sum(group: pa.Table) -> bytes:
    return sum(np.frombuffer(zlib.decompress(x.as_py())) for c in group.column("bytes").chunks for x in c).tobytes()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Learns from documents whose crc32(id as text) modulo ``folds`` is not 0.
    A-Z count as a-z.  A null or empty text is its end token alone.  Scores
    are log10 of the text's probability: by smoothed counts (base) and by the
    model.  Rows that repeat an id are scored each; those without one are
    learnt from.  Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes(text_col).alias("text"))
    training = rows.where("not held_out").select("text")
    vocabulary = materialize(training.mapInArrow(tidy(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "vocabulary")
    all_tokens, all_words = (int(x or 0) for x in vocabulary.agg(F.sum("c"), F.count("*")).first())
    words = vocabulary.where(F.col("word") != F.lit(END))
    common = [(bytes(r["word"]), r["c"]) for r in words.orderBy(F.desc("c"), "word").limit(COMMON_WORDS).collect()]
    # By class: tokens and distinct words, without the words that have a symbol of their own.
    sums = words.mapInArrow(_class_sums, "k int, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens_in, words_in = np.zeros(ENDING_CLASSES), np.zeros(ENDING_CLASSES)
    for r in sums:
        tokens_in[r["k"]], words_in[r["k"]] = r["tokens"], r["words"]
    for w, c in common[:SYMBOL_WORDS]:
        tokens_in[ending_class(w)] -= c
        words_in[ending_class(w)] -= 1
    frequency = np.full(SYMBOLS, 0.5)
    frequency[: min(SYMBOL_WORDS, len(common))] += [c for _, c in common[:SYMBOL_WORDS]]
    frequency[SYMBOL_WORDS:END_SYMBOL] += tokens_in
    frequency[END_SYMBOL] += all_tokens - sum(c for _, c in common[:SYMBOL_WORDS]) - tokens_in.sum()
    frequency[BEGIN_SYMBOL] = 1e-9
    frequency /= frequency.sum()
    names = [w for w, _ in common]
    model = train(training, names, frequency)

    near, far = model.pair_scores()
    pairs = spark.sparkContext.broadcast((near, far))

    def normalisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = pairs.value
        for b in batches:
            z = [log_normaliser(near, far, k).astype(np.float32).tobytes() for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], ["one", "z"])

    # Of fixed size: SYMBOLS squared single-precision numbers.
    tasks = spark.sparkContext.defaultParallelism * 4
    by_one = spark.range(0, SYMBOLS, 1, tasks).mapInArrow(normalisers, "one long, z binary").collect()
    z = np.stack([np.frombuffer(bytes(r["z"]), np.float32) for r in sorted(by_one, key=lambda r: r["one"])])
    # Counts of common words; what no task needs to look up has nothing added.
    log_count = np.zeros(COMMON_WORDS + 1)
    log_count[: len(common)] = np.log10(np.array([c for _, c in common], np.float64) + ALPHA)
    ends = all_tokens and vocabulary.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    end_log = float(np.log10(ends + ALPHA))
    in_class = np.log10(tokens_in + ALPHA * (words_in + 1))
    base_room = float(np.log10(all_tokens + ALPHA * (all_words + 1)))
    share = spark.sparkContext.broadcast((names, near, far, z, log_count, in_class))
    ends_known = int(ends > 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, near, far, z, log_count, in_class = share.value
        table = WordTable(names)
        # Rows are numbered where they are written; ids may repeat.
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in blocks(batch, "text"):
                words, n, w, one, two, place = _tokens(b, table)
                first = np.cumsum(n) - n
                log_p = (near[one, w].astype(np.float64) + far[two, w] - z[one, two]) / np.log(10)
                end = w == END_SYMBOL
                counted = log_count[place]
                counted[end] = end_log
                other = (w >= SYMBOL_WORDS) & ~end
                log_p[other] += counted[other] - in_class[w[other] - SYMBOL_WORDS]
                rare = (place == COMMON_WORDS) & ~end
                known = np.where(end, ends_known, ~rare)
                ids, out = b.column("doc_id"), b.column("held_out")
                k, no = len(n), pa.nulls
                number += k
                add = lambda x, first=first: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(number - k, number)), ids, out, pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(counted) - n * base_room), pa.array(add(log_p)), no(k, pa.binary()), no(k, pa.int64())], _PARTIAL
                )
                each = Counter(zip(np.repeat(np.arange(k), n)[rare].tolist(), compress(words, rare.tolist()), strict=True))
                if each:
                    m = len(each)
                    at = pa.array([number - k + d for d, _ in each], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [at, no(m, pa.int64()), no(m, pa.bool_()), no(m, pa.int64()), no(m, pa.int64()), no(m, pa.float64()), no(m, pa.float64()), pa.array([x for _, x in each], pa.binary()), pa.array(list(each.values()), pa.int64())],
                        _PARTIAL,
                    )

    partial = materialize(rows.mapInArrow(tidy(score), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word binary, times long"), "partial")
    rare = partial.where("word is not null").select("row", "word", "times")
    counted = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ALPHA))
    late = rare.join(vocabulary, "word", "left").groupBy("row").agg(F.sum(F.col("times") * counted).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    whole = partial.where("word is null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score").join(late, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


_PARTIAL = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "word", "times"]
