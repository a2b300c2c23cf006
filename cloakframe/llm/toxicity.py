"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  Each has a logistic model over
the presence of chosen words and word beginnings, a few measures of the whole
text, and the probabilities of all categories before it.  Those come from
models trained on the other folds, so that a later model learns to trust them
as far as they hold on texts not seen in training.

Fitting takes a sample of at most ``SAMPLE_ROWS`` labelled rows (those whose
ids hash lowest; all, where there are fewer).  Features are counted over the
sample in the cluster, and the driver holds only the chosen ones.  Prediction
reads every whole text once, without a shuffle; what tasks receive is of
fixed size.  A category's threshold comes from the out-of-fold probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import blocks, materialize, text_bytes

#: Labelled rows that fit a chain at most, features of a category, folds, and the documents a feature needs.
SAMPLE_ROWS, FEATURES, FOLDS, LEAST_DOCS = 20_000, 500, 5, 3
#: A feature is chosen only if its log-likelihood ratio is one in ten thousand by chance or less.
LEAST_SURPRISE = 15.1
#: Lengths of word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5)
#: Words that a worker remembers with their features.
CACHE_WORDS = 100_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
MEASURES = ("bias", "log_words", "word_length", "marks", "digits", "distinct", "lines")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def measures(text: str, words: list[str]) -> list[float]:
    """A constant and shares of the whole text, each about between 0 and 1."""
    n, chars = max(1, len(words)), max(1, len(text))
    letters = sum(map(len, words))
    lines = text.split("\n")
    return [1.0, float(np.log1p(len(words))) / 10, letters / n / 10, 1 - letters / chars, sum(w.isdigit() for w in words) / n, len(set(words)) / n, len(set(lines)) / len(lines)]


def fit_logistic(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, steps: int = 10, start: np.ndarray | None = None) -> np.ndarray:
    """Weights over ``width`` binary features (ones at rows, columns) and the columns of ``dense``.

    Newton's method on the penalised mean loss, each step solved by conjugate gradients and halved until it helps.
    The loss has one minimum, so ``start`` only saves steps.
    """
    n = len(y)
    l2 = 0.5 / max(1, n)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, w[columns], n) + dense @ w[width:]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns, g[rows], width), dense.T @ g)

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * (w @ w))

    w = np.zeros(width + dense.shape[1]) if start is None else start.copy()
    z = times(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient = back((p - y) / n) + l2 * w
        curve = p * (1 - p) / n
        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), float(rest @ rest)
        least = 1e-6 * size
        for _ in range(25):
            if size <= least or size < 1e-20:
                break
            bent = back(curve * times(way)) + (l2 + 1e-9) * way
            a = size / float(way @ bent)
            step += a * way
            rest -= a * bent
            size, before = float(rest @ rest), size
            way = rest + size / before * way
        move, now, t = times(step), loss(z, w), 1.0
        while loss(z + t * move, w + t * step) > now and t > 1e-4:
            t /= 2
        w, z = w + t * step, z + t * move
        if now - loss(z, w) < 1e-8:
            break
    return w


def probabilities(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, w: np.ndarray) -> np.ndarray:
    width = len(w) - dense.shape[1]
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], len(dense)) + dense @ w[width:], -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where to cut ``p`` so that the F1 score over the 0/1 labels ``y`` is best: half-way, in log-odds, to the next lower value.

    Above one, so that nothing reaches it, without a label of one.
    """
    if not y.any():
        return 2.0
    values, at = np.unique(p, return_inverse=True)
    hits, own = (np.cumsum(np.bincount(at, w, len(values))[::-1])[::-1] for w in (y, np.ones(len(y))))
    k = int(np.argmax(2 * hits / (own + y.sum())))
    if not k:
        return float(values[0])
    low, high = np.clip(values[k - 1 : k + 1], 1e-12, 1 - 1e-12)
    odds = np.sqrt(low / (1 - low) * high / (1 - high))
    return float(odds / (1 + odds))


@dataclass
class Chain:
    """Categories in order, the features' places, each category's weights and the probability from which it holds."""

    categories: list[str]
    place: dict[str, int]
    weights: list[np.ndarray]
    thresholds: list[float]

    @classmethod
    def fit(cls, categories: list[str], features: list[str], rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        weights, thresholds = [], []
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            out = np.zeros(len(y))
            whole = fit_logistic(rows, columns, dense, y, len(features))
            for f in range(FOLDS):
                test = fold == f
                inside = ~test[rows]
                number = np.cumsum(~test) - 1
                w = fit_logistic(number[rows[inside]], columns[inside], dense[~test], y[~test], len(features), start=whole) if (~test).any() else np.zeros(len(features) + dense.shape[1])
                out[test] = probabilities(rows, columns, dense, w)[test]
            weights.append(whole)
            thresholds.append(best_threshold(out, y))
            dense = np.column_stack([dense, out])
        return cls(categories, {f: k for k, f in enumerate(features)}, weights, thresholds)

    def predict(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        for w in self.weights:
            dense = np.column_stack([dense, probabilities(rows, columns, dense, w)])
        return dense[:, len(MEASURES) :]


class _Places(dict):
    """Word -> places of its chosen features."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.place[f] for f in word_features(word) if f in self.place)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found


def sparse_rows(texts: list[str | None], places: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every chosen feature a text holds, and the measures of each text."""
    rows: list[int] = []
    columns: list[int] = []
    dense = []
    for k, text in enumerate(texts):
        text = text or ""
        words = _WORD.findall(text.lower())
        own = set()
        for found in filter(None, map(places.__getitem__, set(words))):
            own.update(found)
        rows += [k] * len(own)
        columns += own
        dense.append(measures(text, words))
    return np.array(rows, np.int64), np.array(columns, np.int64), np.array(dense, float).reshape(len(texts), len(MEASURES))


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, least_docs: int = LEAST_DOCS, least_surprise: float = LEAST_SURPRISE,
) -> Chain:
    """A chain over ``categories``: name -> boolean column of ``labels`` (which shares ``id_col`` with ``docs``).

    Rows with a null label or id are not used; of several labels for one id,
    a category holds if it holds in any.  At most ``features`` features of a
    category are used, of those that ``least_docs`` sampled documents hold
    and whose log-likelihood ratio is at least ``least_surprise``.  A
    category's threshold is the best one for the out-of-fold probabilities.
    Without labelled texts every probability is one half, and no category holds.
    """
    names = list(categories)
    known = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).dropna()
    known = known.groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    mask = sum((F.col(f"y{k}") * F.lit(1 << k) for k in range(len(names))), F.lit(0)).alias("mask")
    # A few bytes for each of at most sample_rows rows; of several texts with one id, that of the least hash.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample.select("id", mask)), "id")
    texts = texts.groupBy("id", "mask").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    texts = materialize(texts.select("id", "mask", "least.text"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for text, m in zip(b.column("text").to_pylist(), b.column("mask").to_pylist(), strict=True):
                found.update((f, m) for f in {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)})
                found["", m] += 1
        keys = list(found)
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), pa.array([m for _, m in part], pa.int32()), pa.array([found[x] for x in part], pa.int64())], ["feature", "mask", "n"])

    by_category = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(names))]
    counted = texts.select("text", "mask").mapInArrow(count, "feature string, mask int, n long").groupBy("feature").agg(F.sum("n").alias("n"), *by_category)
    counted = materialize(counted.where(F.col("n") >= least_docs), "features")
    total = counted.where("feature = ''").first()
    if total is None:
        return Chain(names, {}, [np.zeros(len(MEASURES) + k) for k in range(len(names))], [2.0] * len(names))
    chosen: set[str] = set()
    for k in range(len(names)):
        n, yes, docs_n, all_yes = F.col("n").cast("double"), F.col(f"n{k}").cast("double"), float(total["n"]), float(total[f"n{k}"])
        cells = [(yes, n * all_yes), (n - yes, n * (docs_n - all_yes)), (all_yes - yes, (docs_n - n) * all_yes), (docs_n - all_yes - n + yes, (docs_n - n) * (docs_n - all_yes))]
        ratio = sum((F.when(o > 0, o * F.log(o * docs_n / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
        best = counted.where("feature <> ''").where(2 * ratio >= least_surprise).orderBy(F.desc(ratio), "feature").limit(features).select("feature").collect()
        chosen.update(r["feature"] for r in best)
    ordered = sorted(chosen)
    place = {f: i for i, f in enumerate(ordered)}

    def chosen_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(place)
        for b in batches:
            rows, columns, dense = sparse_rows(b.column("text").to_pylist(), places)
            cut = np.searchsorted(rows, np.arange(b.num_rows + 1))
            own = [columns[i:j].astype(np.int32) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mask"), pa.array(own, pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))], ["id", "mask", "features", "dense"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("id", "mask", "text").mapInArrow(chosen_rows, f"id {kind}, mask int, features array<int>, dense array<double>")
    got = got.select("mask", "features", "dense", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).alias("fold"), "id").collect()
    got.sort(key=lambda r: (r["id"], r["features"], r["dense"]))
    rows = np.repeat(np.arange(len(got)), [len(r["features"]) for r in got])
    columns = np.array([c for r in got for c in r["features"]], np.int64)
    mask = np.array([r["mask"] for r in got])
    y = np.stack([(mask >> k) & 1 for k in range(len(names))], 1)
    return Chain.fit(names, ordered, rows, columns, np.array([r["dense"] for r in got]), y, np.array([r["fold"] for r in got]))


def chain_rows(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """(row, p_<category>..., <category>...): each row of ``docs`` whole, as a struct, with its probabilities and whether they reach the thresholds.

    Every whole text is read; a null text counts as empty.  Repeated rows are
    predicted each, and no id is needed; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["row", *(f"p_{c}" for c in chain.categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        places = _Places(chain.place)
        for b in (x for batch in batches for x in blocks(batch, "text")):
            p = chain.predict(*sparse_rows([t.decode() for t in b.column("text").to_pylist()], places))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_bytes(text_col).alias("text"))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *(StructField(n, DoubleType()) for n in names[1:])])
    out = rows.mapInArrow(run, schema)
    return out.select("*", *[(F.col(f"p_{c}") >= t).alias(c) for c, t in zip(chain.categories, chain.thresholds, strict=True)])


def predict_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, a probability p_<category> and whether <category> holds, for every row (see ``chain_rows``)."""
    out = chain_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chain)
    return out.select(F.col("row.id").alias(id_col), *out.columns[1:])


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain over the two labels that ``labels`` has: low quality, then toxic."""
    return fit_chain(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, low_quality, toxic; nothing is toxic where no labelled text fitted the chain."""
    return predict_chain(docs, toxicity_chain(docs, labels))
