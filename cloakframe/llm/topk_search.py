"""Exact top-k inner-product search: ball-tree branch and bound in shards.

A bounded sample gives centres; every vector goes to the nearest one, and each
centre's vectors, a coarse ball, are dealt into shards of bounded size.  Each
shard has a ball tree.  No vector of a ball with centre c and radius r scores
more than q.c + |q| r, so a shard or node whose bound lies below a query's
current kth score is passed over; those with the larger bound come first.  A
query's kth score is shared in waves: from the shard of the best centre, then
from the few shards of the largest bounds, and only shards that could still
matter are visited last.  Ties at the kth score are searched, so the smaller id
always wins.

A block of queries walks a tree together: at each node a matrix product gives
the bounds of the queries still active.  Components are integers, and their
products are exact in double precision up to 2**53 (in 64-bit integers beyond,
up to 2**62; larger ones fail).

Scale: a task holds one shard and one block of queries at a time; queries
travel to the shards that they need in the shuffle.  What is broadcast is at
most ``MOST_CENTRES`` centres with radius and size, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors in a shard on average, in a leaf at most, and queries in a block.
SHARD_VECTORS, LEAF_VECTORS, BLOCK_QUERIES = 8192, 64, 512
#: Centres at most, sampled vectors for each that fit them, and shards that a query visits in the second wave.
MOST_CENTRES, FIT_VECTORS, SECOND_WAVE = 1024, 16, 3


class BallTree:
    """A binary tree over the rows of ``vectors`` (int64), in one order that makes every node a slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.child, self.centre, self.radius = [], [], [], [], []
        peak = int(np.abs(vectors).max(initial=0))
        width = max(1, vectors.shape[1])
        if width * peak * peak >= 1 << 62:
            raise ValueError("inner products do not fit 64 bits")
        self.exact = np.int64 if width * peak * peak >= 1 << 53 else np.float64
        self._node(0, len(ids))
        self.table = self.vectors.astype(self.exact)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _node(self, low: int, high: int) -> int:
        own = self.vectors[low:high].astype(np.float64)
        centre = own.mean(0) if high > low else np.zeros(self.vectors.shape[1])
        away = np.sqrt(((own - centre) ** 2).sum(1))
        k = len(self.low)
        self.low.append(low)
        self.high.append(high)
        self.child.append(None)
        self.centre.append(centre)
        self.radius.append(float(away.max(initial=0)))
        if high - low > LEAF_VECTORS:
            # Split along the line between two far points, at the median; equal points split too.
            a = own[int(away.argmax())]
            b = own[int(((own - a) ** 2).sum(1).argmax())]
            order = np.argsort((own - a) @ (b - a), kind="stable")
            middle = (high - low) // 2
            order[:middle].sort()
            order[middle:].sort()
            self.ids[low:high] = self.ids[low:high][order]
            self.vectors[low:high] = self.vectors[low:high][order]
            self.child[k] = (self._node(low, low + middle), self._node(low + middle, high))
        return k

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (nq, k) of the best rows but the query's own; -1 and the least score where there are fewer.

        ``floor`` is each query's kth score known so far (or the least number): rows below it may be left out.
        """
        none = np.iinfo(np.int64).min
        best_ids, best = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), none, np.int64)
        floats, exact = queries.astype(np.float64), queries.astype(self.exact)
        length = np.sqrt((floats**2).sum(1))

        def bounds(node: int, active: np.ndarray) -> np.ndarray:
            up = floats[active] @ self.centre[node] + length[active] * self.radius[node]
            return up + 1 + np.abs(up) * 1e-9

        def alive(up: np.ndarray, active: np.ndarray) -> np.ndarray:
            kth = np.maximum(best[active, -1], floor[active]).astype(np.float64)
            return up >= kth

        everyone = np.arange(len(ids))
        stack = [(0, everyone, bounds(0, everyone))]
        while stack:
            node, active, up = stack.pop()
            ok = alive(up, active)
            active = active[ok]
            if not len(active):
                continue
            if self.child[node] is not None:
                pair = [(c, active, bounds(c, active)) for c in self.child[node]]
                # The last pushed is visited first: the child with the larger bounds.
                stack += sorted(pair, key=lambda x: float(x[2].sum()))
                continue
            low, high = self.low[node], self.high[node]
            scores = (exact[active] @ self.table[low:high].T).astype(np.int64)
            scores[ids[active][:, None] == self.ids[low:high]] = none
            kth = np.maximum(best[active, -1], floor[active])
            gain = ((scores >= kth[:, None]) & (scores > none)).any(1)
            if gain.any():
                at = active[gain]
                s = np.concatenate([best[at], scores[gain]], 1)
                i = np.concatenate([best_ids[at], np.broadcast_to(self.ids[low:high], (len(at), high - low))], 1)
                # -s would overflow for the least number; ~s falls as s rises.
                order = np.lexsort((i, ~s), axis=1)[:, :k]
                best[at], best_ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        best_ids[best == none] = -1
        return best_ids, best


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _found(ids: np.ndarray, found: np.ndarray, scores: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
    ok = (found >= 0) | (scores > np.iinfo(np.int64).min)
    ok &= scores >= floor[:, None]
    query = np.broadcast_to(ids[:, None], found.shape)[ok]
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(found[ok]), pa.array(scores[ok])], ["query_id", "vec_id", "score"])


def _search(k: int):
    """Over rows sorted by shard, vectors before queries: a tree at a time, a block of queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree
            if waiting and ids:
                if tree is None:
                    tree = BallTree(np.concatenate(ids), np.concatenate(vectors))
                q, v, floor = (np.concatenate(x) for x in zip(*waiting, strict=True))
                for i in range(0, len(q), BLOCK_QUERIES):
                    part = slice(i, i + BLOCK_QUERIES)
                    yield _found(q[part], *tree.search(q[part], v[part], k, floor[part]), floor[part])
            waiting.clear()

        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("shard", "width", "is_query")], 1)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else []
            for i, j in zip(cut, np.append(cut[1:], len(key)), strict=True) if len(key) else ():
                part = b.slice(i, j - i)
                if shard != (now := tuple(key[i][:2])):
                    yield from answer()
                    shard, tree = now, None
                    ids.clear()
                    vectors.clear()
                number, rows = part.column("id").to_numpy(), _matrix(part.column("v"))
                if key[i][2]:
                    waiting.append((number, rows, part.column("floor").to_numpy()))
                    if sum(len(x[0]) for x in waiting) >= BLOCK_QUERIES:
                        yield from answer()
                else:
                    ids.append(number)
                    vectors.append(rows)
        yield from answer()

    return run


_OUT = "query_id long, vec_id long, score long"


def fit_centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres of the sample's rows at most: its first rows, moved to the means of what is nearest to them."""
    centres = np.unique(sample[:n], axis=0).astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    at = np.empty(len(rows), np.int64)
    away = np.empty(len(rows))
    for i in range(0, len(rows), 4096):
        x = rows[i : i + 4096].astype(np.float64)
        at[i : i + 4096] = ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)
        away[i : i + 4096] = np.sqrt(((x - centres[at[i : i + 4096]]) ** 2).sum(1))
    return at, away


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    width = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
    for w in np.unique(width).tolist():
        part = b.filter(pa.array(width == w))
        yield int(w), part, _matrix(part.column("v")) if w else np.zeros((part.num_rows, 0), np.int64)


def _place(centres: dict[int, np.ndarray]):
    """Each vector's centre (the first place of its width is ``first``), and how far away it is."""
    first = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, part, rows in _by_width(b):
                # A width that the sample lacks has one ball around its origin.
                known = w in centres
                at, away = nearest(rows, centres[w] if known else np.zeros((1, w)))
                cell = at + first[w] if known else np.full(len(at), -1 - w)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), w, np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], [*part.schema.names, "width", "cell", "away"])

    return run


def route(x: np.ndarray, kth: np.ndarray, centre: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, wave: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, shard) of a wave: 0 one shard of the best ball, 1 the next few by bound, 2 all others; in 1 and 2 only where the bound reaches ``kth``."""
    near = x @ centre.T
    bound = near + np.sqrt((x * x).sum(1))[:, None] * radius
    bound += 1 + np.abs(bound) * 1e-9
    home = near.argmax(1)
    if wave == 0:
        return np.arange(len(x)), first[home]
    left = np.broadcast_to(parts, near.shape).copy()
    rows = np.arange(len(x))
    left[rows, home] -= 1
    order = np.argsort(-bound, axis=1, kind="stable")
    in_order = np.take_along_axis(left, order, 1)
    early = np.empty_like(left)
    np.put_along_axis(early, order, np.clip(SECOND_WAVE - (np.cumsum(in_order, 1) - in_order), 0, in_order), 1)
    many = np.where(bound >= kth[:, None], early if wave == 1 else left - early, 0)
    q, k = np.nonzero(many)
    n = many[q, k]
    begin = first[k] + (k == home[q]) + (0 if wave == 1 else early[q, k])
    shard = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(q, n), shard


def _route(balls_var, wave: int):
    """A row for each query and shard of the wave that may hold one of its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = balls_var.value
        for b in batches:
            for w, part, rows in _by_width(b):
                step = max(1, (1 << 21) // len(balls[w][0])) if w in balls else part.num_rows
                for i in range(0, part.num_rows if w in balls else 0, step):
                    own = part.slice(i, step)
                    q, shard = route(rows[i : i + step].astype(np.float64), own.column("floor").to_numpy().astype(np.float64), *balls[w], wave)
                    for j in range(0, len(q), 10_000):
                        at = pa.array(q[j : j + 10_000])
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard[j : j + n].astype(np.int32)), pa.array(np.full(n, w, np.int32)), pa.array(np.ones(n, np.int32)), own.column("id").take(at), own.column("v").take(at), own.column("floor").take(at)],
                            ["shard", "width", "is_query", "id", "v", "floor"],
                        )

    return run


_ROWS = "shard int, width int, is_query int, id long, v array<bigint>, floor long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each query row, its own left out.

    A component x counts as floor(scale * x).  Vectors that are null or hold
    null or non-finite components, and rows without id, take no part, neither
    as queries nor as candidates; only vectors of equal length are compared.
    Ties go to the smaller id.  Rows that repeat an id are candidates each,
    except for that id's own query, which asks once: with its shortest, then
    smallest vector.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"), is_query.alias("asks")
    )
    rows = rows.where("id is not null")
    wanted = min(MOST_CENTRES, max(1, -(-rows.count() // shard_vectors)))
    # A bounded sample fits the centres; every vector is placed.
    sample: dict[int, list[list[int]]] = {}
    for r in rows.select("v").orderBy(F.xxhash64("id", "v")).limit(wanted * FIT_VECTORS).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    centres = {w: fit_centres(np.array(x, np.int64).reshape(len(x), w), wanted) for w, x in sorted(sample.items())}
    placed = materialize(rows.mapInArrow(_place(centres), "id long, v array<bigint>, asks boolean, width int, cell int, away double"), "placed")
    cells = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("width", "cell").collect()
    # Shards are numbered ball by ball.
    balls: dict[int, list[tuple[np.ndarray, float, int, int]]] = {}
    spread, shards = [], 0
    flat = [c for x in centres.values() for c in x]
    for r in cells:
        parts = -(-r["n"] // shard_vectors)
        spread.append((r["cell"], shards, parts))
        balls.setdefault(r["width"], []).append((flat[r["cell"]] if r["cell"] >= 0 else np.zeros(r["width"]), r["radius"], shards, parts))
        shards += parts
    table = {w: (np.array([c for c, *_ in x]).reshape(len(x), w), *(np.array(y) for y in list(zip(*x, strict=True))[1:])) for w, x in balls.items()}
    balls_var = spark.sparkContext.broadcast(table)
    dealt = spark.createDataFrame(spread, "cell int, first int, parts int") if spread else spark.createDataFrame([], "cell int, first int, parts int")
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int")
    least = F.lit(-(2**63)).cast("long")
    candidates = placed.join(F.broadcast(dealt), "cell").select(shard.alias("shard"), "width", F.lit(0).alias("is_query"), "id", "v", least.alias("floor"))
    questions = materialize(placed.where("asks").groupBy("id").agg(F.min(F.struct("width", "v")).alias("q")).select("id", "q.v"), "questions")

    found = None
    for wave in range(3 if shards > 1 else 1):
        asked = questions.withColumn("floor", least)
        if found is not None:
            # A query with fewer than k rows so far has no kth score yet.
            best = F.slice(F.sort_array(F.collect_list("score"), False), 1, k)
            kth = found.groupBy("query_id").agg(best.alias("s")).select(F.col("query_id").alias("id"), F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("kth"))
            asked = questions.join(kth, "id", "left").select("id", "v", F.coalesce("kth", least).alias("floor"))
        routed = materialize(asked.mapInArrow(_route(balls_var, wave), _ROWS), "routed")
        # Only shards that are asked move.
        needed = candidates.join(routed.select("shard").distinct(), "shard", "left_semi")
        both = needed.unionByName(routed)
        new = both.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "width", "is_query").mapInArrow(_search(k), _OUT)
        new = materialize(new, "found")
        found = new if found is None else found.unionByName(new)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id"), "score")
