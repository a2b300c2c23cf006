"""Packing token sequences by bin completion.

Pieces of a full sequence stand alone.  The rest are dealt into groups of
bounded size by a hash, and each group is packed: best-fit decreasing gives
the incumbent, and where that misses the lower bound, branch and bound fills
one bin after another around the largest piece left.  It enumerates fillings
that no other filling dominates, fullest first, and prunes by the waste that
a better solution could still afford.  The poorly filled bins of all groups
are then packed anew, in rounds of ever fewer groups down to one, so a split
into groups costs no sequences beyond those of the last round.

Scale: a group has at most about ``GROUP_PIECES`` pieces whatever the table's
size; only ids, lengths and checksums move between tasks, never tokens.  The
rounds end where a round no longer saves a fifth of the groups, so they are logarithmic.
The search goes as far as ``Limits`` says; ``EXACT`` has none.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes
from .word_bpe import word_ids

#: Pieces in a group, on average.
GROUP_PIECES = 4096


@dataclass(frozen=True)
class Limits:
    """How far a search goes before its incumbent stands.

    ``nodes`` beyond one for each bin; ``fillings`` kept and ``steps`` taken to
    find them at each; from ``depth`` pieces on a filling goes on greedily.
    The incumbent is always a whole packing, so limits cost sequences at most.
    """

    nodes: float = 400
    fillings: float = 12
    steps: float = 400
    depth: float = 24


#: No limits: the fewest bins there are, in time that may be exponential.
EXACT = Limits(math.inf, math.inf, math.inf, math.inf)
LIMITS = Limits()
#: A bin with more unused than this part of its room is packed anew in the next round.
WASTE = 0.002


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices, by best-fit decreasing."""
    bins: list[list[int]] = []
    left: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(left, (sizes[i], -1))
        if k == len(left):
            bins.append([i])
            insort(left, (room - sizes[i], len(bins) - 1))
        else:
            free, b = left.pop(k)
            bins[b].append(i)
            insort(left, (free - sizes[i], b))
    return bins


def dominated(filling: list[int], unused: list[int], slack: int) -> bool:
    """Whether a piece outside could take the place of some inside without loss: sum <= piece <= sum + slack."""
    sums = {0}
    for x in filling:
        sums |= {s + x for s in sums}
        if len(sums) > 256:
            break
    sums.discard(0)
    order = sorted(sums)
    inside = set(filling)
    for y in unused:
        if y not in inside:
            k = bisect_right(order, y) - 1
            if k >= 0 and order[k] < y <= order[k] + slack:
                return True
    return False


def fillings(free: int, sizes: list[int], counts: dict[int, int], limits: Limits = LIMITS) -> list[list[int]]:
    """Undominated sets of pieces that fit in ``free``, fullest first; ``sizes`` falls."""
    fit = sizes[bisect_left(sizes, -free, key=lambda s: -s) :]
    found: list[tuple[int, list[int]]] = []
    steps = 0

    def grow(at: int, room: int, chosen: list[int]) -> None:
        nonlocal steps
        steps += 1
        k = bisect_left(fit, -room, lo=at, key=lambda s: -s)
        if len(chosen) >= limits.depth:
            rest = []
            while k < len(fit) and room:
                n = min(room // fit[k], counts[fit[k]] - chosen.count(fit[k]))
                rest += [fit[k]] * n
                room -= n * fit[k]
                k = bisect_left(fit, -room, lo=k + 1, key=lambda s: -s)
            found.append((room, chosen + rest))
            return
        while k < len(fit) and chosen and chosen[-1] == fit[k] and chosen.count(fit[k]) >= counts[fit[k]]:
            k += 1
        if k >= len(fit):
            found.append((room, list(chosen)))
            return
        while k < len(fit) and steps < limits.steps and not (found and min(found)[0] == 0 and len(found) >= limits.fillings):
            s = fit[k]
            if chosen.count(s) < counts[s]:
                chosen.append(s)
                grow(k, room - s, chosen)
                chosen.pop()
            k += 1

    grow(0, free, [])
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept = []
    for slack, chosen in found:
        if not dominated(chosen, [y for y in fit if y <= sum(chosen) + slack], slack):
            kept.append(chosen)
            if len(kept) == limits.fillings:
                break
    return kept or [found[0][1] if found else []]


def complete_bins(sizes: list[int], room: int, limits: Limits = LIMITS) -> list[list[int]]:
    """Bins of indices into ``sizes`` (each from 1 to ``room``), as few as the search finds."""
    best = best_fit(sizes, room)
    total = sum(sizes)
    bound = -(-total // room)
    if len(best) <= bound:
        return best
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    falling = sorted(counts, reverse=True)
    chosen: list[list[int]] = []
    nodes, solution, limit = 0, None, len(best)

    def take(filling: list[int], d: int) -> None:
        for s in filling:
            counts[s] += d
            if d < 0 and not counts[s]:
                falling.pop(bisect_left(falling, -s, key=lambda x: -x))
            elif d > 0 and counts[s] == 1:
                falling.insert(bisect_left(falling, -s, key=lambda x: -x), s)

    # Depth first on an explicit stack: fillings still to try at each depth.
    stack: list[Iterator[list[int]]] = []
    waste = 0

    def options() -> Iterator[list[int]]:
        largest = falling[0]
        take([largest], -1)
        out = [[largest, *f] for f in fillings(room - largest, falling, counts, limits)] if falling else [[largest]]
        take([largest], 1)
        return iter(out)

    stack.append(options())
    while stack and nodes < limits.nodes + len(best):
        f = next(stack[-1], None)
        if f is None:
            stack.pop()
            if chosen:
                last = chosen.pop()
                waste -= room - sum(last)
                take(last, 1)
            continue
        nodes += 1
        # With limit - 1 bins, a better solution can waste no more than this.
        if waste + room - sum(f) > (limit - 1) * room - total:
            continue
        take(f, -1)
        chosen.append(f)
        waste += room - sum(f)
        if falling:
            stack.append(options())
            continue
        solution, limit = [list(x) for x in chosen], len(chosen)
        if limit <= bound:
            break
        last = chosen.pop()
        waste -= room - sum(last)
        take(last, 1)
    if solution is None:
        return best
    where: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        where.setdefault(s, []).append(i)
    return [[where[s].pop() for s in b] for b in solution]


def complete_poor_bins(sizes: list[int], room: int, limits: Limits = LIMITS) -> list[list[int]]:
    """Best fit, and branch and bound over the pieces of its poor bins alone: what stays poor is packed anew anyway."""
    bins = best_fit(sizes, room)
    poor = [b for b in bins if room - sum(sizes[i] for i in b) > WASTE * room]
    members = [i for b in poor for i in b]
    again = complete_bins([sizes[i] for i in members], room, replace(limits, nodes=limits.nodes / 4))
    return [b for b in bins if room - sum(sizes[i] for i in b) <= WASTE * room] + [[members[i] for i in b] for b in again]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, cut after each ``length`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = table.encode(text.as_py()) + end
                n = len(ids) // 4
                out += [(doc, p, s, min(length, n - s), zlib.crc32(ids[4 * s : 4 * (s + length)])) for p, s in enumerate(range(0, n, length))]
            a, p, s, w, c = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(w, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        # Workers serve later stages too; they should not carry the words along.
        table.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PLACES = "row long, length long, sequence_id long, offset long, open boolean"


def _pack_group(room: int, round_no: int, last: bool, limits: Limits):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        bins = complete_bins(sizes, room, limits) if last else complete_poor_bins(sizes, room, limits)
        seq, at, is_open = (np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool))
        base = (round_no << 56) | (int(group["group"].iloc[0]) << 24)
        for b, members in enumerate(bins):
            used = 0
            for i in members:
                seq[i], at[i] = base + b, used
                used += sizes[i]
            is_open[members] = not last and room - used > WASTE * room
        return group[["row", "length"]].assign(sequence_id=seq, offset=at, open=is_open)

    return run


def pack(pieces: DataFrame, room: int, group_pieces: int = GROUP_PIECES, limits: Limits = LIMITS) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset.

    ``length`` is from 1 to ``room``.  Ties and repeated rows are packed each
    on its own; an empty table gives an empty result.  Sequences of full
    pieces have the negative numbers.
    """
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == room).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < room).select("row", "length")
    placed, round_no, before = [full], 0, None
    while True:
        groups = max(1, -(-rest.count() // group_pieces))
        # Bins that stay poor however they are dealt (pieces over half the room) end the rounds.
        last = groups == 1 or before is not None and 5 * groups > 4 * before
        packed = materialize(
            rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups))).groupBy("group").applyInPandas(_pack_group(room, round_no, last, limits), _PLACES), f"packed-{round_no}"
        )
        placed.append(packed.where("not open").select("row", "sequence_id", "offset"))
        if last:
            break
        before = groups
        rest = packed.where("open").select("row", "length")
        round_no += 1
    places = placed[0]
    for p in placed[1:]:
        places = places.unionByName(p)
    return pieces.join(places, "row").drop("row")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its one piece is the end id.  Longer
    documents are cut after each ``length`` ids.  Other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer_path, end_id, length, id_col, text_col), length, limits=limits).withColumnRenamed("doc_id", id_col)
