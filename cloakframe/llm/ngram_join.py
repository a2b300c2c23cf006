"""N-gram Jaccard self-join: rare-first prefixes, filters, one verification a pair, components.

A document is the set of its distinct word n-grams.  Documents with equal sets
form a class, and classes are joined:

1.  One pass counts n-grams over all documents in a table of fixed size.  The
    counts order n-grams, rare first; ties and shared cells are ordered by
    hash, so the order is total and any cell shared by chance costs time only.
2.  A second pass emits the prefix of each set.  Sets at least as similar as
    asked share an n-gram of their prefixes.  Length and positional filters
    apply to a pair at its first common n-gram, so an entry that they let meet
    no other of its list is dropped there and then; and of lists with the same
    members, only that of the first n-gram is kept.
3.  Rounds make candidates of neighbours in each list, in another order each
    round: by length, then by chance.  Only neighbours in different components
    count.  The suffix filter bounds a candidate's overlap by a partition of
    both sets; pairs that pass are verified once, exactly, and links join
    components.  Rounds go on while they find enough links.
4.  At last, all pairs of a list that are still in different components and
    pass the filters are verified.  So no link between components is lost, and
    a list of near copies costs a multiple of its length, not its square.

N-grams are compared by 64-bit hashes.  Lists of n-grams that stand out in the
count table are salted; rounds deal long lists into parts, by another hash each
round, and the last step cuts them into parts of bounded size that all meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_view, fold, materialize, membership_filter, mix, only, partitions, passes, text_bytes, tidy, word_hashes, word_spans
from .components import star_links

#: Cells of the count table (4 bytes each; its size does not depend on the data) as a power of two.
COUNT_BITS = 21
#: Up to so many sets, a list is compared in full by one numpy pass for each distance.
SHORT_LIST = 24
#: An n-gram counted more often has its list salted into parts of about this size.
SALT_ROWS = 16_384
#: Prefix entries (24 bytes each) that a task holds before it sends them, and that one bucket of lists holds on average.
HELD_ENTRIES, BUCKET_ENTRIES = 250_000, 300_000
#: Rounds of neighbours at most; another one follows while one candidate in so many is a link.
MOST_ROUNDS, WORTH_A_ROUND = 8, 5
#: Stands for a null id where a long is needed.
_NO_ID = 2**63 - 1
#: Sets in a part of a list that is compared with another part in one piece.
PART_ROWS = 512
#: Cells of the suffix filter's partition.
SUFFIX_CELLS = 256
_SLICES = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, rising, row after row; and where each row's begin (one more at the end)."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    weights = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = np.diff(first)
    row_of = np.repeat(np.arange(rows), n)
    grams, owners = [], []
    if len(words) >= width:
        total = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            total += words[k : k + len(total)] * weights[k]
        whole = np.arange(len(total)) + width <= first[1:][row_of[: len(total)]]
        grams.append(mix(total[whole]))
        owners.append(row_of[: len(total)][whole])
    for few in range(1, width):
        short = np.flatnonzero(n == few)
        if len(short):
            total = np.full(len(short), few * 0x51ED270B & 0xFFFFFFFF, np.uint64)
            for k in range(few):
                total += words[first[short] + k] * weights[k]
            grams.append(mix(total))
            owners.append(short)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h, of = np.concatenate(grams), np.concatenate(owners).astype(np.uint32)
    order = np.argsort(h)
    order = order[np.argsort(of[order].astype(np.uint16) if rows < 65_536 else of[order], kind="stable")]
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each set."""
    return mix(_sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)).view(np.int64), mix(_sums(mix(h * np.uint64(0xD6E8FEB86659FD93)), at)).view(np.int64)


def _sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for b in blocks(batch, "text"):
            yield (b, *shingle_sets(*byte_view(b.column("text")), width))


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "n", "hi", "lo", "slice", "part", "counts"]
        some = False
        for b, h, at in _sets_of(batches, width):
            some = True
            counts += np.bincount((h & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
            hi, lo = set_keys(h, at)
            none = pa.nulls(len(at) - 1, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(hi), pa.array(lo), none, none, pa.nulls(len(none), pa.binary())], names)
        null, part = pa.nulls(1, pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int32())
        for k, cells in enumerate(np.split(counts, _SLICES)) if some else ():
            packed = zlib.compress(np.minimum(cells, 2**32 - 1).astype(np.uint32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array([k], pa.int32()), part, pa.array([packed], pa.binary())], names)

    return run


def _add(group: pa.Table) -> bytes:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64) for c in group.column("bytes").chunks for x in c)
    return np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()


_LIST = np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<u4"), ("p", "<u4")])


def _salts(count: np.ndarray, mean: float, salt_rows: int) -> np.ndarray:
    """Parts of the lists of n-grams whose cells hold ``count``: what a cell holds on average belongs to others."""
    return (1 + np.maximum(count.astype(np.int64) - int(2 * mean), 0) // salt_rows).astype(np.uint64)


def _prefixes(width: int, percent: int, counts_var, mean: float, buckets: int, salt_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(counts_var.value, np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows["c"], rows["t"]))]
            # Copies of one set send one entry.
            rows = rows[np.append(True, (rows["t"][1:] != rows["t"][:-1]) | (rows["c"][1:] != rows["c"][:-1]))]
            salt = rows["c"].astype(np.uint64) % _salts(counts[rows["t"] & np.uint64(len(counts) - 1)], mean, salt_rows)
            bucket = (mix(rows["t"] ^ mix(salt + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cut[1:], len(bucket))
            for i in range(0, len(cut), 64):
                packed = [b"".join(np.ascontiguousarray(rows[f][a:z]).tobytes() for f in _LIST.names) for a, z in zip(cut[i : i + 64], ends[i : i + 64], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[i : i + 64]].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "lists"])

        for _, h, at in _sets_of(batches, width):
            n = np.diff(at)
            # Prefix: one more than what may be missing of the least overlap, which is percent of the set.
            length = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
            of = np.repeat(np.arange(len(n)), n)
            rank = counts[h & np.uint64(len(counts) - 1)]
            order = np.argsort((of.astype(np.uint64) << np.uint64(32)) | rank, kind="stable")
            place = np.arange(len(h)) - at[:-1][of]
            keep = place < length[of]
            _, lo = set_keys(h, at)
            out = np.empty(int(keep.sum()), _LIST)
            out["t"], out["c"], out["n"], out["p"] = h[order][keep], lo[of][keep], n[of][keep], place[keep]
            held.append(out)
            size += len(out)
            if size > HELD_ENTRIES:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return run


def allowed(n1, p1, n2, p2, percent: int):
    """Length and positional filters for two sets whose first common n-gram stands at places p1 and p2.

    Of the n-grams from there on, enough must be left in both sets.  Where
    the n-gram isn't their first common one, similar sets may fail; at the
    first they pass, so each pair is found there, if nowhere else.
    """
    least = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (np.minimum(n1 - p1, n2 - p2) >= least)


def _shared(percent: int, counts_var, mean: float, salt_rows: int):
    """The lists of a bucket, without the entries that the filters let meet no other; of salted lists, all entries.

    Each list has a name made of its members.  Of lists with equal members the
    first in the order of n-grams is enough: all its positions are smaller,
    so it allows every pair that a later one allows.  Salted lists and pieces
    of long ones are named by themselves.
    """

    def unpack(raw: bytes) -> np.ndarray:
        n = len(raw) // _LIST.itemsize
        rows, at = np.empty(n, _LIST), 0
        for f in _LIST.names:
            rows[f] = np.frombuffer(raw, _LIST[f], n, at)
            at += n * _LIST[f].itemsize
        return rows

    def run(group: pa.Table) -> pa.Table:
        counts = np.frombuffer(counts_var.value, np.uint32)
        rows = np.concatenate([unpack(x.as_py()) for c in group.column("lists").chunks for x in c])
        order = np.argsort(rows["t"], kind="stable")
        t = rows["t"][order]
        same = np.append(False, t[1:] == t[:-1])
        salted = _salts(counts[t & np.uint64(len(counts) - 1)], mean, salt_rows) > 1
        rows = rows[order[same | np.append(same[1:], False) | salted]]
        rows = rows[np.lexsort((rows["c"], rows["n"], rows["t"]))]
        if len(rows):
            rows = rows[np.append(True, (rows["t"][1:] != rows["t"][:-1]) | (rows["c"][1:] != rows["c"][:-1]))]
        t, c, n, p = rows["t"], rows["c"], rows["n"].astype(np.int64), rows["p"].astype(np.int64)
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(t)))
        salts = _salts(counts[t & np.uint64(len(counts) - 1)], mean, salt_rows).astype(np.int64)
        length = np.repeat(size, size)
        kept = (length > SHORT_LIST) | (salts > 1)
        for d in range(1, min(SHORT_LIST, int(size.max(initial=1)))):
            i = np.flatnonzero(t[:-d] == t[d:])
            i = i[allowed(n[i], p[i], n[i + d], p[i + d], percent)]
            kept[i] = kept[i + d] = True
        t, c, n, p, salts = t[kept], c[kept], n[kept], p[kept], salts[kept]
        at = np.arange(len(t))
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(t)))
        inside = at - np.repeat(head, size)
        # Pieces of at most salt_rows entries.
        cut = np.flatnonzero(inside % salt_rows == 0)
        whole = np.append(cut, len(t))
        one, two = _sums(mix(c.view(np.uint64) ^ np.uint64(0x9E6C63D0876A9A47)), whole), _sums(mix(c.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), whole)
        own = (np.repeat(size, size)[cut] > salt_rows) | (salts[cut] > 1)
        # An n-gram and its piece's first member tell pieces apart.
        one[own], two[own] = t[cut][own], mix(c[cut][own].view(np.uint64))
        rank = counts[t[cut] & np.uint64(len(counts) - 1)].astype(np.int64)
        packed = [n[i:j].astype("<u4").tobytes() + p[i:j].astype("<u4").tobytes() + c[i:j].tobytes() for i, j in zip(cut, whole[1:], strict=True)]
        # About how long the whole list is, of which a salted one's part is here.
        length = (np.repeat(size, size) * salts)[cut]
        order = (t[cut] ^ np.uint64(1 << 63)).view(np.int64)
        return pa.table({"one": one.view(np.int64), "two": two.view(np.int64), "rank": rank, "order": order, "token": t[cut].view(np.int64), "length": length, "members": pa.array(packed, pa.binary())})

    return run


_LISTS = "one long, two long, rank long, order long, token long, length long, members binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column("members").to_pylist()
        size = np.array([len(x) // 16 for x in raw], np.int64)
        n, p, c = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind, k, at * k) for x, k in zip(raw, size.tolist(), strict=True))]) for kind, at in (("<u4", 0), ("<u4", 4), ("<i8", 8)))
        token, length = (np.repeat(b.column(k).to_numpy(), size) for k in ("token", "length"))
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(p.astype(np.int64)), pa.array(length)], ["token", "cls", "n", "pos", "length"])


#: Pairs of nodes, with the keys of their sets.
_PAIR = ("a", "b", "hi_a", "lo_a", "hi_b", "lo_b")
_PAIRS = ", ".join(f"{c} long" for c in _PAIR)


def _as_pairs(at: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of the rows ``at``, the smaller node first."""
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    _, first = np.unique(np.stack([node[i], node[j]], 1), axis=0, return_index=True)
    i, j = i[first], j[first]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], hi[i], lo[i], hi[j], lo[j])], list(_PAIR))


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(k).to_numpy() for k in names]


_ENTRY = ("token", "node", "n", "pos", "comp", "hi", "lo")


def _neighbours(percent: int, reach: int):
    """Pairs of entries up to ``reach`` places apart in a list, if in different components and allowed; lists come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(0, np.int64)] * len(_ENTRY)
        for b in batches:
            rows = [np.concatenate(x) for x in zip(before, _columns(b, *_ENTRY), strict=True)]
            t, node, n, p, comp, hi, lo = rows
            found = []
            for d in range(1, reach + 1):
                i = np.flatnonzero((t[:-d] == t[d:]) & (comp[:-d] != comp[d:]))
                i = i[allowed(n[i], p[i], n[i + d], p[i + d], percent)]
                found.append((i, i + d))
            yield _as_pairs(found, node, hi, lo)
            before = [x[-reach:] for x in rows]

    return run


def _cells(b: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), np.uint8).reshape(-1, SUFFIX_CELLS)


def may_overlap(x: np.ndarray, n1: np.ndarray, y: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: a common n-gram lies in the same cell of both sets' partitions, so these bound the overlap."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    return ((x == 255) & (y == 255)).any(1) | (most >= -(-percent * (n1 + n2) // (100 + percent)))


def _meet(percent: int):
    """Allowed pairs that pass the suffix filter between different components, of each cell (token, first, second): two parts of a list, or one with itself.

    Cells come sorted and whole, each of a bounded number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
            t, first, second, part, node, n, p, comp, hi, lo, cells = rows
            new = np.append(True, (t[1:] != t[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
            cell, begin = np.cumsum(new), np.flatnonzero(new)
            size = np.diff(np.append(begin, len(t)))
            found = []

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                ok = comp[i] != comp[j]
                i, j = i[ok], j[ok]
                ok = allowed(n[i], p[i], n[j], p[j], percent)
                i, j = i[ok], j[ok]
                for k in range(0, len(i), 4096):
                    a, b = i[k : k + 4096], j[k : k + 4096]
                    ok = may_overlap(cells[a], n[a], cells[b], n[b], percent)
                    if ok.any():
                        found.append((a[ok], b[ok]))

            short = (size <= SHORT_LIST)[cell - 1]
            for d in range(1, min(SHORT_LIST, int(size.max(initial=1)))):
                i = np.flatnonzero((cell[:-d] == cell[d:]) & short[:-d])
                i = i[(first[i] == second[i]) | (part[i] != part[i + d])]
                keep(i, i + d)
            for k in np.flatnonzero(size > SHORT_LIST):
                at = np.arange(begin[k], begin[k] + size[k])
                alone = first[at[0]] == second[at[0]]
                left, right = (at, at) if alone else (at[part[at] == first[at[0]]], at[part[at] == second[at[0]]])
                for i in left:
                    j = right[right > i] if alone else right
                    keep(np.full(len(j), i), j)
            return _as_pairs(found, node, hi, lo)

        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = [*_columns(b, "token", "first", "second", "part", *_ENTRY[1:]), _cells(b, "cells")]
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            if held and any(held[-1][k][-1] != rows[k][0] for k in range(3)):
                yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            if len(new):
                yield pairs([np.concatenate(x) for x in zip(*held, [x[: new[-1]] for x in rows], strict=True)])
                held = [[x[new[-1] :] for x in rows]]
            else:
                held.append(rows)
        if held:
            yield pairs([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _contents(width: int, wanted_var):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted_var.value, np.uint8)
        some = (b.filter(pa.array(passes(bits, b.column("doc_id").to_numpy()))) for b in batches)
        for b, h, at in _sets_of(some, width):
            hi, lo = set_keys(h, at)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            cells = np.bincount(of * SUFFIX_CELLS + (h >> np.uint64(56)).astype(np.int64), minlength=(len(at) - 1) * SUFFIX_CELLS)
            cells = np.minimum(cells, 255).astype(np.uint8).reshape(-1, SUFFIX_CELLS)
            raw = h.tobytes()
            grams = pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(np.diff(at)), pa.array([x.tobytes() for x in cells], pa.binary()), grams], ["hi", "lo", "size", "cells", "grams"])
            # Texts without words pass by chance only.
            yield out.filter(pa.array(np.diff(at) > 0))

    return run


def _suffix_filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n1, n2 = (b.column(k).to_numpy() for k in ("size_a", "size_b"))
            yield b.select(list(_PAIR)).filter(pa.array(may_overlap(_cells(b, "cells_a"), n1, _cells(b, "cells_b"), n2, percent)))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("grams_a"), b.column("grams_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append((100 + percent) * common >= percent * (len(x) + len(y)))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(pairs: DataFrame, contents: DataFrame, percent: int, name: str, filtered: bool) -> DataFrame:
    """(a, b): those of the distinct ``pairs`` of nodes that are similar enough; ``filtered`` pairs have passed the suffix filter."""

    def side(sets: DataFrame, k: str, *columns: str) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("hi", "lo", *columns)])

    near = pairs
    if not filtered:
        near = near.join(side(contents, "a", "size", "cells"), ["hi_a", "lo_a"]).join(side(contents, "b", "size", "cells"), ["hi_b", "lo_b"])
        near = materialize(near.mapInArrow(_suffix_filter(percent), _PAIRS), f"{name}-near")
    # Only sets that are still asked for are shuffled.
    asked = contents.sparkSession.sparkContext.broadcast(membership_filter(near.select(F.explode(F.array("lo_a", "lo_b")))))
    some = contents.select("hi", "lo", "grams").mapInArrow(only(asked, "lo"), "hi long, lo long, grams binary")
    near = near.join(side(some, "a", "grams"), ["hi_a", "lo_a"]).join(side(some, "b", "grams"), ["hi_b", "lo_b"])
    return materialize(near.mapInArrow(tidy(_verify(percent)), "a long, b long"), f"{name}-links")


def _rest_pairs(lists: DataFrame, contents: DataFrame, percent: int, part_rows: int) -> DataFrame:
    """All pairs between different components of each list that the filters let pass.

    The largest component of a list needs no pairs of its own: it is cut into
    parts that meet the parts of all others, and those meet one another.
    """
    by_comp = lists.groupBy("token", "comp").agg(F.count("*").alias("own"))
    top = by_comp.groupBy("token").agg(F.max(F.struct("own", "comp")).alias("top"), F.sum("own").alias("members"), F.count("*").alias("comps")).where("comps > 1")
    top = materialize(top.select("token", F.col("top.comp").alias("top"), F.col("top.own").alias("own"), "members"), "open")
    rows = lists.join(top, "token").join(contents.select("hi", "lo", "cells"), ["hi", "lo"]).withColumn("apart", F.col("comp") != F.col("top"))
    others = F.ceil((F.col("members") - F.col("own")) / part_rows).cast("int")
    tops = F.ceil(F.col("own") / part_rows).cast("int")
    whole = F.col("members") <= part_rows
    dealt = F.xxhash64("node")
    rows = rows.withColumn("part", F.when(whole, 0).when(F.col("apart"), F.pmod(dealt, others)).otherwise(others + F.pmod(dealt, tops)).cast("int"))
    every, apart = F.sequence(F.lit(0), others + tops - 1), F.sequence(F.lit(0), others - 1)
    rows = rows.withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).when(F.col("apart"), every).otherwise(apart)))
    rows = rows.select(F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", *_ENTRY, "cells")
    return rows.repartition("token", "first", "second").sortWithinPartitions("token", "first", "second").mapInArrow(_meet(percent), _PAIRS)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text
    with fewer than ``width`` words has its whole sequence as its one n-gram;
    a null, empty or blank text has none and is linked with nothing.
    Documents link when 100 * common >= percent * united.  Rows are linked by
    their texts, so repeated ids are allowed; a null id is no id: its row has
    the smallest id that others of its component have, or null.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    profile = materialize(rows.mapInArrow(tidy(_profile(width)), "doc_id long, n long, hi long, lo long, slice int, part int, counts binary"), "profile")
    keys = profile.where("slice is null").select("doc_id", "n", "hi", "lo")
    counts = fold(profile.where("slice is not null").select("slice", "part", F.col("counts").alias("bytes")), _add) or np.zeros(1 << COUNT_BITS, np.uint32).tobytes()
    counts_var = spark.sparkContext.broadcast(counts)
    total = int(keys.agg(F.sum("n")).first()[0] or 0)
    mean = total / (1 << COUNT_BITS)
    buckets = max(8, partitions(spark), total * (100 - percent) // 100 // BUCKET_ENTRIES)

    classes = keys.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")
    lists = rows.select("text").mapInArrow(tidy(_prefixes(width, percent, counts_var, mean, buckets, salt_rows)), "bucket int, lists binary")
    lists = lists.groupBy("bucket").applyInArrow(tidy(_shared(percent, counts_var, mean, salt_rows)), _LISTS)
    lists = lists.groupBy("one", "two").agg(F.min_by(F.struct("token", "length", "members"), F.struct("rank", "order")).alias("first")).select("first.*")
    lists = materialize(lists.mapInArrow(_entries, "token long, cls long, n long, pos long, length long"), "entries").join(classes.select(F.col("lo").alias("cls"), "lo", "hi", "node", F.coalesce("rep", F.lit(_NO_ID)).alias("rep")), "cls")
    lists = materialize(lists.select("token", "node", "n", "pos", "length", "hi", "lo", "rep"), "lists")
    # Filters of fixed size spare the shuffle of texts and sets; what passes by chance meets no pair.
    wanted_var = spark.sparkContext.broadcast(membership_filter(lists.select("rep")))
    named = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    contents = materialize(named.mapInArrow(tidy(_contents(width, wanted_var)), "hi long, lo long, size long, cells binary, grams binary"), "contents")
    # A set that is there twice, as a copy passed by chance, only makes a pair twice; with repeated or null ids there may be many.
    if not contents.groupBy("hi", "lo").count().where("count > 2").isEmpty():
        contents = materialize(contents.dropDuplicates(["hi", "lo"]), "contents")

    labels = pairs = None
    step, last = 0, False
    while True:
        now = lists.select("token", "node", "n", "pos", "length", "hi", "lo")
        now = now.withColumn("comp", F.col("node")) if labels is None else now.join(labels, "node", "left").select(*now.columns, F.coalesce("component", "node").alias("comp"))
        if last:
            found = _rest_pairs(materialize(now.drop("length"), "labelled"), contents, percent, part_rows)
        else:
            # Parts of a long list, dealt anew each round; inside them the first round goes by length, the others by chance.
            part = F.pmod(F.xxhash64("node", F.lit(step)), F.ceil(F.col("length") / salt_rows))
            dealt = now.withColumn("part", part).withColumn("key", F.col("n") if step == 0 else F.xxhash64("node", F.lit(-step)))
            found = dealt.repartition("token", "part").sortWithinPartitions("token", "part", "key").mapInArrow(_neighbours(percent, 1 if step == 0 else 2), _PAIRS)
        # One exchange makes pairs distinct and leaves out those of earlier rounds.
        marked = found.withColumn("old", F.lit(0))
        if pairs is not None:
            marked = marked.unionByName(pairs.withColumn("old", F.lit(1)))
        found = materialize(marked.groupBy(*_PAIR).agg(F.max("old").alias("old")).where("old = 0").drop("old"), "pairs")
        links = _links(found, contents, percent, "last" if last else f"round-{step}", last)
        known = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = star_links(known)
        if last:
            break
        pairs = found if pairs is None else pairs.unionByName(found)
        step += 1
        last = step == MOST_ROUNDS or links.count() * WORTH_A_ROUND <= found.count()
    named_sets = classes.join(labels, "node", "left").select("hi", "lo", "rep", F.coalesce("component", "node").alias("component"))
    # Written before they are joined, so that Spark can split the rows of a large component or class.
    least = materialize(named_sets.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named_sets = materialize(named_sets.join(least, "component").select("hi", "lo", "component_id"), "components")
    out = keys.where("n > 0").join(named_sets, ["hi", "lo"]).select("doc_id", "n", "component_id")
    out = out.unionByName(keys.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
