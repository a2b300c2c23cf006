"""Connected components over links, by local contraction and alternating large and small stars.

Every task contracts up to about ``TASK_LINKS`` links to stars, which leaves few
rounds to do across tasks.  Rounds end when all links are stars.

Every round writes its links to the shared folder, so lineage stays short and
a lost executor costs one round.  A hub's links are never gathered in a task:
its smallest neighbour comes from a partial aggregation, written before it is
joined back, so that Spark can split the hub's partition of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Links (16 bytes each) that one task contracts, on average.
TASK_LINKS = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest node of each component they make."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["u", "v"])


def _star(links: DataFrame, large: bool, name: str) -> DataFrame:
    """links (u, v) -> (u, v) with u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to its centre and no centre has a larger one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf")))).alias("e"))
    by = ends.groupBy("e.node").agg(F.sum("e.leaf").alias("as_leaf"), F.count("*").alias("n"))
    return by.where("as_leaf > 0 and n > 1").isEmpty()


def star_links(links: DataFrame, task_links: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node but the smallest ones, of ``links`` (two long columns).

    Loops, repeated and reversed links are allowed; without links the result is empty.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    while True:
        tasks = max(1, -(-now.count() // (task_links or TASK_LINKS)))
        now = materialize(now.coalesce(tasks).mapInArrow(tidy(_contract), "u long, v long"), "links")
        # What one task has contracted has no more to do.
        if tasks == 1 or _are_stars(now):
            return now.toDF("node", "component")
        now = materialize(_star(_star(now, True, "large"), False, "small"), "links")


def connected_components(links: DataFrame, task_links: int | None = None) -> DataFrame:
    """(node, component): ``star_links``, with the smallest nodes too."""
    now = star_links(links, task_links)
    return now.unionByName(now.select(F.col("component").alias("node"), "component").distinct())
