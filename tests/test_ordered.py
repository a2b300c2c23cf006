"""Order-free running sums against a plain loop."""

import random

from pyspark.sql import functions as F

from cloakframe.operators.ordered import places, running_sums
from cloakframe.operators.pseudonymize import sequential_map


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(f"k{i:04d}", rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n long")
    for ranges in (1, 7, 64):
        got = {r.k: (r.upto, r["__next"]) for r in running_sums(df, [F.col("k")], {"upto": F.col("n")}, following=F.col("k"), ranges=ranges).collect()}
        total, ordered = 0, sorted(rows)
        for i, (k, n) in enumerate(ordered):
            total += n
            assert got[k] == (total, ordered[i + 1][0] if i + 1 < len(ordered) else None)


def test_places_in_mixed_order(spark):
    rows = [(i % 3, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "n int, v string")
    got = {r.v: r.at for r in places(df, [-F.col("n"), F.col("v")], "at", ranges=9).collect()}
    assert got == {v: k + 1 for k, (n, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}


def test_empty(spark):
    assert places(spark.createDataFrame([], "v string"), [F.col("v")], "at").count() == 0


def test_long_numbers_stay_whole(spark):
    """Past the padded digits pseudonyms stay one-to-one."""
    df = spark.range(1, 1200).select(F.format_string("%05d", "id").alias("v"))
    m = sequential_map(df, "v", digits=2)
    assert m.select("pseudonym").distinct().count() == 1199 and m.where("pseudonym = 'ID_1199'").count() == 1
    known = spark.createDataFrame([("a", "ID_900"), ("b", "ID_07")], "original string, pseudonym string")
    more = {r.original: r.pseudonym for r in sequential_map(spark.createDataFrame([("a",), ("c",)], "v string"), "v", known).collect()}
    assert more == {"a": "ID_900", "b": "ID_07", "c": "ID_000901"}
