"""What operators on pairs share: buckets cut into cells, and connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch

#: Members of one half of a cell at most, about, and entries of small buckets that go together.
HALF, TOGETHER = 1024, 4096


def in_cells(entries: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Rows that bring any two members of a bucket together in exactly one cell.

    ``entries`` has ``bucket`` (long) and ``id`` and may have more; ``sizes`` has one row for
    each bucket that counts, with its ``size``; ``total`` is the sum of the sizes, about. Adds
    ``half`` (int), ``left``, ``right`` (int) and ``task`` (long), to group by.

    A bucket of more than HALF members is dealt into halves by a hash, and any two halves,
    and each with itself, are a cell of their own: two members of one cell are to be compared if their
    halves are ``left`` and ``right`` in any order. No task holds more than a cell, however
    large the bucket, and smaller buckets share tasks.
    """
    groups = max(1, math.ceil(total / TOGETHER))
    halves = F.ceil(F.col("size") / HALF).cast("int")
    half = F.pmod(F.xxhash64("id"), F.col("_halves")).cast("int")
    dealt = (
        entries.join(sizes.withColumn("_halves", halves).drop("size"), "bucket")
        .withColumn("half", half)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_halves") - 1)))
        .withColumn("left", F.least("half", "_other"))
        .withColumn("right", F.greatest("half", "_other"))
    )
    alone = F.xxhash64("bucket", "left", "right")
    shared = F.pmod(F.xxhash64("bucket"), F.lit(groups))
    # Small buckets get numbers below zero, which a hash of a large one hardly ever equals; if
    # it does, the two are worked on together.
    task = F.when(F.col("_halves") > 1, alone).otherwise(-1 - shared)
    return dealt.withColumn("task", task).drop("_halves", "_other")


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """``id, component`` (the least id that can be reached) of all that is linked.

    ``links`` has two long columns. Large and small stars in turn: each node's neighbours are
    moved to the least one until nothing moves, which takes a number of rounds logarithmic in the
    size of a component, not in its diameter. Each round is written to the shared folder.
    """
    a, b = links.columns
    edges = links.select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    ).where("a <> b").distinct()
    edges, turn, before = scratch.keep(edges, f"{name}-0"), 0, None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = scratch.keep(_small_star(_large_star(edges)), f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        turn += 1
    # Every edge leads to the least node of its component now.
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.where("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
