"""A uniform shuffle into shards of exact sizes, by a matrix of hypergeometric draws.

Rows fall into blocks by a hash. How many rows each block sends to each shard is drawn
first, from the multivariate hypergeometric law, so that all shards get their exact
sizes whatever happens next. Each block is then permuted by itself, and its first rows go
to the first shard, the next ones to the second, and so on. Each shard is permuted again
where it arrives. The result has the law of a shuffle of all rows, and no task ever sorts
more than one block or one cell of a shard.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch, settled


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good + bad`` without replacement.

    Inversion, walking outwards from the mode: the steps are about one standard deviation.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    left = rng.random()
    up = down = math.exp(
        log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws)
    )
    above = below = mode
    left -= up
    while left >= 0 and (above < high or below > low) and max(up, down) > 1e-300:
        if above < high:
            up *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            left -= up
            if left < 0:
                return above
        if below > low:
            down *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            left -= down
            if left < 0:
                return below
    return mode


def communication_matrix(sent: list[int], received: list[int], seed: int) -> list[list[int]]:
    """Counts from each block to each shard with the given row and column sums."""
    if sum(sent) != sum(received):
        raise ValueError("what is sent must be what is received")
    rng, room, matrix = random.Random(seed), list(received), []
    for size in sent:
        left, total, row = size, sum(room), []
        for shard, free in enumerate(room):
            total -= free
            taken = hypergeometric(rng, free, total, left)
            room[shard] -= taken
            left -= taken
            row.append(taken)
        matrix.append(row)
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _random(seed: int, what: str, *by: str) -> Column:
    return F.xxhash64(*by, F.lit(f"{what}-{seed}"))


def shuffle_to_shards(
    rows: DataFrame,
    *,
    by: list[str],
    shards: int = 8,
    seed: int = 1,
    block_rows: int = 20_000,
    cell_rows: int = 20_000,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Parameters
    ----------
    by : columns that tell rows apart. Rows equal in all of them are alike in the shuffle
        and fall into one block; null counts as a value.
    block_rows, cell_rows : rows of a block, and of the piece of a shard that one task
        permutes, on average. The driver draws one line of ``shards`` counts for each block
        and holds nothing else.

    Empty input gives no rows. Columns named ``shard`` or ``slot`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    names = {c: f"_{i}_{c}" for i, c in enumerate(rows.columns)}
    inner, keys = rows.withColumnsRenamed(names), [names[c] for c in by]

    total = rows.count()
    blocks = max(1, math.ceil(total / block_rows))
    cells = max(1, math.ceil(total / shards / cell_rows))
    blocked = inner.withColumn("_block", F.pmod(_random(seed, "block", *keys), F.lit(blocks)))
    sent = sorted(map(tuple, blocked.groupBy("_block").count().collect()))
    matrix = communication_matrix([n for _, n in sent], shard_sizes(total, shards), seed)
    ends = [
        (block, [sum(row[: s + 1]) for s in range(shards)])
        for (block, _), row in zip(sent, matrix, strict=True)
    ]
    ends = spark.createDataFrame(ends, "_block long, _ends array<long>")

    inside = Window.partitionBy("_block").orderBy(_random(seed, "first", *keys), *keys)
    ranked = blocked.withColumn("_rank", F.row_number().over(inside))
    sent_to = F.size(F.filter("_ends", lambda end: end < F.col("_rank")))
    arrived = ranked.join(ends, "_block").select(
        *names.values(),
        sent_to.alias("_shard"),
        F.pmod(_random(seed, "cell", *keys), F.lit(cells)).alias("_cell"),
    )
    with Scratch(spark) as scratch:
        arrived = scratch.keep(arrived, "arrived")
        sizes = arrived.groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(
            Window.unboundedPreceding, -1
        )
        starts = sizes.select(
            "_shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
        )
        inside = Window.partitionBy("_shard", "_cell").orderBy(
            _random(seed, "second", *keys), *keys
        )
        placed = arrived.withColumn("_rank", F.row_number().over(inside))
        found = placed.join(starts, ["_shard", "_cell"]).select(
            *[F.col(new).alias(old) for old, new in names.items()],
            F.col("_shard").alias("shard"),
            (F.col("_start") + F.col("_rank") - 1).alias("slot"),
        )
        return settled(found)


def sharded_documents(documents: DataFrame, *, shards: int = 8, seed: int = 1) -> DataFrame:
    """The plan of a shuffle of documents: one narrow row for each, with its checksum.

    A null text has no bytes: size 1 and checksum 0. Documents are told apart by id, size and
    checksum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = shuffle_to_shards(
        narrow, by=["doc_id", "size", "text_crc32"], shards=shards, seed=seed
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
