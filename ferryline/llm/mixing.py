"""Mixing sources to target weights by temperature.

A source with share ``p`` of all tokens gets the weight ``p ** t / sum(p ** t)``. The
exponent ``t`` is found by section: from 0 to 1 the entropy of the weights falls, and so
does the largest number of times a source has to be repeated. Weights times a budget of tokens are
then realised in blocks, each with its share of the source's budget: whole passes over the
block, and the beginning of one more random permutation of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch, broadcast_if_few, set_aside, settled, words

#: Exponents tried at once, and how often: what is left is 1 / 17 ** 9 wide.
TRIED, ROUNDS = 16, 9


@dataclass(frozen=True)
class Target:
    """What the weights are to meet.

    ``entropy`` : the least, as a part of the largest possible, log of the number of sources; None
    for no target. ``repetition`` : most passes over any source; None for no limit. The limit
    goes first, and exponents are from 0 (all sources alike) to 1 (natural shares).
    ``budget`` : tokens of the mixture; None for as many as there are.
    """

    entropy: float | None = 0.97
    repetition: float | None = 4.0
    budget: int | None = None


def token_count(text: Column) -> Column:
    """Words of a text."""
    return F.size(words(text)).cast("long")


def source_totals(narrow: DataFrame) -> DataFrame:
    """Documents, tokens and share of each source; sources without tokens have share 0."""
    sums = narrow.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")
    )
    return sums


def _sections(shares: DataFrame, enough: Column, low: float, high: float) -> float:
    """The least exponent at which ``enough`` holds, if it holds at the upper end.

    ``enough`` is an aggregate over sources with the columns ``p``; ``{t}`` in it stands for the
    exponent. Each round is one small job over the sources, which are never gathered.
    """
    for _ in range(ROUNDS):
        tried = [low + (high - low) * (k + 1) / (TRIED + 1) for k in range(TRIED)]
        holds = shares.agg(*[enough(t).alias(f"t{k}") for k, t in enumerate(tried)]).first()
        met = [bool(h) for h in holds]
        first = met.index(True) if any(met) else TRIED
        ends = [low, *tried, high]
        low, high = ends[first], ends[first + 1]
    return high


def find_exponent(shares: DataFrame, sources: int, ratio: float, target: Target) -> float:
    """The exponent for a table with the shares ``p`` (positive, summing to 1) of sources.

    ``ratio`` is the budget over all tokens. A repetition limit below the ratio cannot be met: the
    natural shares, exponent 1, come nearest to it.
    """

    def power_sum(t: float) -> Column:
        return F.sum(F.pow("p", F.lit(t)))

    exponent = 1.0
    if target.entropy is not None and sources > 1:
        wanted = target.entropy * math.log(sources)

        def spread(t: float) -> Column:
            tilted = F.sum(F.pow("p", F.lit(t)) * F.log("p")) / power_sum(t)
            return F.log(power_sum(t)) - t * tilted <= wanted

        exponent = _sections(shares, spread, 0.0, 1.0)
    if target.repetition is not None and exponent < 1:

        def repeated(t: float) -> Column:
            most = F.max(F.pow("p", F.lit(t - 1.0)))
            return ratio * most / power_sum(t) <= target.repetition

        if not shares.agg(repeated(exponent)).first()[0]:
            exponent = _sections(shares, repeated, exponent, 1.0)
    return exponent


def _uniform(*parts: str | Column) -> Column:
    """A number from 0 to 1 for the parts, the same each time."""
    hashed = F.pmod(F.xxhash64(*parts), F.lit(1 << 40))
    return hashed / float(1 << 40)


def plan(
    documents: DataFrame,
    scratch: Scratch,
    *,
    target: Target = Target(),
    seed: int = 1,
    block_tokens: int = 500_000,
) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of the documents, and what each block of them is to give.

    The first, in ``scratch``, has ``doc_id, source, n_tokens``; the second, settled, has for each
    ``source, _block`` the ``weight`` and ``share`` of the source, its ``_blocks``, the
    ``exponent``, ``_passes`` and ``_last``, the place in the permutation up to which one more
    copy is drawn.
    """
    narrow = scratch.keep(
        documents.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens")), "narrow"
    )
    totals = scratch.keep(source_totals(narrow), "totals")
    tokens, sources = totals.where("tokens > 0").agg(F.sum("tokens"), F.count("*")).first()
    tokens = tokens or 0
    budget = tokens if target.budget is None else target.budget
    shares = totals.where("tokens > 0").withColumn("p", F.col("tokens") / float(max(tokens, 1)))
    exponent = find_exponent(shares, sources, budget / max(tokens, 1), target) if sources else 1.0
    powers = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weighted = shares.select(
        "source",
        F.col("p").alias("share"),
        (F.pow("p", F.lit(exponent)) / powers).alias("weight"),
        F.col("tokens").alias("_tokens"),
        F.ceil(F.col("tokens") / block_tokens).alias("_blocks"),
    )
    weighted = scratch.keep(weighted, "weighted")
    blocked = _in_blocks(narrow.where("n_tokens > 0"), weighted, seed)
    # Each block's part of the source's budget, rounded up or down at random without bias.
    sums = blocked.groupBy("source", "_block").agg(
        F.sum("n_tokens").alias("_sum"),
        F.first("share").alias("share"),
        F.first("weight").alias("weight"),
        F.first("_tokens").alias("_tokens"),
    )
    exact = F.col("weight") * float(budget) * F.col("_sum") / F.col("_tokens")
    given = F.floor(exact + _uniform("source", "_block", F.lit(f"round-{seed}")))
    budgets = sums.select(
        "source", "_block", "share", "weight",
        F.floor(given / F.col("_sum")).cast("int").alias("_passes"),
        (given % F.col("_sum")).alias("_rest"),
    )
    budgets = scratch.keep(budgets, "budgets")
    order = Window.partitionBy("source", "_block").orderBy("_order", "doc_id")
    ends = F.sum("n_tokens").over(order)  # rows that are equal come in together
    drawn = (
        blocked.drop("share", "weight", "_tokens")
        .withColumn("_end", ends)
        .join(
            budgets.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_rest"),
            F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")),
        )
        # A document is drawn if over half of it fits: on average the budget is met.
        .where(F.col("_end") - F.col("n_tokens") / 2 <= F.col("_rest"))
        .groupBy("source", "_block")
        .agg(F.max(F.struct("_order", "doc_id")).alias("_last"))
        .select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_last")
    )
    cuts = budgets.join(
        drawn,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")),
        "left",
    ).drop("_s", "_b", "_rest")
    numbers = weighted.select(F.col("source").alias("_s"), "_blocks")
    blocks = cuts.join(numbers, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return narrow, settled(blocks.withColumn("exponent", F.lit(exponent)))


def _in_blocks(rows: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """Add the block and the place in its permutation, and the columns of ``blocks``."""
    given = broadcast_if_few(blocks).withColumnRenamed("source", "_s")
    joined = rows.join(given, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumns(
        {
            "_block": F.pmod(F.xxhash64("doc_id", F.lit(f"block-{seed}")), F.col("_blocks")),
            "_order": F.xxhash64("doc_id", F.lit(f"order-{seed}")),
        }
    ).drop("_blocks")


def _copies(rows: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """Rows once for each time they are drawn, with ``epoch`` from 0."""
    by_source = blocks.select("source", "_blocks").distinct()
    placed = _in_blocks(rows, by_source, seed)
    cuts = broadcast_if_few(blocks.drop("_blocks").withColumnsRenamed({"source": "_s", "_block": "_b"}))
    joined = placed.join(
        cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))
    )
    once_more = F.coalesce(F.struct("_order", "doc_id") <= F.col("_last"), F.lit(False))
    copies = F.col("_passes") + once_more.cast("int")
    return (
        joined.withColumn("_copies", copies)
        .where("_copies > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        .drop("_block", "_order", "_s", "_b", "_passes", "_last", "_copies")
    )


def mixture(
    documents: DataFrame, *, target: Target = Target(), seed: int = 1, block_tokens: int = 500_000
) -> DataFrame:
    """The drawn documents as narrow rows, one for each copy.

    Columns ``doc_id, source, n_tokens, share, weight, exponent, epoch`` and ``position``: sorting by
    it shuffles the mixture. A null source is a source. Documents without words are never
    drawn. Rows with the same id are drawn together. An empty table gives no rows.
    """
    with Scratch(documents.sparkSession) as scratch:
        narrow, blocks = plan(
            documents, scratch, target=target, seed=seed, block_tokens=block_tokens
        )
        drawn = _copies(narrow.where("n_tokens > 0"), blocks, seed)
        position = F.xxhash64("doc_id", "epoch", F.lit(f"position-{seed}"))
        return settled(
            drawn.select(
                "doc_id", "source", "n_tokens", "share", "weight", "exponent", "epoch",
                position.alias("position"),
            )
        )


def mixed_documents(
    documents: DataFrame, *, target: Target = Target(), seed: int = 1, block_tokens: int = 500_000
) -> DataFrame:
    """The documents themselves, with all their columns, as often as they are drawn.

    See :func:`mixture`. Texts do not move while the blocks are few enough to be broadcast.
    """
    with Scratch(documents.sparkSession) as scratch:
        _, blocks = plan(documents, scratch, target=target, seed=seed, block_tokens=block_tokens)
    rows, columns = set_aside(documents, ("doc_id", "source", "text"))
    drawn = _copies(rows.where(token_count(F.col("text")) > 0), blocks, seed)
    return drawn.select(*columns)
