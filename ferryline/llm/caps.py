"""Near-duplicate vectors by spherical-cap filters with structured random directions.

A direction is a product code: the vector is turned at random, cut into blocks, and the
direction takes one of a few random unit vectors in each block, so a few hundred vectors make millions
of directions. A vector is listed with the directions of the caps it lies in: the cap is as wide
as takes in the ``listed`` best directions, which are found exactly by merging the sorted blocks.
Two vectors at a small angle share most caps. Vectors meet in the caps they share, and every
pair is confirmed by its cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import Scratch, settled
from ferryline.llm.linking import components, in_cells


@dataclass(frozen=True)
class Settings:
    """``listed`` directions for each vector; of each code, as many words as make about
    ``spread`` directions for each listed one, so that unlike vectors rarely meet."""

    cosine: float = 0.98
    listed: int = 40
    blocks: int = 4
    least_words: int = 32
    spread: float = 1.0
    seed: int = 1

    def words(self, vectors: int) -> int:
        """Words of each block's code; grows slowly with the number of vectors."""
        wanted = (max(vectors, 1) * self.listed * self.spread) ** (1 / self.blocks)
        return max(self.least_words, math.ceil(wanted))


def codes(dims: int, words: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation (of ``dims`` padded to whole blocks), and the words of each block."""
    rng = np.random.default_rng([settings.seed, dims, words])
    width = math.ceil(dims / settings.blocks)
    rotation, _ = np.linalg.qr(rng.standard_normal((width * settings.blocks,) * 2))
    made = rng.standard_normal((settings.blocks, words, width))
    return rotation, made / np.linalg.norm(made, axis=2, keepdims=True)


def _best_sums(left: np.ndarray, right: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` largest sums of one of ``left`` and one of ``right`` in each row, descending.

    Both are sorted so: the sum of the i-th and the j-th is among the best only if
    ``(i + 1) (j + 1) <= keep``, since at least so many are no smaller.
    """
    i, j = np.meshgrid(np.arange(left.shape[1]), np.arange(right.shape[1]), indexing="ij")
    possible = (i + 1) * (j + 1) <= keep
    i, j = i[possible], j[possible]
    sums = left[:, i] + right[:, j]
    order = np.argsort(-sums, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(sums, order, 1), i[order], j[order]


def directions(vectors: np.ndarray, words: int, settings: Settings) -> np.ndarray:
    """The ``listed`` best directions of each unit vector, as numbers in base ``words``."""
    rotation, code = codes(vectors.shape[1], words, settings)
    padded = np.pad(vectors, ((0, 0), (0, rotation.shape[0] - vectors.shape[1]))) @ rotation
    parts = padded.reshape(len(vectors), settings.blocks, -1)
    scores = np.einsum("nbw,bcw->nbc", parts, code)
    order = np.argsort(-scores, axis=2, kind="stable")[:, :, : settings.listed]
    scores = np.take_along_axis(scores, order, 2)
    sums, numbers = scores[:, 0], order[:, 0].astype(np.int64)
    for block in range(1, settings.blocks):
        sums, i, j = _best_sums(sums, scores[:, block], settings.listed)
        numbers = np.take_along_axis(numbers, i, 1) * words + np.take_along_axis(order[:, block], j, 1)
    return numbers


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: no nulls, all finite, not zero."""
    infinite = F.lit(float("inf"))
    sound = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (x < infinite) & (x > -infinite),
    )
    return F.coalesce(
        vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _rows(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def listed_caps(nodes: DataFrame, words: int, settings: Settings) -> DataFrame:
    """``id, caps``: a hash of group, length and direction for each cap a vector lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.columns
            lengths = np.diff(vectors.offsets.to_numpy())
            for length in np.unique(lengths):
                chosen = pa.array(np.flatnonzero(lengths == length))
                matrix = _rows(vectors.take(chosen))
                matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
                found = directions(matrix, words, settings)
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                caps = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(chosen), caps], names=["id", "caps"])

    made = nodes.select("id", "vector").mapInArrow(run, "id long, caps array<long>")
    return made


def _links_in_cells(cells: DataFrame, settings: Settings) -> DataFrame:
    """``id, links, root``: what a vector is linked with in a cell, and the least id linked there.

    A pair counts in the first of the caps it shares only, so that sums over cells are exact.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("right", "left", "bucket")])
        table = table.take(pa.array(order))
        taken = {c: table[c].to_numpy() for c in ("id", "copies", "bucket", "left", "right", "half")}
        keys = np.stack([taken[c] for c in ("bucket", "left", "right")])
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        vectors, caps = (table[c].combine_chunks() for c in ("vector", "caps"))
        out: dict[str, list] = {"id": [], "links": [], "root": []}
        for start, end in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            if end - start < 2:
                continue
            ids, half = taken["id"][start:end], taken["half"][start:end]
            matrix = _rows(vectors.slice(start, end - start))
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            linked = matrix @ matrix.T >= settings.cosine
            linked &= ids[:, None] != ids[None, :]
            if taken["left"][start] != taken["right"][start]:
                linked &= half[:, None] != half[None, :]
            if not linked.any():
                continue
            some = np.flatnonzero(linked.any(1))
            linked, ids, copies = linked[np.ix_(some, some)], ids[some], taken["copies"][start:end][some]
            own = [np.asarray(caps[start + i].values) for i in some]
            linked &= ~_met_before(own, taken["bucket"][start])
            roots = _roots(linked, ids)
            out["id"] += ids.tolist()
            out["links"] += (linked @ copies).tolist()
            out["root"] += roots.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return cells.groupBy("task").applyInArrow(run, "id long, links long, root long")


def _met_before(caps: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which pairs share a cap that comes before this one."""
    earlier = [c[c < bucket] for c in caps]
    members = np.repeat(np.arange(len(caps)), [len(c) for c in earlier])
    if not len(members):
        return np.zeros((len(caps),) * 2, bool)
    _, places = np.unique(np.concatenate(earlier), return_inverse=True)
    inside = np.zeros((len(caps), places.max() + 1), np.float32)
    inside[members, places] = 1
    return inside @ inside.T > 0


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each can reach."""
    roots, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        near = np.where(linked, roots[None, :], far).min(1)
        better = np.minimum(roots, near)
        if (better == roots).all():
            return roots
        roots = better


def near_vectors(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row with an id and the columns of the table.

    Vectors are compared with those of an equal label that is not null, of the same length. Equal vectors
    are one node with a number of copies, all linked with each other. A null, zero or
    unsound vector, and one without label, is linked with nothing. Rows with a null id come back with
    no links, a null component, and kept. Rows that share an id are different vectors of one
    component; each counts the other as a link if they are alike.
    """
    with Scratch(embeddings.sparkSession) as scratch:
        rows = embeddings.select(
            F.col("vec_id").cast("long"), "label", F.col("embedding").alias("vector")
        )
        sound = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
        keys = {f"key{i}": F.when(sound, F.xxhash64(F.lit(i), "label", "vector")) for i in (1, 2)}
        rows = scratch.keep(rows.withColumns(keys), "rows")
        known = rows.where("key1 IS NOT NULL")
        nodes = known.groupBy("key1", "key2").agg(
            F.min("vec_id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        nodes = scratch.keep(nodes, "nodes")
        words = settings.words(nodes.count())
        caps = listed_caps(nodes, words, settings).join(nodes.select("id", "label", "vector"), "id")
        bucket = F.xxhash64("label", F.size("vector"), "cap")
        entries = caps.select("id", "label", "vector", F.explode("caps").alias("cap")).select(
            "id", bucket.alias("bucket")
        )
        entries = scratch.keep(entries, "entries")
        sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = scratch.keep(sizes, "sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        shared = scratch.keep(entries.join(sizes.select("bucket"), "bucket", "left_semi"), "shared")
        lists = shared.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("caps"))
        members = scratch.keep(nodes.select("id", "copies", "vector").join(lists, "id"), "members")
        cells = in_cells(shared.join(members, "id"), sizes, total)
        found = scratch.keep(_links_in_cells(cells, settings), "found")
        reached = components(found.select("id", "root").where("id <> root"), scratch)

        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        linked = nodes.select("key1", "key2", "id", "copies").join(links, "id", "left").join(
            reached, "id", "left"
        )
        linked = linked.select(
            "key1",
            "key2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
        placed = rows.select("vec_id", "key1", "key2").join(linked, ["key1", "key2"], "left")
        component = F.coalesce("component", "vec_id")
        kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
        return settled(
            placed.select(
                "vec_id",
                F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"),
                kept.alias("kept"),
            )
        )


def sql(settings: Settings = Settings()) -> str:
    """The same in DuckDB's SQL, by a join of all pairs of a label."""
    return f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x for x in embedding if x <> 0]) > 0),
    p AS (
      SELECT a.vec_id AS a, b.vec_id AS b
      FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {settings.cosine}),
    r(id, reached) AS (
      SELECT vec_id, vec_id FROM embeddings
      UNION SELECT id, b FROM r JOIN p ON a = reached)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings
    JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = vec_id
    LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) l ON l.a = vec_id"""
