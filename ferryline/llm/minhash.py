"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of word shingles. Its sketch has ``size`` coordinates, filled in rounds: in
each round every shingle is thrown into one bin with a value that is larger than all of earlier
rounds, and a bin keeps its least. Rounds end when no bin is empty; the second ``size`` rounds throw
everything into one bin each, so that none can stay empty. Two sketches agree in a
coordinate with the probability of the sets' Jaccard similarity, nearly independently, and a set of n
shingles takes about ``n + size log size`` steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.llm.common import SPACE, Scratch, in_parts, settled
from ferryline.llm.linking import components, in_cells

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Throws that are made at once.
_AT_ONCE = 4096

#: Bytes of full sets that count as one member of a cell, at least.
WEIGHT = 8192


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def sketch(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinates (uint64) of a set of 64-bit hashes; no shingles give no coordinates.

    A coordinate holds its round above 40 random bits.
    """
    if not len(shingles):
        return np.empty(0, np.uint64)
    bins = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    at_once, first = max(1, _AT_ONCE // len(shingles)), 0
    while first < 2 * size:
        rounds = np.arange(first, min(first + at_once, 2 * size), dtype=np.uint64)
        thrown = mixed(shingles[None, :] ^ mixed((rounds + np.uint64(1)) * _ODD)[:, None])
        places = (thrown >> np.uint64(40)) % np.uint64(size)
        if rounds[-1] >= size:
            late = rounds >= size
            places[late] = (rounds[late] - np.uint64(size))[:, None]
        values = (thrown & np.uint64((1 << 40) - 1)) | (rounds << np.uint64(40))[:, None]
        np.minimum.at(bins, places.ravel().astype(np.int64), values.ravel())
        first += at_once
        if bins.max() != np.iinfo(np.uint64).max:
            break
    return bins


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts (bytes), A-Z lowered, and where each text ends."""
    listed: list[bytes] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        listed += (text.as_py() or b"").lower().split()
        ends[i + 1] = len(listed)
    coded = pa.array(listed, pa.binary()).dictionary_encode()
    distinct = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()),
        np.uint64,
        len(coded.dictionary),
    )
    return distinct[coded.indices.to_numpy(zero_copy_only=False)], ends


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a short text is one shingle."""
    hashes, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = mixed(rolled * _ODD + hashes[k : k + len(rolled)])
        sets = []
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            if end - start >= width:
                sets.append(np.unique(rolled[start : end - width + 1]))
                continue
            short = np.zeros(1 if end > start else 0, np.uint64)
            for word in hashes[start:end]:
                short = mixed(short * _ODD + word)
            sets.append(short)
    return sets


@dataclass(frozen=True)
class Settings:
    """``similar`` : least Jaccard similarity of a link, in percent.

    ``bands`` of ``rows`` coordinates each find a pair of similarity s with the probability
    ``1 - (1 - s ** rows) ** bands``: but for one in 10 ** 9 at 85 percent.
    ``margin`` : standard deviations of a sketch below the threshold at which a pair of
    a bucket is still confirmed on the full sets.
    """

    width: int = 5
    similar: int = 85
    bands: int = 64
    rows: int = 8
    margin: float = 6.0

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        s = self.similar / 100
        return s - self.margin * math.sqrt(s * (1 - s) / self.size)


_SKETCHED = "doc_id long, n_shingles long, node long, sketch binary"


def sketches(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, n_shingles, node`` (a hash of the set, null if it is empty) and ``sketch``.

    A sketch holds 16 bits of each coordinate; null for an empty set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            ids, texts = batch.columns
            counts, nodes, made = [], [], []
            for shingles in shingle_sets(texts, settings.width):
                counts.append(len(shingles))
                if not len(shingles):
                    nodes.append(None)
                    made.append(None)
                    continue
                nodes.append(node_of(shingles))
                made.append(sketch(shingles, settings.size).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(made, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sketch"],
            )

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return narrow.mapInArrow(run, _SKETCHED)


def buckets(sketched: DataFrame, settings: Settings) -> DataFrame:
    """``id, band, bucket``: one row for each band of each sketch."""
    width = 2 * settings.rows
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(settings.bands - 1)),
        lambda band: F.xxhash64(band, F.substring("sketch", band * width + 1, F.lit(width))),
    )
    return sketched.select("id", F.posexplode(keys).alias("band", "bucket"))


def node_of(shingles: np.ndarray) -> int:
    """What a set goes by: sets with the same number are one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def full_sets(nodes: DataFrame, documents: DataFrame, firsts: DataFrame, settings: Settings) -> DataFrame:
    """``id, shingles`` of the sets in ``nodes``, made anew from the text of the ``first`` document of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            made = [s for s in shingle_sets(batch.column(1), settings.width) if len(s)]
            found = pa.array([node_of(s) for s in made], pa.int64())
            yield pa.RecordBatch.from_arrays([found, pa.array([s.tobytes() for s in made], pa.binary())], names=["id", "shingles"])

    narrow = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    chosen = nodes.join(firsts, "node").select(F.col("first").alias("doc_id")).distinct()
    found = narrow.join(chosen, "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary")
    # An id may have further texts, of sets that no one asked for here.
    return found.groupBy("id").agg(F.max("shingles").alias("shingles"))


def confirmed(
    pairs: DataFrame, documents: DataFrame, firsts: DataFrame, settings: Settings, scratch: Scratch
) -> DataFrame:
    """The pairs ``a, b`` of sets that are similar enough, held against each other in full.

    Full sets are joined to both sides; no side of a pair is gathered by document.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.keep(wanted, "wanted")
    found = scratch.keep(full_sets(wanted, documents, firsts, settings), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            kept = []
            for x, y in zip(left, right, strict=True):
                one, other = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(one, other, assume_unique=True))
                kept.append(100 * both >= settings.similar * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sided = pairs.join(found.withColumnsRenamed({"id": "a", "shingles": "left"}), "a").join(
        found.withColumnsRenamed({"id": "b", "shingles": "right"}), "b"
    )
    links = sided.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")
    links = scratch.keep(links, "links")
    for part in ("wanted", "sets"):
        scratch.drop(part)
    return links


#: What a member of an open bucket goes by from step to step.
_MEMBER = ["bucket", "band", "id", "component"]


def _buckets_of(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each bucket of a cell, or of two halves of one, without the keys of the cell."""
    order = np.lexsort([table[c].to_numpy() for c in ("right", "left", "bucket")])
    table = table.take(pa.array(order))
    keys = np.stack([table[c].to_numpy() for c in ("bucket", "left", "right")])
    starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
    for start, end in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        part = table.slice(start, end - start).combine_chunks()
        taken = {c: part[c].to_numpy() for c in ("id", "band", "bucket", "half", "component")}
        taken["apart"] = part["left"].to_numpy() != part["right"].to_numpy()
        taken["sketch"] = np.stack([np.frombuffer(s.as_buffer(), "<u2") for s in part["sketch"]])
        if "shingles" in part.column_names:
            made = np.empty(len(part), object)
            made[:] = [np.frombuffer(s.as_buffer(), np.uint64) for s in part["shingles"]]
            taken["shingles"] = made
        yield taken


def _near(taken: dict[str, np.ndarray], i: int, settings: Settings) -> np.ndarray:
    """The later members of other components whose sketches agree with that of ``i`` well enough.

    Only in the first of all bands that the two sketches share, so that a pair is met once.
    """
    component, half = taken["component"], taken["half"]
    others = np.arange(i + 1, len(component))
    others = others[component[others] != component[i]]
    if taken["apart"][i]:
        others = others[half[others] != half[i]]
    if not len(others):
        return others
    agree = taken["sketch"][others] == taken["sketch"][i]
    close = np.count_nonzero(agree, axis=1) >= settings.least_agreement * settings.size
    others, agree = others[close], agree[close]
    if not len(others):
        return others
    shared = agree.reshape(len(others), -1, settings.rows).all(2)
    return others[shared.argmax(1) == taken["band"][i]]


def _with_near_ones(cells: DataFrame, settings: Settings) -> DataFrame:
    """The members of cells that come near the threshold with one of another component."""

    def run(table: pa.Table) -> pa.Table:
        found: dict[str, list[np.ndarray]] = {c: [np.empty(0, np.int64)] for c in _MEMBER}
        for taken in _buckets_of(table):
            near = np.zeros(len(taken["id"]), bool)
            for i in range(len(near) - 1):
                others = _near(taken, i, settings)
                near[others] = True
                near[i] |= len(others) > 0
            for c in _MEMBER:
                found[c].append(taken[c][near])
        return pa.table({c: pa.array(np.concatenate(found[c]), pa.int64()) for c in _MEMBER})

    return cells.groupBy("task").applyInArrow(run, ", ".join(f"{c} long" for c in _MEMBER)).distinct()


def _links_in_cells(cells: DataFrame, settings: Settings) -> DataFrame:
    """Links ``a, b`` that join all components of a cell that a link joins, by the full sets.

    What is joined already is not compared again, so a cell gives fewer links than it has members.
    """

    def run(table: pa.Table) -> pa.Table:
        first, second = [], []
        for taken in _buckets_of(table):
            ids, sets = taken["id"], taken["shingles"]
            component = taken["component"] = taken["component"].copy()
            values, codes = np.unique(np.concatenate(sets), return_inverse=True)
            lengths = np.array([len(s) for s in sets])
            ends = np.cumsum(lengths)
            sets = [codes[end - n : end] for n, end in zip(lengths, ends, strict=True)]
            mine = np.zeros(len(values), np.int64)
            for i in range(len(ids) - 1):
                others = _near(taken, i, settings)
                if not len(others):
                    continue
                mine[sets[i]] = 1
                starts = np.cumsum(np.r_[0, lengths[others][:-1]])
                both = np.add.reduceat(mine[np.concatenate([sets[j] for j in others])], starts)
                mine[sets[i]] = 0
                linked = others[100 * both >= settings.similar * (lengths[i] + lengths[others] - both)]
                joined, which = np.unique(component[linked], return_index=True)
                first += [ids[i]] * len(joined)
                second += ids[linked[which]].tolist()
                component[np.isin(component, joined)] = component[i]
        return pa.table({"a": pa.array(first, pa.int64()), "b": pa.array(second, pa.int64())})

    return cells.groupBy("task").applyInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``documents``.

    Documents with the same set are one node, and a node goes by its set's 64-bit hash through all steps. The middle of a
    bucket of a band is the member that shares most buckets with others. Each node is first held against the
    middle that it meets most often, and what is confirmed is joined to components. Only buckets that still hold several
    components are looked into pair by pair, in cells of a bounded size: by sketches for the members that come
    near the threshold with one of another component, then among these on the full sets. Pairs are compared where they
    lie and never become rows; a cell gives the links that join its components. No pair is left out
    but those that no band finds or whose sketch is far off, both of a chance near 10 ** -9.

    Texts that are null or have no words have no shingles and are linked with nothing. Rows that
    share an id count as one document, linked by any of its texts. A null id is its own document:
    its component is null and it is kept. Other columns are not looked at.
    """
    with Scratch(documents.sparkSession) as scratch:
        sketched = scratch.keep(sketches(documents, settings), "sketched")
        known = sketched.where("node IS NOT NULL AND doc_id IS NOT NULL")
        firsts = known.groupBy("node").agg(F.min("doc_id").alias("first"))
        firsts = scratch.keep(firsts, "firsts")
        nodes = known.select("node", "doc_id", "sketch").join(
            firsts.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"], "left_semi"
        )
        nodes = scratch.keep(nodes.select(F.col("node").alias("id"), "sketch"), "nodes")
        places = scratch.keep(sketched.select("doc_id", "n_shingles", "node"), "places")
        scratch.drop("sketched")

        entries = buckets(nodes, settings)
        sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = scratch.keep(entries.join(sizes, "bucket"), "shared")

        degrees = shared.groupBy("id").agg(F.sum("size").alias("degree"))
        ranked = shared.join(degrees, "id")
        middles = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "id")).alias("middle"))
        stars = shared.join(middles, "bucket").select(F.col("id").alias("a"), "middle").where("a <> middle.id")
        stars = stars.groupBy("a", "middle").agg(F.count(F.lit(1)).alias("shared"))
        stars = stars.groupBy("a").agg(F.max(F.struct("shared", "middle")).alias("best"))
        stars = stars.select("a", F.col("best.middle.id").alias("b"))
        links = confirmed(scratch.keep(stars, "stars"), documents, firsts, settings, scratch)
        joined = scratch.keep(components(links, scratch, "first-round"), "joined")

        labelled = shared.drop("size").join(joined, "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        labelled = scratch.keep(labelled, "labelled")
        several = labelled.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("size"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        several = scratch.keep(several.where("low < high").select("bucket", "size"), "several")
        total = several.agg(F.sum("size")).first()[0] or 0
        open_entries = labelled.join(several.select("bucket"), "bucket", "left_semi").join(nodes, "id")
        near = scratch.keep(_with_near_ones(in_cells(open_entries, several, total), settings), "near")
        wanted = scratch.keep(near.select(F.col("id").alias("node")).distinct(), "near-wanted")
        sets = scratch.keep(full_sets(wanted, documents, firsts, settings), "near-sets")
        members = near.join(sets, "id").join(nodes, "id")
        # Cells of long sets have fewer members.
        weight = F.ceil(F.sum(F.length("shingles")) / WEIGHT)
        sizes = near.join(sets, "id").groupBy("bucket").agg(
            F.greatest(F.count(F.lit(1)), weight).cast("long").alias("size")
        )
        sizes = scratch.keep(sizes, "near-sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        more = scratch.keep(_links_in_cells(in_cells(members, sizes, total), settings), "more")

        # Sets of one id are one document's.
        texts = places.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.min("node").alias("b"), F.max("node").alias("high")
        )
        texts = places.join(texts.where("b < high").select("doc_id", "b"), "doc_id").where("node <> b")
        links = links.unionByName(more).unionByName(texts.select(F.col("node").alias("a"), "b"))
        found = components(links, scratch, "second-round").withColumnRenamed("id", "node")
        linked = scratch.keep(firsts.join(found, "node"), "linked")
        least = linked.groupBy("component").agg(F.min("first").alias("least"))
        linked = linked.join(least, "component").select("node", "least")
        placed = places.join(firsts, "node", "left").join(linked, "node", "left").withColumn(
            "component_id", F.coalesce("least", "first", "doc_id")
        )
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
        component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        placed = placed.withColumn("kept", kept | F.col("doc_id").isNull()).withColumn("component_id", component)
        return settled(placed.select("doc_id", "n_shingles", "component_id", "kept"))


def sql(settings: Settings = Settings()) -> str:
    """The same in DuckDB's SQL, by a join of the hashes of all shingles that are there twice."""
    k = settings.width
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, [x for x in string_split_regex({lower}, '[{SPACE}]+') if x <> ''] AS w
      FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [hash(array_to_string(w, ' '))]
        ELSE list_distinct([hash(array_to_string(w[i:i + {k - 1}], ' '))
                            for i in range(1, len(w) - {k - 2})])
        END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    m AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
    f AS (SELECT e.* FROM e SEMI JOIN m USING (g)),
    p AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL
      HAVING 100 * count(*) >= {settings.similar} * (any_value(a.n) + any_value(b.n) - count(*))),
    r(id, reached) AS (
      SELECT doc_id, doc_id FROM documents
      UNION SELECT id, b FROM r JOIN p ON a = reached)
    SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
    FROM s JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id"""
