"""Byte-level BPE over whole texts, by given ranks.

The bytes of a piece are merged pair by pair, always the pair of lowest rank and of equal ones
the leftmost. A segment tree over the byte positions, with sixteen children to a node, holds that
pair at its root: each leaf is the rank of the pair that starts there, each merge changes three
leaves and what is above them, so a piece of n bytes takes O(n log n), also where a text is one
unbroken run.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.llm.common import in_parts, set_aside

#: Pieces whose ids a worker remembers, twice so many at most, and the longest of them: this costs
#: memory and saves time, and never changes the result.
REMEMBERED, LONGEST = 200_000, 64

#: Characters from which a text is split one match at a time, and ids that are decoded at once.
LONG_TEXT, SLICE = 1_000_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base 64 and a number on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in filter(None, pairs)}


#: More than any rank and place in one number.
_NEVER = 1 << 62

#: Children of a node of the tree, as a power of two: ``min`` looks at so many at once.
_FAN = 4


def _refresh(tree: list[list[int]], place: int) -> None:
    """Bring the nodes above a leaf up to date."""
    for level in range(1, len(tree)):
        place >>= _FAN
        value = min(tree[level - 1][place << _FAN : (place + 1) << _FAN])
        if tree[level][place] == value:
            return
        tree[level][place] = value


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece. ``longest`` is the length of the longest token."""
    if piece in ranks:
        return [ranks[piece]]
    size, get = len(piece), ranks.get
    # A leaf holds rank and place in one number, so that the least is also the leftmost.
    leaves = [_NEVER] * size
    for start in range(size - 1):
        rank = get(piece[start : start + 2])
        if rank is not None:
            leaves[start] = rank * size + start
    tree = [leaves]
    while len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([min(below[i : i + (1 << _FAN)]) for i in range(0, len(below), 1 << _FAN)])
    ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
    top, deep = tree[-1], len(tree) > 2
    while top[0] != _NEVER:
        start = top[0] % size
        gone = ends[start]
        end = ends[start] = ends[gone]
        leaves[gone] = leaves[start] = _NEVER
        if end < size:
            before[end] = start
            if ends[end] - start <= longest:
                rank = get(piece[start : ends[end]])
                if rank is not None:
                    leaves[start] = rank * size + start
        last = before[start]
        if last >= 0:
            rank = get(piece[last:end]) if end - last <= longest else None
            leaves[last] = _NEVER if rank is None else rank * size + last
        if not deep:
            top[0] = min(leaves)
            continue
        _refresh(tree, start)
        if gone >> _FAN != start >> _FAN:
            _refresh(tree, gone)
        if last >= 0 and last >> _FAN != start >> _FAN:
            _refresh(tree, last)
    ids, start = [], 0
    while start < size:
        ids.append(ranks[piece[start : ends[start]]])
        start = ends[start]
    return ids


def encoder(
    ranks: dict[bytes, int], pattern: str, met: dict[str, dict[str, bytes]]
) -> Callable[[str, bytearray], None]:
    """A function that adds the ids of a text, as 32-bit numbers, to an array of bytes.

    Each match of the pattern is encoded by itself. ``met`` holds the ids of pieces that were
    met lately, ``young`` and ``old`` ones.
    """
    longest, split = max(map(len, ranks)), regex.compile(pattern)

    def encode(text: str, ids: bytearray) -> None:
        if len(text) < LONG_TEXT:
            pieces = split.findall(text)
        else:
            pieces = (match[0] for match in split.finditer(text))
        known = met["young"].get
        for piece in pieces:
            found = known(piece)
            if found is None:
                found = met["old"].get(piece)
                if found is None:
                    found = array("i", merge(piece.encode("utf-8"), ranks, longest)).tobytes()
                if len(piece) <= LONGEST:
                    if len(met["young"]) >= REMEMBERED:
                        met["old"], met["young"] = met["young"], {}
                        known = met["young"].get
                    met["young"][piece] = found
            ids += found

    return encode


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary on all executors: its size is that of the file, whatever the data."""
    return share_vocabulary(spark, read_ranks(path))


def share_vocabulary(spark: SparkSession, ranks: dict[bytes, int]) -> Broadcast:
    """Ranks in the form that :func:`encode` and :func:`decode` take.

    A Python worker keeps what was broadcast from task to task, and so the pieces it has met.
    """
    return spark.sparkContext.broadcast((ranks, {"young": {}, "old": {}}))


def _map(
    rows: DataFrame, given: Column, name: str, kind: T.DataType, make: Callable[[], Callable]
) -> DataFrame:
    """Add ``name``, made of ``given`` by a function that each task makes for itself."""
    rows, columns = set_aside(rows.drop(name).withColumn(name, given), (name,))
    rest = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = make()
        for batch in (part for whole in batches for part in in_parts(whole, name)):
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            made = convert(batch.column(batch.schema.get_field_index(name)))
            yield pa.RecordBatch.from_arrays([*kept, made], names=[*rest, name])

    schema = T.StructType([*[rows.schema[c] for c in rest], T.StructField(name, kind)])
    return rows.mapInArrow(run, schema).select(*columns)


def encode(
    rows: DataFrame, ranks: Broadcast, pattern: str, *, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Add ``ids``, an array of ints; null and empty texts have none.

    ``ranks`` comes from :func:`share_ranks`. Special tokens are ordinary text. A column
    named like ``ids`` is replaced. Nothing moves between tasks: a text is encoded where it is read.
    """
    given = F.coalesce(F.col(text), F.lit("")).cast("binary")

    def make() -> Callable[[pa.Array], pa.Array]:
        convert = encoder(ranks.value[0], pattern, ranks.value[1])

        def column(texts: pa.Array) -> pa.Array:
            found, ends = bytearray(), [0]
            for data in texts:
                convert(data.as_py().decode("utf-8", "replace"), found)
                ends.append(len(found) // 4)
            values = pa.array(np.frombuffer(found, dtype=np.int32))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        return column

    return _map(rows, given, ids, T.ArrayType(T.IntegerType()), make)


def decode(
    rows: DataFrame, ranks: Broadcast, *, ids: str = "ids", data: str = "decoded"
) -> DataFrame:
    """Add ``data``, the bytes the ids stand for; null ids have none. Unknown ids are errors."""
    given = F.coalesce(F.col(ids), F.array().cast("array<int>"))

    def make() -> Callable[[pa.Array], pa.Array]:
        tokens = {rank: token for token, rank in ranks.value[0].items()}

        def column(lists: pa.Array) -> pa.Array:
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            made = []
            for start, end in zip(ends[:-1], ends[1:], strict=True):
                made.append(b"".join(map(tokens.__getitem__, flat[start:end].tolist())))
            return pa.array(made, pa.binary())

        return column

    return _map(rows, given, data, T.BinaryType(), make)


def digests(documents: DataFrame, ranks: Broadcast, pattern: str) -> DataFrame:
    """One row for each document: its number of ids, and digests of the ids and of the bytes they stand for.

    Encoding and decoding take turns in one pass, so that a core has one Python process and ids stay in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = encoder(ranks.value[0], pattern, ranks.value[1])
        tokens = {rank: token for token, rank in ranks.value[0].items()}
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            counts, of_ids, of_bytes = [], [], []
            for data in batch.column(1):
                found = bytearray()
                convert(data.as_py().decode("utf-8", "replace"), found)
                ids = np.frombuffer(found, dtype=np.int32)
                counts.append(len(ids))
                listed, decoded = hashlib.sha256(), hashlib.sha256()
                for start in range(0, len(ids), SLICE):
                    part = ids[start : start + SLICE].tolist()
                    listed.update(("," if start else "").encode() + ",".join(map(str, part)).encode())
                    decoded.update(b"".join(map(tokens.__getitem__, part)))
                of_ids.append(listed.hexdigest())
                of_bytes.append(decoded.hexdigest())
            columns = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    narrow = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = T.StructType([documents.schema["doc_id"], *[T.StructField(*kind) for kind in kinds]])
    return narrow.mapInArrow(run, schema)
