"""What the operators share: the words of a text, and tables kept for the length of a job."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class; nothing beyond ASCII counts.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; none for a null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_aside(rows: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """Rows with all columns but the used ones under names that nothing else has.

    Also what selects the columns again as they were, whatever an operator added meanwhile.
    """
    names = {c: f"_aside_{i}" for i, c in enumerate(rows.columns) if c not in used}
    again = [F.col(names.get(c, c)).alias(c) for c in rows.columns]
    return rows.withColumnsRenamed(names), again


def in_parts(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column, so that tasks hold few words at once.

    The column is binary, or a list of 32-bit numbers.
    """
    values = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.list_value_length(values), 4)
    else:
        sizes = pc.binary_length(values)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: Rows up to which a side of narrow rows is broadcast: some ten megabytes at most.
FEW = 200_000


def broadcast_if_few(rows: DataFrame) -> DataFrame:
    """For narrow rows that are settled or kept: broadcast if they are few, counted first."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def share(spark: SparkSession, value: Any) -> Broadcast:
    """A value of a bounded size for all tasks, see :func:`opened`.

    With the classes it is made of, so that executors need not have the package.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> Any:
    """What :func:`share` was given."""
    return pickle.loads(shared.value)


class Scratch:
    """Tables in the shared folder that ``spark.checkpoint.dir`` names, gone after ``with``.

    A table that is written here cuts the lineage: whatever executors are lost later, it is
    read again. What leaves the block must be made by :func:`settled` or hold no scratch table.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        self.folder = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.folder)

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Write rows, and go on from what was written."""
        path = f"{self.folder}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that is not needed any more."""
        self._delete(f"{self.folder}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def _own_folder(spark: SparkSession) -> str:
    """For a session on one machine without a shared folder, as in tests."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(rows: DataFrame) -> DataFrame:
    """Rows as a checkpoint. Spark removes it once nothing refers to it, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, as those of :mod:`ferryline.session` do."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        )
    return rows.checkpoint()
