"""Writing runs of a table so that readers see whole ones only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.session import without_shuffles

_MANIFEST = "current.json"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _facts(rows: DataFrame) -> dict[str, int]:
    """Number of rows, and a digest that does not depend on their order."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
    digest = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")), F.lit(0)).cast("string")
    found = rows.agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest")).first()
    return {"rows": found["rows"], "digest": found["digest"]}


def _read(spark: SparkSession, run: str, fmt: str, schema: str) -> DataFrame:
    return spark.read.format(fmt).option("header", "true").schema(schema).load(run)


def _schema(rows: DataFrame, fmt: str) -> str:
    """As it is read back: text files hold strings."""
    fields = rows.schema.fields
    return ", ".join(f"`{f.name}` {'STRING' if fmt == 'csv' else f.dataType.simpleString()}" for f in fields)


def publish(
    rows: DataFrame, write: Callable[[DataFrame, str], None], path: str, *, fmt: str = "parquet", keep: int = 1
) -> dict:
    """Write a run of ``rows`` below ``path`` by one of :mod:`~ferryline.plans.sinks`, then make it the current one.

    The run goes to a folder of its own, is read back, and only then named in the manifest with its row count and digest, by
    one rename. A write that breaks leaves the former run current; so does one whose files do not hold what was to be
    written. ``keep`` former runs stay, older ones and leftovers of broken writes are removed after the switch. Runs jobs.
    """
    spark = rows.sparkSession
    name = f"run-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        write(rows, f"{path}/{name}")
    # What the sink keeps of the rows, in the types it keeps them; no files, no columns to tell.
    system, place = _files(spark, f"{path}/{name}")
    kept = rows.columns
    if system.getContentSummary(place).getLength() > 0:
        kept = spark.read.format(fmt).option("header", "true").load(f"{path}/{name}").columns
    schema = _schema(rows.select(*[c for c in rows.columns if c in kept]), fmt)
    back = _read(spark, f"{path}/{name}", fmt, schema)
    facts = {"run": name, "format": fmt, "schema": schema, **_facts(back)}
    before = _manifest(spark, path)
    facts["former"] = [before["run"], *before["former"]][:keep] if before else []
    system, place = _files(spark, f"{path}/{_MANIFEST}")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{name}.json")
    stream = system.create(fresh, True)
    stream.write(bytearray(json.dumps(facts).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(system.makeQualified(fresh), system.makeQualified(place), overwrite)
    for status in system.listStatus(place.getParent()):
        found = status.getPath().getName()
        if found.startswith("run-") and found not in (name, *facts["former"]):
            system.delete(status.getPath(), True)
    return facts


def _manifest(spark: SparkSession, path: str) -> dict | None:
    system, place = _files(spark, f"{path}/{_MANIFEST}")
    if not system.exists(place):
        return None
    stream = system.open(place)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return json.loads(text)


def read_published(spark: SparkSession, path: str, *, check: bool = False) -> DataFrame:
    """The current run of a published table; ``check`` counts and digests it again first."""
    facts = _manifest(spark, path)
    if facts is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    rows = _read(spark, f"{path}/{facts['run']}", facts["format"], facts["schema"])
    if check and _facts(rows) != {k: facts[k] for k in ("rows", "digest")}:
        raise ValueError(f"the files of {facts['run']} are not those that were published")
    return rows
