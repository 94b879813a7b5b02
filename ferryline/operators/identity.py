"""The source-to-destination id map and the counts of items that have no entry in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferryline.functions.ids import id_namespace
from ferryline.model import COUNTED_TYPES
from ferryline.operators.items import PLACEMENT, placements, with_placement


def resolve_ids(owned: DataFrame, dst_items: DataFrame) -> DataFrame:
    """Each owned item with its destination id; null where the item was not found.

    ``owned`` needs the columns of :func:`~ferryline.operators.items.with_destination`.
    Items that existed before count like new ones. A project's id is given and a scan
    keeps its own, so neither is looked up and only the remaining types are shuffled.
    """
    given = F.when(F.col("item_type") == "project", F.col("dst_project")).when(
        F.col("item_type") == "scan", F.col("id")
    )
    kept = [
        F.col("seq"),
        F.col("project").alias("src_project"),
        F.col("item_type"),
        id_namespace(F.col("item_type")).alias("map_type"),
        F.col("id").alias("source_id"),
        F.col("ordinal"),
    ]
    direct = owned.where(F.col("item_type").isin("project", "scan"))
    sought = owned.where(~F.col("item_type").isin("project", "scan"))
    found = with_placement(sought).join(
        placements(dst_items.where(~F.col("item_type").isin("project", "scan"))), PLACEMENT, "left"
    )
    return direct.select(*kept, given.alias("destination_id")).unionByName(
        found.select(*kept, F.col("destination_id").cast("string"))
    )


def dedupe_id_map(resolved: DataFrame) -> DataFrame:
    """One entry per project, namespace and source id: the one written last.

    An aggregate rather than a window, so that a key with many entries (a scan id that
    recurs in every session) is reduced before the shuffle.
    """
    last = F.max(F.struct("seq", "ordinal", "destination_id"))
    return (
        resolved.where(F.col("destination_id").isNotNull() & F.col("map_type").isNotNull())
        .groupBy("src_project", "map_type", "source_id")
        .agg(last.alias("last"))
        .select(
            "src_project",
            "map_type",
            "source_id",
            F.col("last.destination_id").alias("destination_id"),
            F.col("last.seq").alias("seq"),
        )
    )


def build_id_map(owned: DataFrame, dst_items: DataFrame) -> DataFrame:
    """The id map: unique on ``src_project``, ``map_type`` and ``source_id``."""
    return dedupe_id_map(resolve_ids(owned, dst_items))


def across_projects(id_map: DataFrame) -> DataFrame:
    """One destination id per namespace and source id: that of the earliest project."""
    first = F.min(F.struct("seq", "destination_id"))
    return (
        id_map.groupBy("map_type", "source_id")
        .agg(first.alias("first"))
        .select("map_type", "source_id", F.col("first.destination_id").alias("destination_id"))
    )


def resolve_across_projects(shares: DataFrame, id_map: DataFrame) -> DataFrame:
    """Add the destination id of ``item_type`` and ``source_id``, whichever project maps it."""
    typed = shares.withColumn("map_type", id_namespace(F.col("item_type")))
    found = typed.join(across_projects(id_map), ["map_type", "source_id"], "left")
    return found.drop("map_type")


def failure_counts(resolved: DataFrame, project_map: DataFrame) -> DataFrame:
    """Items not found after creation, for every project pair and counted type."""
    counted = (
        resolved.where(F.col("item_type").isin(*COUNTED_TYPES))
        .groupBy("src_project", "item_type")
        .agg(F.count_if(F.col("destination_id").isNull()).alias("failed"))
    )
    types = F.explode(F.array(*[F.lit(t) for t in COUNTED_TYPES])).alias("item_type")
    grid = project_map.select("seq", "src_project", types)
    joined = grid.join(counted, ["src_project", "item_type"], "left")
    return joined.select(
        "seq", "src_project", "item_type", F.coalesce("failed", F.lit(0)).alias("failed")
    )


def running_failures(failures: DataFrame) -> DataFrame:
    """Counts as they stand after each project, since they are never set back.

    A window over one row per project and type, of which there are only as many as pairs.
    """
    so_far = (
        Window.partitionBy("item_type")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return failures.withColumn("failed_so_far", F.sum("failed").over(so_far))


def subject_totals(items: DataFrame, project_map: DataFrame) -> DataFrame:
    """Subjects each visited project shows, owned or shared; not cumulative."""
    counts = (
        items.where(F.col("item_type") == "subject")
        .groupBy(F.col("project").alias("src_project"))
        .agg(F.count(F.lit(1)).alias("total_subjects"))
    )
    joined = project_map.select("seq", "src_project").join(counts, "src_project", "left")
    return joined.select(
        "seq", "src_project", F.coalesce("total_subjects", F.lit(0)).alias("total_subjects")
    )
