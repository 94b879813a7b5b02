"""Which items a project owns, and which of them the destination lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.functions.xmlio import root_attribute
from ferryline.operators.checks import violation

#: Where an item sits: scans go by id, everything else by label.
PLACEMENT = ["dst_project", "item_type", "place_subject", "place_experiment", "place_name"]


def with_owner(items: DataFrame) -> DataFrame:
    """Fill ``owner_project`` from the root of the document where the listing has none.

    Reads the root's attributes without parsing the document, of those items alone.
    """
    if "element" in items.columns:
        named = F.try_element_at(F.col("element.attrs"), F.lit("project"))
    elif "xml" in items.columns:
        named = root_attribute(F.col("xml"), "project")
    else:
        return items
    return items.withColumn("owner_project", F.coalesce("owner_project", named))


def owner_violations(items: DataFrame, project_map: DataFrame) -> DataFrame:
    """Items of visited projects that name no owner, in the listing or in the document."""
    named = ~F.col("item_type").isin("project", "scan")
    unknown = items.where(named & F.col("owner_project").isNull())
    visited = project_map.select(F.col("src_project").alias("project"))
    return violation(
        unknown.join(visited, "project", "left_semi"),
        "owner_unknown",
        project=F.col("project"),
        item_type=F.col("item_type"),
        item_id=F.col("id"),
    )


def split_owned(items: DataFrame) -> DataFrame:
    """Add ``is_owner``: whether the project an item is visited in is the one it names.

    Projects own themselves. For scans see :func:`owned_scans`; for items that name no
    project, which are neither owned nor shared, see :func:`owner_violations`.
    """
    named = F.coalesce(F.col("owner_project") == F.col("project"), F.lit(False))
    return items.withColumn("is_owner", (F.col("item_type") == "project") | named)


def owned_scans(scans: DataFrame, experiments: DataFrame) -> DataFrame:
    """Scans of experiments the visited project owns; a scan's own owner does not count."""
    owned = (
        split_owned(experiments)
        .where("is_owner")
        .select("project", F.col("id").alias("experiment_id"))
        .distinct()
    )
    return scans.join(owned, ["project", "experiment_id"], "left_semi")


def owned_items(items: DataFrame) -> DataFrame:
    """All items that are to be created from the project they are visited in."""
    others = split_owned(items.where(F.col("item_type") != "scan")).where("is_owner")
    scans = owned_scans(
        items.where(F.col("item_type") == "scan"), items.where(F.col("item_type") == "experiment")
    )
    return others.drop("is_owner").unionByName(scans)


def may_be_owned(items: DataFrame, project_map: DataFrame) -> DataFrame:
    """Items of visited projects that a look at the row alone does not rule out; of scans all.

    For keeping documents from being read that no one asks for: nothing moves.
    """
    visited = project_map.select(F.col("src_project").alias("project"))
    rows = split_owned(items).where(F.col("is_owner") | (F.col("item_type") == "scan")).drop("is_owner")
    return rows.join(visited, "project", "left_semi")


def with_destination(items: DataFrame, project_map: DataFrame, project: str = "project") -> DataFrame:
    """Add the paired destination project's columns; other projects are not visited."""
    return items.join(project_map.withColumnRenamed("src_project", project), project)


def with_placement(items: DataFrame) -> DataFrame:
    """Add the columns of :data:`PLACEMENT`; needs ``dst_project``."""
    kind = F.col("item_type")
    inside = kind.isin("experiment", "scan", "assessor")
    below = kind.isin("scan", "assessor")
    name = F.when(kind == "project", "").when(kind == "scan", F.col("id"))
    return items.withColumns(
        {
            "place_subject": F.when(inside, F.col("subject_label")).otherwise(""),
            "place_experiment": F.when(below, F.col("experiment_label")).otherwise(""),
            "place_name": name.otherwise(F.col("label")),
        }
    )


def placements(dst_items: DataFrame) -> DataFrame:
    """Placement and id of everything the destination holds."""
    placed = with_placement(dst_items.withColumnRenamed("project", "dst_project"))
    return placed.select(*PLACEMENT, F.col("id").alias("destination_id"))


def with_presence(items: DataFrame, dst_items: DataFrame) -> DataFrame:
    """Add ``is_missing``: whether the item is absent from its place at the destination."""
    held = placements(dst_items).drop("destination_id").distinct()
    found = with_placement(items).join(held.withColumn("_held", F.lit(True)), PLACEMENT, "left")
    rows = found.withColumn("is_missing", F.col("_held").isNull())
    return rows.drop("_held", *[c for c in PLACEMENT if c.startswith("place_")])


def missing_items(items: DataFrame, dst_items: DataFrame) -> DataFrame:
    """Items that are absent from their place at the destination.

    One anti join serves every type, since the type is part of the place. Items need the
    columns of :func:`with_destination`. An item without a label is always absent.
    """
    held = placements(dst_items).drop("destination_id")
    rows = with_placement(items).join(held, PLACEMENT, "left_anti")
    return rows.drop(*[c for c in PLACEMENT if c.startswith("place_")])
