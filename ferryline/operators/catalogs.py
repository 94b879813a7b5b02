"""What a refresh of the destination's catalogues has to visit and to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.functions.paths import refresh_path, viewer_path

_DEPTHS = {"project": 0, "subject": 1, "experiment": 2, "scan": 3, "assessor": 3}


def _rank(column: Column, values: dict[str, int]) -> Column:
    out = None
    for name, rank in values.items():
        out = F.when(column == name, rank) if out is None else out.when(column == name, rank)
    return out


def refresh_paths(dst_items: DataFrame) -> DataFrame:
    """Every catalogue to refresh, and every experiment's viewer session, in one pass.

    Parents come after what they hold: within a project sort by ``depth`` descending, or
    by ``subject_label``, ``experiment_label`` and ``step`` with nulls last to follow one
    branch after another. ``step`` runs scans, assessors, experiment, viewer, subject,
    project.
    """
    kind = F.col("item_type")
    is_experiment = kind == "experiment"
    actions = F.when(is_experiment, F.array(F.lit("refresh"), F.lit("viewer"))).otherwise(
        F.array(F.lit("refresh"))
    )
    rows = dst_items.where(kind.isin(*_DEPTHS)).withColumn("action", F.explode(actions))
    path = F.when(F.col("action") == "viewer", viewer_path(F.col("project"), F.col("id"))).otherwise(
        refresh_path(
            kind,
            F.col("project"),
            F.col("subject_label"),
            F.col("experiment_label"),
            F.col("id"),
            F.col("label"),
        )
    )
    step = F.when(F.col("action") == "viewer", 3).otherwise(
        _rank(kind, {"scan": 0, "assessor": 1, "experiment": 2, "subject": 4, "project": 5})
    )
    own_subject = F.when(kind == "subject", F.col("label")).otherwise(F.col("subject_label"))
    own_experiment = F.when(is_experiment, F.col("label")).otherwise(F.col("experiment_label"))
    return rows.select(
        "project",
        own_subject.alias("subject_label"),
        own_experiment.alias("experiment_label"),
        _rank(kind, _DEPTHS).alias("depth"),
        step.alias("step"),
        "action",
        path.alias("path"),
    )


def catalog_stats(files: DataFrame) -> DataFrame:
    """Files and bytes of every project, subject, experiment and leaf (scan or assessor).

    ``level`` tells which columns a row is for. Files are summed up to leaves first, so
    that the further levels are made from few rows.
    """
    levels = ["project", "subject", "experiment", "leaf"]
    leaves = files.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")
    )
    sets = [[F.col(c) for c in levels[: i + 1]] for i in range(len(levels))]
    grouped = leaves.groupingSets(sets, *[F.col(c) for c in levels]).agg(
        F.grouping_id().alias("grouping"), F.sum("n").alias("files"), F.sum("size").alias("bytes")
    )
    level = (
        F.when(F.col("grouping") == 7, "project")
        .when(F.col("grouping") == 3, "subject")
        .when(F.col("grouping") == 1, "experiment")
        .otherwise("leaf")
    )
    return grouped.select(level.alias("level"), *levels, "files", "bytes")


def catalog_reconcile(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """What a refresh does to each entry: append, delete, rechecksum or keep.

    Both tables have ``project``, ``rel_path`` and ``checksum``. Stacking and grouping
    them gives the rows of a full outer join with one shuffle that is reduced beforehand,
    and repeated entries collapse instead of multiplying.
    """
    listed = catalog.select("project", "rel_path", F.col("checksum").alias("old"), F.lit(True).alias("listed"))
    found = files.select("project", "rel_path", F.col("checksum").alias("new"), F.lit(True).alias("found"))
    both = listed.unionByName(found, allowMissingColumns=True)
    entries = both.groupBy("project", "rel_path").agg(
        F.max("listed").alias("listed"),
        F.max("found").alias("found"),
        F.max("old").alias("old_checksum"),
        F.max("new").alias("new_checksum"),
    )
    action = (
        F.when(F.col("listed").isNull(), "append")
        .when(F.col("found").isNull(), "delete")
        .when(~F.col("old_checksum").eqNullSafe(F.col("new_checksum")), "rechecksum")
        .otherwise("keep")
    )
    return entries.select("project", "rel_path", action.alias("action"), "old_checksum", "new_checksum")
