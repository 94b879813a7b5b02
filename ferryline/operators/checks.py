"""Checks made before anything is planned, and the frame violations come in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.functions.ids import id_namespace, is_user_datatype
from ferryline.model import VIOLATION


def violation(
    rows: DataFrame,
    check: str,
    *,
    project: Column | None = None,
    item_type: Column | None = None,
    item_id: Column | None = None,
    detail: Column | None = None,
) -> DataFrame:
    """One violation per row, with null for what the check does not concern."""
    values = {
        "check": F.lit(check),
        "project": project,
        "item_type": item_type,
        "item_id": item_id,
        "detail": detail,
    }
    return rows.select(
        *[
            (F.lit(None) if values[f.name] is None else values[f.name])
            .cast("string")
            .alias(f.name)
            for f in VIOLATION
        ]
    )


def all_violations(*frames: DataFrame) -> DataFrame:
    """Violations of several checks together."""
    return reduce(DataFrame.unionByName, frames)


def require_none(violations: DataFrame) -> None:
    """Strict mode: raise at the first violation found. Runs a job."""
    found = violations.head(1)
    if found:
        row = found[0]
        raise ValueError(
            f"{row['check']}: {row['item_type']} {row['item_id']} in {row['project']}: "
            f"{row['detail']}"
        )


def user_datatypes(datatypes: DataFrame) -> DataFrame:
    """Distinct datatype names without the server's internal ones."""
    return datatypes.where(is_user_datatype(F.col("element_name"))).select("element_name").distinct()


def missing_datatypes(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Datatypes the source can create and the destination cannot; none means success."""
    # Both sides are distinct before they meet, so no name is hot in the join.
    return user_datatypes(source).join(user_datatypes(destination), "element_name", "left_anti")


def check_datatypes(source: DataFrame, destination: DataFrame) -> DataFrame:
    """One row: whether all source datatypes are enabled, and the sorted missing ones."""
    missing = missing_datatypes(source, destination).agg(
        F.array_sort(F.collect_set("element_name")).alias("missing")
    )
    return missing.select((F.size("missing") == 0).alias("ok"), "missing")


def unsupported_experiments(experiments: DataFrame, schema_datatypes: DataFrame) -> DataFrame:
    """Experiments, owned or shared, whose type the destination does not know."""
    known = schema_datatypes.select(F.col("element_name").alias("xsi_type")).distinct()
    return experiments.join(known, "xsi_type", "left_anti")


def datatype_violations(missing: DataFrame) -> DataFrame:
    """Missing datatypes as violations."""
    return violation(missing, "datatype_not_enabled", detail=F.col("element_name"))


def experiment_violations(unsupported: DataFrame) -> DataFrame:
    """Unsupported experiments as violations."""
    return violation(
        unsupported,
        "datatype_not_available",
        project=F.col("project"),
        item_type=F.lit("experiment"),
        item_id=F.col("id"),
        detail=F.concat_ws(" for subject ", "xsi_type", "subject_id"),
    )


def type_violations(items: DataFrame) -> DataFrame:
    """Items of a type that has no id namespace."""
    return violation(
        items.where(id_namespace(F.col("item_type")).isNull()),
        "type_has_no_ids",
        project=F.col("project"),
        item_type=F.col("item_type"),
        item_id=F.col("id"),
    )
