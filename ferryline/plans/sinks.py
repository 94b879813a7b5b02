"""Writing plans and exports as tables.

``rebalance`` lets adaptive execution merge small partitions and split large ones before
the write, so a project with many rows is written by many tasks into files of even size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.model import METADATA_COLUMNS, RESOURCE_TYPES


def _write(rows: DataFrame, path: str, fmt: str, by: list[str], mode: str, **options) -> None:
    even = rows.hint("rebalance", *[F.col(c) for c in by])
    even.write.mode(mode).options(**options).partitionBy(*by).format(fmt).save(path)


def write_metadata(metadata: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV of the metadata columns, one folder per project and resource."""
    rows = metadata.select("project", "resource", *METADATA_COLUMNS)
    _write(rows, path, "csv", ["project", "resource"], mode, header=True)


def write_id_map(id_map: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV of the subject and experiment ids, one folder per project and namespace.

    Assessors share the experiments' namespace and so are among them.
    """
    rows = id_map.where(F.col("map_type").isin(*RESOURCE_TYPES.values())).select(
        "src_project", "map_type", "source_id", "destination_id"
    )
    _write(rows, path, "csv", ["src_project", "map_type"], mode, header=True)


def write_create_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Items to create, by destination project and item type."""
    _write(plan, path, "parquet", ["dst_project", "item_type"], mode)


def write_config_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Settings to put, by destination project."""
    _write(plan, path, "parquet", ["dst_project"], mode)


def write_share_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Items to show in further projects, by item type."""
    _write(plan, path, "parquet", ["item_type"], mode)


def write_user_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Users to create."""
    plan.hint("rebalance").write.mode(mode).parquet(path)


def write_refresh_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Catalogues to refresh, by project, deepest first within a file."""
    rows = plan.hint("rebalance", F.col("project")).sortWithinPartitions(
        "project", F.desc("depth"), "step"
    )
    rows.write.mode(mode).partitionBy("project").parquet(path)
