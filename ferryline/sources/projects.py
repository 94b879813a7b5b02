"""Which source project goes to which destination project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.model import PROJECT_MAP
from ferryline.operators.checks import all_violations, violation


def project_map(
    spark: SparkSession,
    source: list[str],
    destination: list[str] | None = None,
    secondary_ids: list[str] | None = None,
    names: list[str] | None = None,
    *,
    src_archive: str | None = None,
    dst_archive: str | None = None,
    src_files: str | None = None,
    dst_files: str | None = None,
) -> DataFrame:
    """Pair project lists by position. Each destination list defaults to the source list.

    Lists of unequal length are refused. An archive root may be unknown; documents with
    file locations are then reported instead of rewritten.
    """
    lists = [source, *[source if x is None else x for x in (destination, secondary_ids, names)]]
    if len({len(x) for x in lists}) != 1:
        raise ValueError(
            "project lists differ in length: "
            + ", ".join(str(len(x)) for x in lists)
        )
    pairs = [(seq, *row) for seq, row in enumerate(zip(*lists, strict=True))]
    schema = "seq LONG, src_project STRING, dst_project STRING, dst_secondary_id STRING, dst_name STRING"
    return with_roots(
        spark.createDataFrame(pairs, schema),
        src_archive=src_archive,
        dst_archive=dst_archive,
        src_files=src_files,
        dst_files=dst_files,
    )


def with_roots(
    pairs: DataFrame,
    *,
    src_archive: str | None,
    dst_archive: str | None,
    src_files: str | None,
    dst_files: str | None,
) -> DataFrame:
    """Complete a table of pairs: source names for what is missing, and the roots.

    File roots become each project's own folder: the contents of the source's, and the
    destination's itself.
    """

    def text(value: str | None):
        return F.lit(value).cast("string")

    for name in ("dst_project", "dst_secondary_id", "dst_name"):
        given = F.col(name) if name in pairs.columns else F.lit(None)
        pairs = pairs.withColumn(name, F.coalesce(given.cast("string"), "src_project"))
    return pairs.withColumns(
        {
            "src_archive": text(src_archive),
            "dst_archive": text(dst_archive),
            "src_files": F.concat(text(src_files), F.lit("/"), "src_project", F.lit("/")),
            "dst_files": F.concat(text(dst_files), F.lit("/"), "dst_project"),
        }
    ).select(*PROJECT_MAP.names)


def pair_lists(source: DataFrame, destination: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair two tables of ``pos`` and project columns by position.

    Gives the pairs, and a violation for every position that only one side has.
    """
    src = source.select("pos", F.col("project").alias("src_project"))
    dst = destination.withColumnRenamed("project", "dst_project")
    both = src.join(dst, "pos", "full_outer").withColumnRenamed("pos", "seq")
    unpaired = violation(
        both.where(F.col("src_project").isNull() | F.col("dst_project").isNull()),
        "project_not_paired",
        project=F.coalesce("src_project", "dst_project"),
        item_type=F.lit("project"),
        detail=F.col("seq"),
    )
    return both.where(F.col("src_project").isNotNull() & F.col("dst_project").isNotNull()), unpaired


def root_violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose archive root is not known on one side."""
    return all_violations(
        *[
            violation(
                pairs.where(F.col(column).isNull()),
                "archive_unknown",
                project=F.col("src_project"),
                item_type=F.lit("project"),
                item_id=F.col("src_project"),
                detail=F.lit(column),
            )
            for column in ("src_archive", "dst_archive")
        ]
    )
