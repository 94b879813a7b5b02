"""Reading exported server listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.functions.xmlio import parse_items
from ferryline.model import ITEM_METADATA, SRC_ITEM, USER_PROFILE
from ferryline.operators.checks import all_violations, violation


def _resultset(schema: str) -> str:
    return f"ResultSet STRUCT<Result: ARRAY<STRUCT<{schema}>>>"


def unwrap_resultset(rows: DataFrame, document: str | Column, schema: str) -> DataFrame:
    """One row per result of a JSON listing held in a text column.

    ``schema`` lists the wanted fields as ``name: TYPE``. ``pos`` is the place in the
    listing; the other columns of ``rows`` are kept.
    """
    doc = F.col(document) if isinstance(document, str) else document
    kept = [c for c in rows.columns if c != document]
    parsed = rows.withColumn("_doc", F.from_json(doc, _resultset(schema)))
    results = F.posexplode("_doc.ResultSet.Result").alias("pos", "_result")
    opened = parsed.select(*kept, results)
    return opened.select(*kept, F.col("pos").cast("long").alias("pos"), "_result.*")


def read_resultset(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per result of JSON listing files, with ``pos`` and the file as ``listing``."""
    docs = spark.read.schema(_resultset(schema)).option("multiLine", True).json(path)
    results = F.posexplode("ResultSet.Result").alias("pos", "_result")
    opened = docs.select(F.col("_metadata.file_path").alias("listing"), results)
    return opened.select("listing", F.col("pos").cast("long").alias("pos"), "_result.*")


def read_array(spark: SparkSession, path: str | list[str], element: str) -> DataFrame:
    """One row per element of files that hold one JSON array each, with ``pos``."""
    texts = spark.read.text(path, wholetext=True)
    items = F.posexplode(F.from_json("value", f"ARRAY<{element}>")).alias("pos", "item")
    return texts.select(items).select(F.col("pos").cast("long").alias("pos"), "item")


def read_datatypes(spark: SparkSession, path: str | list[str], server: str) -> DataFrame:
    """Datatypes a server can create: ``server``, ``element_name``."""
    rows = spark.read.schema("elementName STRING").option("multiLine", True).json(path)
    return rows.select(F.lit(server).alias("server"), F.col("elementName").alias("element_name"))


def read_schema_datatypes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Datatypes of the destination's schema: ``element_name``."""
    return read_array(spark, path, "STRING").select(F.col("item").alias("element_name"))


def read_profiles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """User profiles with their place in the list."""
    fields = ", ".join(
        f"{f.name}: {f.dataType.simpleString()}" for f in USER_PROFILE if f.name != "pos"
    )
    return read_array(spark, path, f"STRUCT<{fields}>").select("pos", "item.*")


def read_metadata(spark: SparkSession, path: str | list[str], project: str, resource: str) -> DataFrame:
    """Metadata listing of one project's subjects or experiments."""
    fields = ", ".join(f"{c}: STRING" for c in ITEM_METADATA.names[2:])
    rows = read_resultset(spark, path, fields)
    named = rows.withColumns({"project": F.lit(project), "resource": F.lit(resource)})
    return named.select(*ITEM_METADATA.names)


def _read_folders(spark: SparkSession, path: str, folders: list[str], fields: str) -> DataFrame:
    """All listings below ``path`` in one scan; folders named ``project=…`` and so on say whose."""
    named = ", ".join(f"{f} STRING" for f in folders)
    docs = (
        spark.read.schema(f"{_resultset(fields)}, {named}")
        .option("multiLine", True)
        .json(path)
    )
    opened = docs.select(*folders, F.posexplode("ResultSet.Result").alias("pos", "_result"))
    return opened.select(*folders, F.col("pos").cast("long").alias("pos"), "_result.*")


def read_all_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata listings of all projects, from ``project=…/resource=…`` folders, with ``pos``."""
    fields = ", ".join(f"{c}: STRING" for c in ITEM_METADATA.names[2:])
    rows = _read_folders(spark, path, ["project", "resource"], fields)
    return rows.select(*ITEM_METADATA.names, "pos")


def read_all_tools(spark: SparkSession, path: str) -> DataFrame:
    """Tools of all projects in listing order, from ``project=…`` folders."""
    return _read_folders(spark, path, ["project"], "tool: STRING")


def read_all_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of all tools, from ``project=…/tool=…`` folders; for :func:`config_settings`."""
    return _read_folders(spark, path, ["project", "tool"], "path: STRING, contents: STRING")


def config_settings(tools: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of the listed tools in listing order.

    ``tools`` has ``project``, ``tool`` and ``pos``; ``settings`` the same and ``path``
    and ``contents``. A tool listed twice is read twice, to the same effect.
    """
    order = tools.groupBy("project", "tool").agg(F.max("pos").alias("_tool_pos"))
    rows = settings.join(order, ["project", "tool"])
    place = F.col("_tool_pos").cast("long") * (1 << 31) + F.col("pos")
    return rows.select("project", "tool", "path", "contents", place.alias("pos"))


def read_items(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """Source items from one table per level, each with its parents' ids and labels.

    ``paths`` maps an item type to a table with ``project``, ``id``, ``label`` and, as far
    as they apply, ``subject_id``, ``experiment_id``, ``owner_project``, ``xsi_type``,
    ``ordinal`` and ``xml``. Missing parent labels are looked up one level above, and a
    scan's or assessor's subject is that of its experiment.
    """
    read = {
        kind: spark.read.format(fmt).load(path) for kind, path in paths.items()
    }
    return assemble_items(read)


def assemble_items(levels: dict[str, DataFrame]) -> DataFrame:
    """Put tables per level together; see :func:`read_items`."""
    subjects = experiments = None
    if "subject" in levels:
        subjects = levels["subject"].select(
            "project", F.col("id").alias("subject_id"), F.col("label").alias("subject_label")
        )
    if "experiment" in levels:
        experiments = _look_up(levels["experiment"], subjects, ["project", "subject_id"])
    out = None
    for kind, rows in levels.items():
        if kind == "experiment":
            rows = experiments
        elif kind in ("scan", "assessor") and experiments is not None:
            columns = ["subject_id", "subject_label"]
            parents = experiments.select(
                "project",
                F.col("id").alias("experiment_id"),
                F.col("label").alias("experiment_label"),
                *[c for c in columns if c in experiments.columns],
            )
            rows = _look_up(rows, parents, ["project", "experiment_id"])
        full = _conform(rows.withColumn("item_type", F.lit(kind)))
        out = full if out is None else out.unionByName(full)
    if out is None:
        raise ValueError("no item tables given")
    return out


def listing_violations(levels: dict[str, DataFrame]) -> DataFrame:
    """Items whose parent no listing has, and items that are listed below several parents.

    ``levels`` as for :func:`assemble_items`. Such items would have no place at the destination, or two. Where no listing of the
    parents' type is given, no parent is looked for.
    """
    parents = {"subject": "project", "experiment": "subject", "scan": "experiment", "assessor": "experiment"}
    told = []
    for kind, above in parents.items():
        if kind not in levels:
            continue
        rows = levels[kind]
        own = "project" if above == "project" else f"{above}_id"
        if above in levels:
            known = levels[above].select("project", F.col("id").alias("_parent")).distinct()
            keyed = rows.select("project", "id", F.col(own).alias("_parent"))
            told.append(
                violation(
                    keyed.join(known, ["project", "_parent"], "left_anti"),
                    "parent_not_listed",
                    project=F.col("project"),
                    item_type=F.lit(kind),
                    item_id=F.col("id"),
                    detail=F.concat_ws(" ", F.lit(above), "_parent"),
                )
            )
        if kind in ("experiment", "assessor"):
            several = rows.groupBy("project", "id").agg(F.min(own).alias("least"), F.max(own).alias("greatest"))
            told.append(
                violation(
                    several.where("least <> greatest"),
                    "several_parents",
                    project=F.col("project"),
                    item_type=F.lit(kind),
                    item_id=F.col("id"),
                    detail=F.concat_ws(" ", F.lit(above), "least", "greatest"),
                )
            )
    if not told:
        raise ValueError("no item tables given")
    return all_violations(*told)


def _look_up(rows: DataFrame, parents: DataFrame | None, on: list[str]) -> DataFrame:
    """Add what the parents have and the rows lack."""
    if parents is None:
        return rows
    taken = [c for c in parents.columns if c in on or c not in rows.columns]
    return rows.join(parents.select(*taken), on, "left")


def _conform(rows: DataFrame) -> DataFrame:
    columns = []
    for field in SRC_ITEM:
        given = F.col(field.name) if field.name in rows.columns else F.lit(None)
        columns.append(given.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def with_document_facts(items: DataFrame) -> DataFrame:
    """Fill owner and datatype from the documents, and keep these parsed."""
    parsed = parse_items(items)
    attrs = F.col("element.attrs")
    kind = F.lit("{http://www.w3.org/2001/XMLSchema-instance}type")
    return parsed.withColumns(
        {
            "owner_project": F.coalesce("owner_project", F.try_element_at(attrs, F.lit("project"))),
            "xsi_type": F.coalesce("xsi_type", F.try_element_at(attrs, kind)),
        }
    )
