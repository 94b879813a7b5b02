"""What holds for any plan, and what the physical plans look like."""

import ast
import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ferryline.functions.xmlio import parse_items
from ferryline.operators.rewrite import item_references
from ferryline.plans import migration
from standin import Archive

SF_DIR = "/root/testdata/sf0.001"
ROOT = pathlib.Path(entry.__file__).parent


@pytest.fixture(scope="module")
def archive(spark):
    return Archive(spark, SF_DIR)


@pytest.fixture(scope="module")
def id_map(archive):
    return entry._id_map(archive).persist()


def test_nothing_is_left_to_create_afterwards(archive, id_map):
    """A second run, with every owned item at the destination, plans nothing."""
    after = archive["dst_all"].drop("k")
    plan, _ = migration.create_plan(
        archive["src_items"].where("item_type <> 'scan'"), after, archive["pm"], id_map
    )
    assert plan.isEmpty()
    copied = entry.files.files_to_copy(
        archive["files_src"],
        archive["files_src"].withColumn("project", F.regexp_replace("project", "src", "dst")),
        archive["fpm"],
    )
    assert copied.isEmpty()


def test_id_map_is_unique(id_map):
    assert id_map.groupBy("src_project", "map_type", "source_id").count().where("count > 1").isEmpty()


def test_no_item_is_shared_with_its_owner(archive, id_map):
    plan = entry.sharing.share_plan(archive["src_items"], archive["pm"], id_map)
    assert not plan.isEmpty()
    assert plan.where("owner = project_id").isEmpty()


def test_share_plan_is_the_opened_groups(archive, id_map):
    groups = entry.sharing.collect_sharing(archive["src_items"], archive["pm"])
    opened = groups.where("owner IS NOT NULL").select(
        "item_type", "source_id", "owner", F.explode("projects").alias("project_id")
    )
    mapped = entry.identity.resolve_across_projects(opened, id_map).where("destination_id IS NOT NULL")
    columns = ["item_type", "owner", "destination_id", "project_id"]
    plan = entry.sharing.share_plan(archive["src_items"], archive["pm"], id_map)
    assert sorted(mapped.select(*columns).collect()) == sorted(plan.select(*columns).collect())


def test_create_plan_and_violations_are_apart(archive, id_map):
    sample = archive["src_items"].where("item_type IN ('project', 'subject', 'experiment')")
    plan, errors = migration.create_plan(sample, archive["dst_before"], archive["pm"], id_map)
    planned = plan.select("item_type", F.col("source_id").alias("item_id")).persist()
    assert planned.where("item_type = 'experiment'").count() > 100
    assert planned.join(errors, ["item_type", "item_id"], "left_semi").isEmpty()
    assert plan.where("payload_xml IS NULL").isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark):
    plan = plan_of(entry.queries()["q_unsupported_experiments"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    assert not any("o_totalprice" in s or "o_orderdate" in s for s in schemas)
    plan = plan_of(entry.queries()["q_users_to_create"](spark, SF_DIR))
    assert "s_phone" not in plan


def test_documents_are_parsed_once_and_references_read_alone(spark, tmp_path):
    docs = spark.createDataFrame(
        [("p", "scan", "1", "E", "<a/>")],
        "project STRING, item_type STRING, id STRING, experiment_id STRING, xml STRING",
    )
    parsed = parse_items(docs)
    assert len(re.findall(r"_parse_batches\(xml#\d+\)#\d+\]", plan_of(parsed))) == 1
    parsed.write.parquet(str(tmp_path / "items"))
    back = spark.read.parquet(str(tmp_path / "items"))
    assert "element" not in plan_of(item_references(back))


@pytest.mark.parametrize("staged", [False, True])
def test_one_parse_in_executed_plans(spark, archive, id_map, tmp_path, staged):
    """Documents go through the parser once, however many parts of the plan want something of them."""
    docs = archive["src_items"].repartition("item_type", "experiment_id", "id")
    tables = docs, archive["dst_before"], archive["pm"], id_map
    if staged:
        with migration.Staging(spark, f"file://{tmp_path}") as staging:
            rewritten = migration.rewritten_items(*tables)
            assert not staging.write(rewritten, "rewritten").isEmpty()
            results = [rewritten]
            results[0].collect()
    else:
        results = list(migration.create_plan(*tables))
        for rows in results:
            assert rows.collect()
    for rows in results:
        final = plan_of(rows).split("== Initial Plan ==")[0]
        assert len(re.findall(r"ArrowEvalPython \[_parse_batches", final)) == 1
        assert "ReusedExchange" in final


def test_documents_are_not_read_for_facts(spark, archive, tmp_path):
    """Where the listing names the owner, the scan leaves the document column alone."""
    path = str(tmp_path / "items")
    archive["src_items"].where("item_type IN ('project', 'subject', 'experiment')").write.parquet(path)
    leaves = migration.item_facts(spark.read.parquet(path))._jdf.queryExecution().sparkPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    reading = [scan for scan in scans if "xml" in list(scan.requiredSchema().fieldNames())]
    assert len(scans) == 2 and len(reading) == 1
    assert "isnull(owner_project" in reading[0].dataFilters().toString()


def test_library_runs_no_hidden_jobs():
    """No plan runs a job while it is made, nor pulls rows to the driver.

    Strict mode shows one row; sinks, what publishes them and asked-for staging write. Models of the training-data operators are fitted
    by jobs of their own.
    """
    forbidden = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "rdd", "crossJoin"}
    forbidden |= {"approxQuantile", "write"}
    allowed = {"sinks.py": {"write"}, "migration.py": {"write"}}
    allowed["publish.py"] = {"write"}
    for path in (ROOT / "ferryline").rglob("*.py"):
        if "llm" in path.parts:
            continue
        used = {
            node.attr for node in ast.walk(ast.parse(path.read_text())) if isinstance(node, ast.Attribute)
        }
        assert not used & forbidden - allowed.get(path.name, set()), path
