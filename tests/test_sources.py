"""Reading listings and folders, and writing plans."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ferryline.model import ITEM_METADATA
from ferryline.plans import sinks
from ferryline.sources import listings
from ferryline.sources.manifest import file_roots, manifest_violations, read_manifest
from ferryline.sources.projects import pair_lists, project_map


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, value):
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def resultset(*results):
    return {"ResultSet": {"Result": list(results), "title": "x"}}


def test_resultset_files(spark, tmp_path):
    put(tmp_path / "a.json", resultset({"ID": "S1", "label": "a"}, {"ID": "S2", "label": None}))
    put(tmp_path / "b.json", resultset())
    read = listings.read_resultset(spark, str(tmp_path), "ID: STRING, label: STRING")
    assert rows(read.drop("listing")) == [(0, "S1", "a"), (1, "S2", None)]
    assert read.first()["listing"].endswith("a.json")


def test_resultset_column(spark):
    text = json.dumps(resultset({"tool": "t1"}, {"tool": "t2"}))
    df = spark.createDataFrame([("p", text), ("q", "{}"), ("r", None)], "project STRING, doc STRING")
    assert rows(listings.unwrap_resultset(df, "doc", "tool: STRING")) == [
        ("p", 0, "t1"),
        ("p", 1, "t2"),
    ]


def test_datatypes(spark, tmp_path):
    path = put(tmp_path / "d.json", [{"elementName": "xnat:a", "x": 1}, {"elementName": "xdat:b"}])
    assert rows(listings.read_datatypes(spark, path, "src")) == [("src", "xdat:b"), ("src", "xnat:a")]
    path = put(tmp_path / "s.json", ["xnat:a", "xnat:b"])
    assert rows(listings.read_schema_datatypes(spark, path)) == [("xnat:a",), ("xnat:b",)]


def test_profiles(spark, tmp_path):
    path = put(
        tmp_path / "u.json",
        [
            {"id": 2, "username": "b", "enabled": True, "email": "e", "verified": False,
             "firstName": "F", "lastName": "L", "secured": 1},
            {"id": 1, "username": "a"},
        ],
    )
    found = listings.read_profiles(spark, path)
    assert [tuple(r) for r in found.orderBy("pos").collect()] == [
        (0, 2, "b", True, "e", False, "F", "L"),
        (1, 1, "a", None, None, None, None, None),
    ]


def test_metadata_round_trip(spark, tmp_path):
    listing = resultset(
        {"ID": "S1", "label": "a", "insert_user": "u", "insert_date": "2020-01-01 00:00:00.0",
         "last_modified": None, "URI": "/x"}
    )
    path = put(tmp_path / "m.json", listing)
    read = listings.read_metadata(spark, path, "p1", "subjects")
    assert read.columns == ITEM_METADATA.names
    other = read.withColumn("project", F.lit("p2"))
    out = str(tmp_path / "out")
    sinks.write_metadata(read.unionAll(other), out)
    back = spark.read.option("header", True).csv(out)
    assert rows(back.select("project", "resource", "ID", "insert_date")) == [
        ("p1", "subjects", "S1", "2020-01-01 00:00:00.0"),
        ("p2", "subjects", "S1", "2020-01-01 00:00:00.0"),
    ]
    assert os.path.isdir(f"{out}/project=p1/resource=subjects")


def test_id_map_export(spark, tmp_path):
    schema = "src_project STRING, map_type STRING, source_id STRING, destination_id STRING, seq LONG"
    given = [("p1", "subject", "S1", "X1", 0), ("p1", "experiment", "E1", "X2", 0), ("p1", "scan", "1", "1", 0)]
    out = str(tmp_path / "ids")
    sinks.write_id_map(spark.createDataFrame(given, schema), out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["source_id", "destination_id", "src_project", "map_type"]
    assert rows(back) == [("E1", "X2", "p1", "experiment"), ("S1", "X1", "p1", "subject")]


def test_plan_tables(spark, tmp_path):
    def table(columns, *values):
        return spark.createDataFrame(list(values), ", ".join(f"{c} STRING" for c in columns.split()))

    cases = [
        (sinks.write_create_plan, table("dst_project item_type payload_xml", ("d", "scan", "<a/>"))),
        (sinks.write_config_plan, table("dst_project tool contents", ("d", "t", "c"))),
        (sinks.write_share_plan, table("item_type path", ("subject", "/p"))),
        (sinks.write_user_plan, table("username email", ("u", "e"))),
        (
            sinks.write_refresh_plan,
            table("project path", ("d", "/p")).withColumns({"depth": F.lit(1), "step": F.lit(2)}),
        ),
    ]
    for i, (write, plan) in enumerate(cases):
        path = str(tmp_path / str(i))
        write(plan, path)
        assert rows(spark.read.parquet(path).select(*plan.columns)) == rows(plan)
        with pytest.raises(Exception, match="already exists"):
            write(plan, path)
        write(plan, path, mode="overwrite")


def test_config_settings(spark):
    tools = spark.createDataFrame(
        [("p", "b", 0), ("p", "a", 1)], "project STRING, tool STRING, pos LONG"
    )
    settings = spark.createDataFrame(
        [("p", "a", 0, "x", "1"), ("p", "b", 0, "x", "2"), ("p", "b", 1, "y", "3"), ("p", "z", 0, "x", "4")],
        "project STRING, tool STRING, pos LONG, path STRING, contents STRING",
    )
    ordered = listings.config_settings(tools, settings).orderBy("pos")
    assert [r["contents"] for r in ordered.collect()] == ["2", "3", "1"]


def test_items_from_levels(spark, tmp_path):
    def save(name, columns, *values):
        path = str(tmp_path / name)
        schema = ", ".join(f"{c} STRING" for c in columns.split())
        spark.createDataFrame(list(values), schema).write.parquet(path)
        return path

    read = listings.read_items(
        spark,
        {
            "project": save("p", "project id label", ("p1", "p1", "p1")),
            "subject": save("s", "project id label owner_project", ("p1", "S1", "a", "p1")),
            "experiment": save(
                "e", "project id label subject_id xml",
                ("p1", "E1", "b", "S1", '<a project="p0" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:type="xnat:mr"/>'),
            ),
            "scan": save("c", "project id experiment_id", ("p1", "1", "E1")),
        },
    )
    shown = read.select("item_type", "id", "subject_id", "subject_label", "experiment_id", "experiment_label")
    assert sorted(map(tuple, shown.collect()), key=repr) == [
        ("experiment", "E1", "S1", "a", None, None),
        ("project", "p1", None, None, None, None),
        ("scan", "1", "S1", "a", "E1", "b"),
        ("subject", "S1", None, None, None, None),
    ]
    facts = listings.with_document_facts(read).select("id", "owner_project", "xsi_type")
    assert ("E1", "p0", "xnat:mr") in {tuple(r) for r in facts.collect()}


@pytest.fixture
def tree(tmp_path):
    for name in ["p1/a.dcm", "p1/.h/d.dcm", "p1/_u/x/y/z/deep.dcm", "p1/s/c.json", "p2/f"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "p1/empty").mkdir()
    (tmp_path / "p1/loop").symlink_to(tmp_path / "p1")
    return tmp_path


@pytest.mark.parametrize("split_levels", [0, 1, 3, 9])
def test_manifest(spark, tree, split_levels):
    pairs = project_map(spark, ["p1", "p2"], src_files=str(tree), dst_files="/none")
    found = read_manifest(file_roots(pairs, "src"), split_levels=split_levels)
    assert rows(found.select("project", "rel_path")) == [
        ("p1", ".h/d.dcm"),
        ("p1", "_u/x/y/z/deep.dcm"),
        ("p1", "a.dcm"),
        ("p1", "loop"),
        ("p1", "s/c.json"),
        ("p2", "f"),
    ]
    sizes = {(r["project"], r["rel_path"]): r["length"] for r in found.collect()}
    assert sizes["p1", "_u/x/y/z/deep.dcm"] == len("p1/_u/x/y/z/deep.dcm")


def test_missing_and_unreadable_roots(spark, tree):
    """A root that is not there yet has no files; what cannot be read is told."""
    pairs = project_map(spark, ["p1", "p2", "none"], src_files=str(tree), dst_files="/none")
    roots = file_roots(pairs, "src")
    found = read_manifest(roots)
    assert found.where("project = 'none'").isEmpty() and found.count() == 6
    assert read_manifest(file_roots(pairs, "dst")).isEmpty()
    no_folder = spark.createDataFrame([("p3", str(tree / "p2/f"))], "project STRING, root STRING")
    assert read_manifest(no_folder).isEmpty()
    told = manifest_violations(roots.unionByName(no_folder)).collect()
    assert [(r.check, r.project, r.item_id, r.detail) for r in told] == [
        ("unreadable", "p3", "", "NotADirectoryError")
    ]


def test_listings_of_many_projects(spark, tmp_path):
    for project, resource, name in (("001", "subjects", "a"), ("001", "experiments", "b"), ("p2", "subjects", "c")):
        folder = tmp_path / "meta" / f"project={project}" / f"resource={resource}"
        folder.mkdir(parents=True)
        put(folder / "x.json", resultset({"ID": name, "label": "l"}, {"ID": name + "2"}))
    read = listings.read_all_metadata(spark, str(tmp_path / "meta"))
    assert rows(read.select("project", "resource", "ID", "pos")) == [
        ("001", "experiments", "b", 0), ("001", "experiments", "b2", 1),
        ("001", "subjects", "a", 0), ("001", "subjects", "a2", 1),
        ("p2", "subjects", "c", 0), ("p2", "subjects", "c2", 1),
    ]
    for tool, value in (("t1", "1"), ("t2", "2")):
        folder = tmp_path / "set" / "project=001" / f"tool={tool}"
        folder.mkdir(parents=True)
        put(folder / "x.json", resultset({"path": "k", "contents": value}))
    (tmp_path / "tools" / "project=001").mkdir(parents=True)
    put(tmp_path / "tools" / "project=001" / "x.json", resultset({"tool": "t2"}, {"tool": "t1"}, {"tool": "t2"}))
    tools = listings.read_all_tools(spark, str(tmp_path / "tools"))
    settings = listings.read_all_settings(spark, str(tmp_path / "set"))
    ordered = listings.config_settings(tools, settings).orderBy("pos")
    assert [(r.project, r.tool, r.contents) for r in ordered.collect()] == [("001", "t1", "1"), ("001", "t2", "2")]


def test_manifest_checksums(spark, tree):
    pairs = project_map(spark, ["p2"], src_files=str(tree))
    found = read_manifest(file_roots(pairs, "src"), checksum=True)
    import hashlib

    assert rows(found.select("rel_path", "checksum")) == [("f", hashlib.md5(b"p2/f").hexdigest())]
    assert found.select(F.year("mtime")).first()[0] >= 2024


def test_paired_lists(spark):
    source = spark.createDataFrame([(0, "a"), (1, "b")], "pos LONG, project STRING")
    destination = spark.createDataFrame([(0, "c")], "pos LONG, project STRING")
    pairs, unpaired = pair_lists(source, destination)
    assert rows(pairs.select("seq", "src_project", "dst_project")) == [(0, "a", "c")]
    assert rows(unpaired.select("check", "project")) == [("project_not_paired", "b")]
