"""Planning a whole tree at once, with owners that only the documents name."""

import pytest
from pyspark.sql import functions as F

from ferryline.functions.xmlio import root_attribute
from ferryline.model import SRC_ITEM
from ferryline.operators.sharing import share_violations
from ferryline.plans.migration import Staging, create_plan
from ferryline.sources.projects import project_map

X = 'xmlns:xnat="http://nrg.wustl.edu/xnat"'
DESTINATION = "project STRING, item_type STRING, id STRING, label STRING, subject_label STRING, experiment_label STRING"
ID_MAP = "src_project STRING, map_type STRING, source_id STRING, destination_id STRING, seq LONG"


def item(kind, id, xml, owner=None, subject=None, experiment=None, project="p0"):
    row = dict.fromkeys(SRC_ITEM.names)
    row |= {"project": project, "item_type": kind, "id": id, "label": id.lower(), "owner_project": owner}
    row |= {"subject_id": subject, "subject_label": subject and subject.lower(), "ordinal": 0}
    row |= {"experiment_id": experiment, "experiment_label": experiment and experiment.lower(), "xml": xml}
    return tuple(row[c] for c in SRC_ITEM.names)


def tree(owner):
    return [
        item("project", "p0", f"<xnat:Project {X} ID='p0'/>", owner),
        item("subject", "S", f'<xnat:Subject {X} label="l" project="p0"/>', owner),
        item("experiment", "E", f"<!-- project='no' --><xnat:MRSession {X} note=' project=\"no\"' project = 'p0'><xnat:subject_ID>S</xnat:subject_ID></xnat:MRSession>", owner, "S"),
        item("scan", "1", f"<xnat:MRScan {X}><xnat:image_session_ID>E</xnat:image_session_ID></xnat:MRScan>", owner, "S", "E"),
        item("assessor", "A", f"<xnat:Assessor {X} project='p0'><xnat:imageSession_ID>E</xnat:imageSession_ID><xnat:scanID>1</xnat:scanID></xnat:Assessor>", owner, "S", "E"),
    ]


@pytest.fixture(scope="module")
def pairs(spark):
    return project_map(spark, ["p0", "p9"], ["d0", "d9"], src_archive="/a", dst_archive="/b")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DESTINATION), spark.createDataFrame([], ID_MAP)


def planned(spark, rows, pairs, dst, ids, **options):
    plan, errors = create_plan(spark.createDataFrame(rows, SRC_ITEM), dst, pairs, ids, **options)
    kept = plan.select("item_type", "source_id", "level", "status", F.size("pending").alias("n"), "payload_xml")
    return sorted(map(tuple, kept.collect())), sorted(map(tuple, errors.collect()), key=repr)


@pytest.mark.parametrize("owner", ["p0", None])
def test_first_run_plans_the_tree(spark, pairs, empty, owner):
    plan, errors = planned(spark, tree(owner), pairs, *empty)
    assert errors == []
    assert [p[:5] for p in plan] == [
        ("assessor", "A", 3, "waiting", 2),
        ("experiment", "E", 2, "waiting", 1),
        ("project", "p0", 0, "ready", 0),
        ("scan", "1", 3, "waiting", 1),
        ("subject", "S", 1, "ready", 0),
    ]
    assert "<xnat:subject_ID>S</xnat:subject_ID>" in plan[1][5]


def test_run_after_the_first(spark, pairs, empty):
    """Half the tree is there: its ids are known, and only the rest is planned."""
    dst = spark.createDataFrame(
        [("d0", "project", "d0", "d0", None, None), ("d0", "subject", "X1", "s", None, None)], DESTINATION
    )
    ids = spark.createDataFrame([("p0", "subject", "S", "X1", 0)], ID_MAP)
    plan, errors = planned(spark, tree(None), pairs, dst, ids)
    assert errors == [] and [p[1] for p in plan] == ["A", "E", "1"]
    assert plan[1][3] == "ready" and "<xnat:subject_ID>X1</xnat:subject_ID>" in plan[1][5]


def test_unknown_owners_are_told_not_dropped(spark, pairs, empty):
    rows = [*tree(None), item("subject", "T", f"<xnat:Subject {X}/>")]
    plan, errors = planned(spark, rows, pairs, *empty)
    assert len(plan) == 5
    assert errors == [("owner_unknown", "p0", "subject", "T", None)]
    assert share_violations(spark.createDataFrame(rows, SRC_ITEM), pairs, empty[1]).isEmpty()


def test_references_to_nothing(spark, pairs, empty):
    """A scan that only another project has is not taken for one's own."""
    elsewhere = [item(*r, project="p9") for r in (("project", "p9", f"<xnat:Project {X}/>", "p9"),)]
    other = item("scan", "99", f"<xnat:MRScan {X}/>", "p9", "S9", "E9", project="p9")
    session = item("experiment", "E9", f"<xnat:MRSession {X}/>", "p9", "S9", project="p9")
    bad = item("assessor", "B", f"<xnat:Assessor {X}><xnat:scanID>99</xnat:scanID></xnat:Assessor>", "p0", "S", "E")
    ids = spark.createDataFrame([("p9", "scan", "99", "99", 1)], ID_MAP)
    plan, errors = planned(spark, [*tree("p0"), *elsewhere, session, other, bad], pairs, empty[0], ids)
    assert errors == [("unmapped_reference", "p0", "assessor", "B", "scan 99")]
    assert "B" not in {p[1] for p in plan} and len(plan) == 8


def test_staging_is_asked_for_and_removed(spark, pairs, empty, tmp_path):
    with pytest.raises(ValueError, match="file system"):
        Staging(spark, str(tmp_path))
    with Staging(spark, f"file://{tmp_path}") as staging:
        assert planned(spark, tree(None), pairs, *empty, staging=staging) == planned(spark, tree(None), pairs, *empty)
        assert len(list(tmp_path.iterdir())) == 1
    assert list(tmp_path.iterdir()) == []


def test_root_attributes(spark):
    cases = [
        ('<?xml version="1.0"?>\n<a project="x&amp;y"/>', "x&y"),
        ("<a other='1'><b project='no'/></a>", None),
        ("<a projects='no' project='yes'>", "yes"),
        ("<a note='project=&quot;no&quot;'/>", None),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "i INT, xml STRING")
    found = rows.select("i", root_attribute(F.col("xml"), "project").alias("v")).orderBy("i")
    assert [r.v for r in found.collect()] == [v for _, v in cases]
