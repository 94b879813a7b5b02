"""Small cases with results known beforehand."""

from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from ferryline.functions import element as el
from ferryline.functions import ids, paths, uris
from ferryline.functions.xmlio import parse_items, parse_xml, quick_extract, to_xml
from ferryline.model import DST_ITEM, SRC_ITEM, clark
from ferryline.operators import catalogs, checks, configs, files, identity, rewrite, sharing, users
from ferryline.operators.items import missing_items, owned_items, with_destination
from ferryline.sources.projects import project_map, root_violations

NS = 'xmlns:xnat="http://nrg.wustl.edu/xnat"'


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "element_name STRING")


def items(spark, *given):
    """Source items from dictionaries."""
    return spark.createDataFrame(
        [tuple(row.get(f.name) for f in SRC_ITEM) for row in given], SRC_ITEM
    )


def placed(spark, *given):
    return spark.createDataFrame(
        [tuple(row.get(f.name) for f in DST_ITEM) for row in given], DST_ITEM
    )


def id_map(spark, *given):
    schema = "src_project STRING, map_type STRING, source_id STRING, destination_id STRING, seq LONG"
    return spark.createDataFrame(list(given), schema)


def test_datatypes(spark):
    source = names(spark, "xnat:mrSessionData", "xnat:ctSessionData", "xdat:user", "xnat:ctSessionData")
    destination = names(spark, "xnat:mrSessionData")
    assert rows(checks.missing_datatypes(source, destination)) == [("xnat:ctSessionData",)]
    assert rows(checks.check_datatypes(source, destination)) == [(False, ["xnat:ctSessionData"])]
    assert rows(checks.check_datatypes(destination, source)) == [(True, [])]
    # The prefix is case-sensitive.
    assert rows(checks.missing_datatypes(names(spark, "XDAT:user"), destination)) == [("XDAT:user",)]


@pytest.mark.parametrize(
    ("uri", "expected", "mismatch"),
    [
        (None, None, False),
        ("/arc/proj1/a/f.dcm", "/new/dst9/a/f.dcm", False),
        ("/arc/proj1/x/arc/proj1/y", "/new/dst9/x/arc/proj1/y", False),
        ("/arc/proj10/a", "/new/dst90/a", False),
        ("/mnt/arc/proj1/a", "/mnt/new/dst9/a", False),
        ("/else/a", "/else/a", True),
    ],
)
def test_uri(spark, uri, expected, mismatch):
    args = F.col("uri"), F.lit("/arc/proj1"), F.lit("/new/dst9")
    df = spark.createDataFrame([(uri,)], "uri STRING").select(
        uris.rewrite_uri(*args), uris.uri_mismatch(*args[:2])
    )
    assert rows(df) == [(expected, mismatch)]


def test_uri_bounded(spark):
    args = F.col("uri"), F.lit("/arc/p1"), F.lit("/new")
    df = spark.createDataFrame([("/arc/p10/arc/p1/x",), ("/arc/p1",)], "uri STRING").select(
        uris.rewrite_uri(*args, bounded=True)
    )
    assert rows(df) == [("/arc/p10/new/x",), ("/new",)]


@pytest.mark.parametrize(
    ("tag", "modalities", "expected"),
    [
        ("xnat:imageScanData", ["MR"], clark("xnat:MRScan")),
        ("xnat:imageScanData", ["PT"], clark("xnat:PETScan")),
        ("xnat:imageScanData", [], "xnat:OtherDicomScan"),
        ("xnat:imageScanData", ["XA"], "xnat:OtherDicomScan"),
        ("xnat:imageScanData", ["mr"], "xnat:OtherDicomScan"),
        ("xnat:imageScanData", ["MR", "MR"], "xnat:OtherDicomScan"),
        ("xnat:imageScanData", ["MR", "CT"], "xnat:OtherDicomScan"),
        ("xnat:imageScanData", ["MR", "", None], clark("xnat:MRScan")),
        ("xnat:mrScanData", ["MR"], clark("xnat:mrScanData")),
    ],
)
def test_scan_tag(spark, tag, modalities, expected):
    df = spark.createDataFrame([(clark(tag), modalities)], "tag STRING, m ARRAY<STRING>")
    assert rows(df.select(el.scan_tag(F.col("tag"), F.col("m")))) == [(expected,)]


@pytest.mark.parametrize(
    ("kind", "given", "expected"),
    [
        ("project", {"ID": "p1"}, [("ID", "D1"), ("secondary_ID", "S1"), ("project", "D1")]),
        ("subject", {"ID": "x", "project": "p1", "label": "a"}, [("project", "D1"), ("label", "a")]),
        ("scan", {"ID": "4"}, [("ID", "4"), ("project", "D1")]),
    ],
)
def test_root_attributes(spark, kind, given, expected):
    df = spark.createDataFrame([(given,)], "a MAP<STRING, STRING>")
    titled = el.retitle_attrs(F.col("a"), F.lit(kind), F.lit("D1"), F.lit("S1"))
    done = el.set_project_attr(el.drop_id_attr(titled, F.lit(kind)), F.lit("D1"))
    assert [tuple(e) for e in df.select(F.map_entries(done)).first()[0]] == expected


def test_reference_remap(spark):
    def doc(body):
        return f"<xnat:MRSession {NS}>{body}</xnat:MRSession>"

    subject = "<xnat:subject_ID>{}</xnat:subject_ID>"
    given = {
        "E1": doc(subject.format("S1")),
        "E2": doc(subject.format("S2")),
        "E3": doc("<xnat:subject_ID/>"),
        "E4": doc(f"<xnat:other>{subject.format('S1')}</xnat:other>"),
        "E5": doc(subject.format("S9")),
        "E6": "<broken",
    }
    docs = items(
        spark,
        *[
            {"project": "p1", "item_type": "experiment", "id": key, "xml": xml}
            for key, xml in given.items()
        ],
    )
    mapped = id_map(
        spark,
        ("p2", "subject", "S1", "WRONG", 1),
        ("p1", "subject", "S1", "X1", 0),
        ("p3", "subject", "S9", "LATE", 2),
        ("p2", "subject", "S9", "X9", 1),
    )
    pairs = project_map(spark, ["p1", "p2", "p3"], ["d1", "d2", "d3"])
    out = rewrite.rewrite_items(docs, pairs, mapped)
    texts = dict(out.where(F.size("errors") == 0).select("id", to_xml("element")).collect())

    def done(body):
        return f'<xnat:MRSession {NS} project="d1">{body}</xnat:MRSession>'

    assert texts == {
        "E1": done(subject.format("X1")),
        "E4": done(f"<xnat:other>{subject.format('S1')}</xnat:other>"),
        # Owned elsewhere: the earliest project that maps it.
        "E5": done(subject.format("X9")),
    }
    assert rows(rewrite.rewrite_violations(out).select("check", "item_id", "detail")) == [
        ("malformed_document", "E6", None),
        ("unmapped_reference", "E2", "subject S2"),
        ("unmapped_reference", "E3", "subject "),
    ]


def test_unknown_archive_and_type(spark):
    body = '<xnat:file URI="/archive/p1/f"/>'
    docs = items(
        spark,
        {"project": "p1", "item_type": "subject", "id": "S1", "xml": f"<a {NS}>{body}</a>"},
        {"project": "p1", "item_type": "subject", "id": "S2", "xml": "<a/>"},
        {"project": "p1", "item_type": "resource", "id": "R", "xml": "<a/>"},
    )
    pairs = project_map(spark, ["p1"], src_archive="/archive")
    errors = rewrite.rewrite_violations(rewrite.rewrite_items(docs, pairs, id_map(spark)))
    assert rows(errors.select("check", "item_id")) == [
        ("archive_unknown", "S1"),
        ("type_has_no_ids", "R"),
    ]
    assert rows(root_violations(pairs).select("check", "detail")) == [
        ("archive_unknown", "dst_archive")
    ]
    with pytest.raises(ValueError, match="archive_unknown"):
        checks.require_none(root_violations(pairs))
    assert rows(checks.type_violations(docs).select("item_id")) == [("R",)]


def test_document_round_trip(spark):
    text = (
        f'<xnat:MRSession {NS} xmlns:o="urn:o" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
        ' xsi:type="xnat:mr" o:a="&lt;&quot;">a<o:b>b<o:c>c<o:d e="1">d</o:d>x&amp;<o:f/>y</o:c>z</o:b>t'
        "<!-- gone --><xnat:é>ü\n</xnat:é></xnat:MRSession>"
    )
    out = spark.createDataFrame([(text,)], "xml STRING").select(to_xml(parse_xml("xml"))).first()[0]
    assert ET.canonicalize(out, rewrite_prefixes=True) == ET.canonicalize(
        ET.tostring(ET.fromstring(text), "unicode"), rewrite_prefixes=True
    )


def test_other_scan_declares_its_namespace(spark):
    doc = {"project": "p1", "item_type": "scan", "id": "4", "xml": f"<xnat:imageScanData {NS}/>"}
    out = rewrite.rewrite_items(items(spark, doc), project_map(spark, ["p1"]), id_map(spark))
    assert out.select("element.tag").first()[0] == "xnat:OtherDicomScan"
    assert out.select(to_xml("element")).first()[0] == (
        f'<xnat:OtherDicomScan {NS} project="p1" />'
    )


def test_quick_extract_and_reconstructions(spark):
    xml = (
        f'<xnat:S {NS} ID="1"><xnat:subject_ID>S1</xnat:subject_ID>'
        "<xnat:reconstructions><xnat:r/><xnat:r/></xnat:reconstructions></xnat:S>"
    )
    df = items(spark, {"project": "p1", "item_type": "experiment", "id": "1", "xml": xml})
    quick = df.select(quick_extract(F.col("xml"), "_ID STRING, subject_ID STRING").alias("q"))
    assert rows(quick.select("q.*")) == [("1", "S1")]
    assert rows(rewrite.reconstruction_counts(parse_items(df))) == [("p1", 2)]


def profiles(spark, *pairs):
    schema = (
        "pos LONG, id LONG, username STRING, enabled BOOLEAN, email STRING, verified BOOLEAN, "
        "firstName STRING, lastName STRING"
    )
    return spark.createDataFrame(
        [(pos, id_, name, True, None, False, "f", "l") for pos, (id_, name) in enumerate(pairs)],
        schema,
    )


def test_users(spark):
    source = profiles(spark, (1, "admin"), (2, "ann"), (3, "bob#EXT#"))
    destination = profiles(spark, (1, "admin"), (2, "amy"))
    aligned = users.align_users(source, destination)
    assert rows(aligned.select("pos", "status")) == [
        (0, "match"),
        (1, "username_mismatch"),
        (2, "source_only"),
    ]
    assert rows(users.users_to_create(source, destination)) == [("bob", True, None, False, "f", "l")]
    by_name = users.users_to_create(source, destination, by="username")
    assert rows(by_name.select("username")) == [("ann",), ("bob",)]

    conflict = users.align_users(source, profiles(spark, (1, "admin"), (7, "ann"), (3, "x"), (9, "y")))
    assert rows(conflict.select("pos", "status")) == [
        (0, "match"),
        (1, "id_conflict"),
        (2, "username_mismatch"),
        (3, "destination_only"),
    ]
    assert rows(users.user_violations(conflict).select("item_id", "detail")) == [("ann", "2 != 7")]


def test_strip_ext(spark):
    df = spark.createDataFrame([("a#EXT#",), ("a#EXT##EXT#",), ("#EXT#a",), ("b",)], "u STRING")
    assert [r[0] for r in df.select(ids.strip_ext(F.col("u"))).collect()] == [
        "a",
        "a#EXT#",
        "#EXT#a",
        "b",
    ]


def subject(project, owner, id_="S1", label="L1"):
    return {
        "project": project,
        "item_type": "subject",
        "id": id_,
        "label": label,
        "owner_project": owner,
    }


def test_sharing(spark):
    pairs = project_map(spark, ["p1", "p2", "p3"], ["d1", "d2", "d3"])
    shown = items(
        spark,
        subject("p3", "p1"),
        subject("p2", "p1"),
        subject("p1", "p1"),
        # The same label elsewhere is another subject.
        subject("p2", "p2", "S2"),
        # Its owner is not migrated.
        subject("p1", "p9", "S3"),
        # It is not at the destination.
        subject("p2", "p2", "S4"),
        subject("p1", "p2", "S4"),
    )
    mapped = id_map(spark, ("p1", "subject", "S1", "X1", 0), ("p2", "subject", "S2", "X2", 1))
    groups = sharing.collect_sharing(shown, pairs).select("source_id", "owner", "projects")
    assert rows(groups.where("source_id != 'S3'")) == [
        ("S1", "d1", ["d2", "d3"]),
        ("S2", "d2", []),
        ("S4", "d2", ["d1"]),
    ]
    plan = sharing.share_plan(shown, pairs, mapped)
    assert rows(plan.select("owner", "destination_id", "project_id", "path")) == [
        ("d1", "X1", "d2", "/data/projects/d1/subjects/X1/projects/d2?label=L1"),
        ("d1", "X1", "d3", "/data/projects/d1/subjects/X1/projects/d3?label=L1"),
    ]
    lost = sharing.share_violations(shown, pairs, mapped)
    assert rows(lost.select("item_id", "detail")) == [
        ("S3", "owner_not_migrated"),
        ("S4", "no_destination_id"),
    ]


def test_share_path_escapes_on_request(spark):
    args = [F.lit(x) for x in ("assessor", "d1", "X1", "d2", "a b&c")]
    df = spark.range(1).select(paths.share_path(*args), paths.share_path(*args, escape=True))
    assert rows(df) == [
        (
            "/data/projects/d1/assessors/X1/projects/d2?label=a b&c",
            "/data/projects/d1/assessors/X1/projects/d2?label=a+b%26c",
        )
    ]


def test_files(spark):
    def listing(project, *names):
        schema = "project STRING, rel_path STRING, length LONG"
        return spark.createDataFrame([(project, name, 10) for name in names], schema)

    source = listing(
        "p1", "a.dcm", "b.log", "s/c.json", ".h/d.dcm", "x.json/e.dcm", "_u.dcm", "f.dcm", "a.LOG",
        "s.log.gz", "n.json\n",
    )
    destination = listing("d1", "f.dcm")
    pairs = project_map(spark, ["p1"], ["d1"])
    copied = files.files_to_copy(source, destination, pairs)
    assert rows(copied.select("rel_path")) == [
        ("_u.dcm",), ("a.LOG",), ("a.dcm",), ("n.json\n",), ("s.log.gz",)
    ]
    stats = files.transfer_stats(source, destination, pairs)
    assert rows(stats) == [("p1", "d1", 10, 100, 4, 40, 1, 10, 5, 50)]
    with pytest.raises(ValueError, match="names"):
        files.excluded(F.col("rel_path"), ("a/*.log",))


def test_id_namespaces(spark):
    kinds = ["project", "assessor", "scan", "file", "resource", "in_resource", "server", "reconstruction"]
    df = spark.createDataFrame([(k,) for k in kinds], "t STRING")
    assert [r[0] for r in df.select(ids.id_namespace(F.col("t"))).collect()] == [
        "project", "experiment", "scan", None, None, None, None, "reconstruction",
    ]


def test_refresh_order(spark):
    below = {"project": "D", "subject_label": "S", "experiment_label": "E"}
    held = placed(
        spark,
        {"project": "D", "item_type": "project", "id": "D", "label": "D"},
        {"project": "D", "item_type": "subject", "id": "X1", "label": "S"},
        {"project": "D", "item_type": "experiment", "id": "X2", "label": "E", "subject_label": "S"},
        {**below, "item_type": "assessor", "id": "X3", "label": "A"},
        {**below, "item_type": "scan", "id": "1", "label": "one"},
    )
    ordered = catalogs.refresh_paths(held).orderBy(
        "project",
        F.asc_nulls_last("subject_label"),
        F.asc_nulls_last("experiment_label"),
        "step",
    )
    root = "/archive/projects/D"
    assert [r[0] for r in ordered.select("path").collect()] == [
        f"{root}/subjects/S/experiments/E/scans/1",
        f"{root}/subjects/S/experiments/E/assessors/A",
        f"{root}/subjects/S/experiments/E",
        "/xapi/viewer/projects/D/experiments/X2",
        f"{root}/subjects/S",
        root,
    ]


def test_id_map_last_write_wins(spark):
    schema = (
        "seq LONG, src_project STRING, item_type STRING, map_type STRING, source_id STRING, "
        "ordinal LONG, destination_id STRING"
    )
    resolved = spark.createDataFrame(
        [
            (0, "p1", "experiment", "experiment", "E1", 1, "X1"),
            (0, "p1", "assessor", "experiment", "E1", 2, "X2"),
            (0, "p1", "assessor", "experiment", "E1", 3, None),
            (0, "p1", "resource", None, "R", 4, "X3"),
        ],
        schema,
    )
    assert rows(identity.dedupe_id_map(resolved)) == [("p1", "experiment", "E1", "X2", 0)]


def test_failures_accumulate(spark):
    pairs = project_map(spark, ["p1", "p2", "p3"])
    schema = "src_project STRING, item_type STRING, destination_id STRING"
    resolved = spark.createDataFrame(
        [("p1", "subject", None), ("p1", "subject", "X"), ("p3", "subject", None)], schema
    )
    counted = identity.running_failures(identity.failure_counts(resolved, pairs))
    shown = counted.where("item_type = 'subject'").select("seq", "failed", "failed_so_far")
    assert rows(shown) == [(0, 1, 1), (1, 0, 1), (2, 1, 2)]
    assert counted.count() == 12


def test_scan_owner_is_the_experiments(spark):
    at = {"item_type": "scan", "experiment_id": "E1", "experiment_label": "e", "subject_label": "s"}
    source = items(
        spark,
        {"project": "p1", "item_type": "experiment", "id": "E1", "owner_project": "p1"},
        {"project": "p2", "item_type": "experiment", "id": "E1", "owner_project": "p1"},
        {**at, "project": "p1", "id": "1", "owner_project": "p2"},
        {**at, "project": "p2", "id": "1", "owner_project": "p2"},
    )
    owned = owned_items(source).where("item_type = 'scan'")
    assert rows(owned.select("project", "id")) == [("p1", "1")]
    pairs = project_map(spark, ["p1"], ["d1"])
    held = placed(
        spark,
        {"project": "d1", "item_type": "scan", "id": "2", "subject_label": "s", "experiment_label": "e"},
    )
    assert missing_items(with_destination(owned, pairs), held).count() == 1


def test_unlabelled_item_is_missing(spark):
    source = items(spark, subject("p1", "p1", label=None))
    held = placed(spark, {"project": "p1", "item_type": "subject", "id": "X", "label": None})
    owned = with_destination(owned_items(source), project_map(spark, ["p1"]))
    assert missing_items(owned, held).count() == 1


def test_project_map(spark):
    pairs = project_map(
        spark, ["a", "b"], ["c", "d"], names=["C", "D"], src_files="/from", dst_files="/to"
    )
    assert rows(pairs.drop("src_archive", "dst_archive")) == [
        (0, "a", "c", "a", "C", "/from/a/", "/to/c"),
        (1, "b", "d", "b", "D", "/from/b/", "/to/d"),
    ]
    with pytest.raises(ValueError, match="length"):
        project_map(spark, ["a", "b"], ["c"])


def test_config_last_wins(spark):
    schema = "project STRING, tool STRING, path STRING, contents STRING, pos LONG"
    settings = spark.createDataFrame(
        [("p1", "t", "k", "old", 0), ("p1", "t", "k", None, 1), ("p9", "t", "k", "x", 2)], schema
    )
    plan = configs.config_plan(settings, project_map(spark, ["p1", "p2"], ["d1", "d2"]))
    assert rows(plan) == [("d1", "t", "k", None, "/data/projects/d1/config/t/k")]
