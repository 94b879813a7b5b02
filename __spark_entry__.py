"""

The archive tables the operators read are derived from the given tables in ``standin``;
names in braces in the SQL are its views.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ferryline.functions import element as el  # noqa: E402
from ferryline.functions import paths, uris  # noqa: E402
from ferryline.model import MODALITY_TAGS, OTHER_SCAN_TAG, clark  # noqa: E402
from ferryline.operators import (  # noqa: E402
    catalogs,
    checks,
    configs,
    conflicts,
    delta,
    files,
    folders,
    identity,
    items,
    locations,
    metadata,
    rewrite,
    sharing,
    users,
)
from ferryline.plans import closure, completion, migration, publish, sinks  # noqa: E402
from ferryline.session import checkpointed, shared_folder  # noqa: E402
from ferryline.sources import listings, manifest, projects  # noqa: E402
from standin import Archive, sql  # noqa: E402

# The training-data operators and their pipeline; the archive queries do without them.
_LLM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LLM_ORACLES: dict[str, str] = {}
try:
    from ferryline.llm import queries as _llm

    _LLM |= _llm.QUERIES
    _LLM_ORACLES |= _llm.ORACLE_SQL
    import corpus_pipeline as _pipeline

    _LLM["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL is not None:
        _LLM_ORACLES["pipeline"] = _pipeline.ORACLE_SQL
except ImportError as error:
    if error.name not in ("ferryline.llm", "ferryline.llm.queries", "corpus_pipeline"):
        raise

_QUERIES: dict[str, Callable[[Archive], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(name: str, text: str):
    def add(function: Callable[[Archive], DataFrame]):
        _QUERIES[name] = function
        _ORACLES[name] = text
        return function

    return add


def entry(spark: SparkSession) -> DataFrame:
    """Owned experiments the destination lacks, and where to create them."""
    return queries()["q_missing_experiments"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of session and table folder."""

    def bind(function: Callable[[Archive], DataFrame]):
        return lambda spark, sf_dir: function(Archive(spark, sf_dir))

    return {name: bind(function) for name, function in _QUERIES.items()} | _LLM


def oracle_sql() -> dict[str, str]:
    """Query name to its SQL."""
    return {name: sql(text) for name, text in _ORACLES.items()} | _LLM_ORACLES


# ---------------------------------------------------------------- checks


@_query(
    "q_missing_datatypes",
    """SELECT element_name FROM {dt_src} WHERE element_name NOT LIKE 'xdat:%'
       EXCEPT SELECT element_name FROM {dt_dst} WHERE element_name NOT LIKE 'xdat:%'""",
)
def _(a: Archive) -> DataFrame:
    return checks.missing_datatypes(a["dt_src"], a["dt_dst"])


@_query(
    "q_check_datatypes",
    """SELECT COUNT(*) = 0 AS ok, COALESCE(STRING_AGG(element_name, ',' ORDER BY element_name), '')
           AS missing
       FROM (SELECT element_name FROM {dt_src} WHERE element_name NOT LIKE 'xdat:%'
             EXCEPT SELECT element_name FROM {dt_dst})""",
)
def _(a: Archive) -> DataFrame:
    found = checks.check_datatypes(a["dt_src"], a["dt_dst"])
    return found.withColumn("missing", F.array_join("missing", ","))


@_query(
    "q_unsupported_experiments",
    """SELECT project, id, xsi_type FROM {expt}
       WHERE xsi_type NOT IN (SELECT element_name FROM {dt_schema})""",
)
def _(a: Archive) -> DataFrame:
    found = checks.unsupported_experiments(a["expt"], a["dt_schema"])
    return found.select("project", "id", "xsi_type")


@_query(
    "q_project_map",
    """SELECT s.pos AS seq, s.project AS src_project, d.project AS dst_project,
              d.project AS dst_secondary_id, d.project AS dst_name,
              '/data/from/' || s.project || '/' AS src_files,
              '/data/to/' || d.project AS dst_files
       FROM (SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS project FROM {nation}) s
       JOIN (SELECT CAST(n_nationkey AS BIGINT) AS pos, 'D_' || n_name AS project
             FROM {nation} WHERE n_nationkey < 20) d ON d.pos = s.pos""",
)
def _(a: Archive) -> DataFrame:
    pairs, _ = _paired(a)
    roots = {"src_files": "/data/from", "dst_files": "/data/to"}
    return projects.with_roots(
        pairs.withColumnsRenamed({"secondary": "dst_secondary_id"}).withColumn(
            "dst_secondary_id", F.col("dst_project")
        ).withColumn("dst_name", F.col("dst_project")),
        src_archive=None, dst_archive=None, **roots,
    ).drop("src_archive", "dst_archive")


def _paired(a: Archive) -> tuple[DataFrame, DataFrame]:
    place = F.col("n_nationkey").cast("long").alias("pos")
    source = a["nation"].select(place, F.col("n_name").alias("project"))
    destination = a["nation"].where("n_nationkey < 20").select(
        place, F.concat(F.lit("D_"), "n_name").alias("project")
    )
    return projects.pair_lists(source, destination)


@_query(
    "q_unpaired_projects",
    """SELECT 'project_not_paired' AS "check", n_name AS project, 'project' AS item_type,
              CAST(n_nationkey AS VARCHAR) AS detail
       FROM {nation} WHERE n_nationkey >= 20""",
)
def _(a: Archive) -> DataFrame:
    return _paired(a)[1].drop("item_id")


# ---------------------------------------------------------------- items


@_query(
    "q_owned_split",
    """SELECT project, item_type, COUNT(*) FILTER (project = home) AS owned,
              COUNT(*) FILTER (project <> home) AS shared
       FROM {src_items} WHERE item_type <> 'scan' GROUP BY project, item_type""",
)
def _(a: Archive) -> DataFrame:
    split = items.split_owned(a["src_items"].where("item_type <> 'scan'"))
    return split.groupBy("project", "item_type").agg(
        F.count_if("is_owner").alias("owned"), F.count_if(~F.col("is_owner")).alias("shared")
    )


@_query(
    "q_owned_scans",
    "SELECT project, experiment_id, id FROM {scan} WHERE project = home",
)
def _(a: Archive) -> DataFrame:
    rows = a["src_items"]
    scans, experiments = rows.where("item_type = 'scan'"), rows.where("item_type = 'experiment'")
    return items.owned_scans(scans, experiments).select("project", "experiment_id", "id")


def _missing(kind: str):
    def run(a: Archive) -> DataFrame:
        wanted = F.col("item_type") == kind
        if kind == "scan":
            wanted |= F.col("item_type") == "experiment"
        found = migration.missing_targets(a["src_items"].where(wanted), a["dst_before"], a["pm"])
        return found.where(F.col("item_type") == kind).select(
            "dst_project", "id", "label", "target_path"
        )

    return run


_TARGETS = {
    "projects": ("project", "'/data/projects'"),
    "subjects": ("subject", "'/data/projects/' || dst_project || '/subjects'"),
    "experiments": (
        "experiment",
        "'/data/projects/' || dst_project || '/subjects/' || subject_label || '/experiments'",
    ),
    "scans": (
        "scan",
        "'/data/projects/' || dst_project || '/subjects/' || subject_label || '/experiments/'"
        " || experiment_label || '/scans'",
    ),
    "assessors": (
        "assessor",
        "'/data/projects/' || dst_project || '/subjects/' || subject_label || '/experiments/'"
        " || experiment_label || '/assessors'",
    ),
}
for _name, (_kind, _path) in _TARGETS.items():
    _query(
        f"q_missing_{_name}",
        f"""SELECT dst_project, id, label, {_path} AS target_path FROM {{owned}} o
            WHERE item_type = '{_kind}' AND NOT EXISTS (
                SELECT 1 FROM {{dst_before}} d
                WHERE d.project = o.dst_project AND d.item_type = o.item_type
                  AND (o.item_type = 'project'
                       OR (CASE o.item_type WHEN 'scan' THEN d.id = o.id
                                            ELSE d.label = o.label END
                           AND COALESCE(d.subject_label, '') = COALESCE(o.subject_label, '')
                           AND COALESCE(d.experiment_label, '') = COALESCE(o.experiment_label, ''))))
         """,
    )(_missing(_kind))


@_query(
    "q_source_paths",
    """SELECT item_type, CASE item_type
           WHEN 'project' THEN '/data/projects/' || project
           WHEN 'subject' THEN '/data/projects/' || project || '/subjects/' || id
           WHEN 'experiment' THEN '/data/projects/' || project || '/subjects/' || subject_id
               || '/experiments/' || id
           ELSE '/data/projects/' || project || '/subjects/' || subject_id || '/experiments/'
               || experiment_id || '/' || item_type || 's/' || id END AS source_path
       FROM {src_items}""",
)
def _(a: Archive) -> DataFrame:
    columns = ("item_type", "project", "subject_id", "experiment_id", "id")
    path = paths.source_path(*[F.col(c) for c in columns])
    return a["src_items"].select("item_type", path.alias("source_path"))


# ---------------------------------------------------------------- identity


def _owned(a: Archive) -> DataFrame:
    return items.with_destination(items.owned_items(a["src_items"].drop("xml")), a["pm"])


def _id_map(a: Archive) -> DataFrame:
    return identity.build_id_map(_owned(a), a["dst_after"])


@_query(
    "q_id_map",
    """SELECT src_project, item_type, map_type, source_id, ordinal, destination_id
       FROM {resolved}""",
)
def _(a: Archive) -> DataFrame:
    return identity.resolve_ids(_owned(a), a["dst_after"]).drop("seq")


@_query(
    "q_id_map_dedup",
    "SELECT src_project, map_type, source_id, destination_id, seq FROM {id_map}",
)
def _(a: Archive) -> DataFrame:
    return _id_map(a)


_FAILURES = """
    SELECT seq, src_project, item_type, COUNT(source_id) FILTER (destination_id IS NULL) AS failed
    FROM (SELECT pm.seq, pm.src_project, t.item_type, r.source_id, r.destination_id
          FROM {pm} pm
          CROSS JOIN (VALUES ('subject'), ('experiment'), ('scan'), ('assessor')) t(item_type)
          LEFT JOIN {resolved} r ON r.src_project = pm.src_project AND r.item_type = t.item_type)
    GROUP BY seq, src_project, item_type"""


def _failures(a: Archive) -> DataFrame:
    return identity.failure_counts(identity.resolve_ids(_owned(a), a["dst_after"]), a["pm"])


@_query("q_failures", _FAILURES)
def _(a: Archive) -> DataFrame:
    return _failures(a)


@_query(
    "q_running_failures",
    f"""SELECT *, CAST(SUM(failed) OVER (PARTITION BY item_type ORDER BY seq) AS BIGINT)
            AS failed_so_far
        FROM ({_FAILURES})""",
)
def _(a: Archive) -> DataFrame:
    return identity.running_failures(_failures(a))


@_query(
    "q_subject_totals",
    """SELECT seq, src_project, COUNT(s.id) AS total_subjects
       FROM {pm} LEFT JOIN {subj} s ON project = src_project GROUP BY seq, src_project""",
)
def _(a: Archive) -> DataFrame:
    return identity.subject_totals(a["src_items"], a["pm"])


# ---------------------------------------------------------------- documents

_REMAPPED = """
    SELECT r.*, COALESCE(m.destination_id, n.any_id) AS new_id FROM {refs} r
    LEFT JOIN {id_map} m ON m.src_project = r.project AND m.map_type = r.map_type
                        AND m.source_id = r.source_id
    LEFT JOIN {id_any} n ON n.map_type = r.map_type AND n.source_id = r.source_id
                        AND r.map_type <> 'scan'"""


@_query(
    "q_remap_refs",
    f"""SELECT project, item_type, experiment_key, id, CAST(ord AS BIGINT) AS ord, map_type,
               source_id, new_id FROM ({_REMAPPED}) WHERE new_id IS NOT NULL""",
)
def _(a: Archive) -> DataFrame:
    found = rewrite.resolve_references(a["refs"], _id_map(a)).where("new_id IS NOT NULL")
    return found.withColumn("ord", F.col("ord").cast("long"))


@_query(
    "q_remap_violations",
    f"SELECT project, item_type, id, map_type, source_id FROM ({_REMAPPED}) WHERE new_id IS NULL",
)
def _(a: Archive) -> DataFrame:
    lost = rewrite.resolve_references(a["refs"], _id_map(a)).where("new_id IS NULL")
    return lost.select("project", "item_type", "id", "map_type", "source_id")


def _documents(a: Archive) -> DataFrame:
    """The items, spread out: the given tables are files that one task reads each."""
    return a["src_items"].repartition("item_type", "experiment_id", "id")


def _staged(a: Archive) -> migration.Staging:
    """A folder until the driver ends; in it the views that the others start from, whose joins are thus made once."""
    staging = migration.Staging(a.spark, shared_folder(a.spark))
    staging.remove_at_exit()
    a.keep(staging.write, "expt", "scan", "asr")
    return staging


def _tables(a: Archive, staging: migration.Staging) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return a["src_items"], a["dst_before"], a["pm"], staging.write(_id_map(a), "id_map")


def _literal_attrs(**values) -> object:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


@_query(
    "q_drop_attrs",
    """SELECT item_type, id, key, value FROM (
           SELECT item_type, id, 'ID' AS key, id AS value FROM {owned}
           WHERE item_type IN ('project', 'scan')
           UNION ALL SELECT item_type, id, 'label', label FROM {owned}
           UNION ALL SELECT item_type, id, 'project', dst_project FROM {owned})""",
)
def _(a: Archive) -> DataFrame:
    attrs = F.when(
        F.col("k") % 2 == 0,
        _literal_attrs(ID=F.col("id"), project=F.col("home"), label=F.col("label")),
    ).otherwise(_literal_attrs(label=F.col("label"), ID=F.col("id")))
    kind = F.col("item_type")
    done = el.set_project_attr(el.drop_id_attr(attrs, kind), F.col("dst_project"))
    return _owned(a).select("item_type", "id", F.explode(done))


def _children(*tags_and_texts) -> object:
    return F.array(
        *[
            F.struct(F.lit(tag).alias("tag"), text.alias("text"))
            for tag, text in tags_and_texts
        ]
    )


@_query(
    "q_drop_tags",
    """SELECT id, tag, text FROM (
           SELECT id, 'experiments' AS tag, label AS text FROM {expt}
           UNION ALL
           SELECT id, '{{http://nrg.wustl.edu/xnat}}note', xsi_type FROM {expt})""",
)
def _(a: Archive) -> DataFrame:
    dropped = ("experiments", "scans", "assessors", "reconstructions", "prearchivePath", "sharing")
    children = _children(
        ("experiments", F.col("label")),
        *[(clark(f"xnat:{tag}"), F.col("label")) for tag in dropped],
        (clark("xnat:note"), F.col("xsi_type")),
    )
    return a["expt"].select("id", F.inline(el.drop_child_tags(children)))


@_query(
    "q_retitle",
    """SELECT dst_project, part, value FROM (
           SELECT dst_project, 'ID' AS part, dst_project AS value FROM {pm}
           UNION ALL SELECT dst_project, 'secondary_ID', dst_secondary_id FROM {pm}
           UNION ALL SELECT dst_project, 'name', dst_name FROM {pm}
           UNION ALL SELECT dst_project, 'note', src_project FROM {pm})""",
)
def _(a: Archive) -> DataFrame:
    kind = F.lit("project")
    attrs = el.retitle_attrs(
        _literal_attrs(ID=F.col("src_project")), kind, F.col("dst_project"), F.col("dst_secondary_id")
    )
    children = _children(
        (clark("xnat:name"), F.col("src_project")), (clark("xnat:note"), F.col("src_project"))
    )
    titled = el.retitle_children(children, kind, F.col("dst_name"))
    texts = F.transform(
        titled,
        lambda c: F.struct(
            F.regexp_replace(c["tag"], r"\{.*\}", "").alias("part"), c["text"].alias("value")
        ),
    )
    pairs = F.transform(
        F.map_entries(attrs), lambda e: F.struct(e["key"].alias("part"), e["value"].alias("value"))
    )
    return a["pm"].select("dst_project", F.inline(F.concat(pairs, texts)))


@_query(
    "q_rewrite_uri",
    """SELECT doc_id, CASE WHEN INSTR(uri, src) > 0
           THEN SUBSTR(uri, 1, INSTR(uri, src) - 1) || dst
                || SUBSTR(uri, INSTR(uri, src) + LENGTH(src))
           ELSE uri END AS uri,
           CASE WHEN INSTR(uri || '/', src || '/') > 0
           THEN SUBSTR(uri, 1, INSTR(uri || '/', src || '/') - 1) || dst
                || SUBSTR(uri, INSTR(uri || '/', src || '/') + LENGTH(src))
           ELSE uri END AS bounded_uri
       FROM {uris}""",
)
def _(a: Archive) -> DataFrame:
    args = F.col("uri"), F.col("src"), F.col("dst")
    return a["uris"].select(
        "doc_id",
        uris.rewrite_uri(*args).alias("uri"),
        uris.rewrite_uri(*args, bounded=True).alias("bounded_uri"),
    )


@_query(
    "q_uri_violations",
    "SELECT doc_id, project, uri FROM {uris} WHERE INSTR(uri, src) = 0",
)
def _(a: Archive) -> DataFrame:
    bad = uris.uri_mismatch(F.col("uri"), F.col("src"))
    return a["uris"].where(bad).select("doc_id", "project", "uri")


@_query(
    "q_item_uris",
    """SELECT doc_id, place,
              CASE WHEN place IN ('file', 'out/file', 'resources/resource') AND INSTR(uri, src) > 0
                   THEN SUBSTR(uri, 1, INSTR(uri, src) - 1) || dst
                        || SUBSTR(uri, INSTR(uri, src) + LENGTH(src))
                   ELSE uri END AS uri
       FROM {uris} CROSS JOIN (VALUES ('file'), ('note'), ('out/file'), ('out/note'), ('in/file'),
           ('resources/resource'), ('resources/file')) t(place)""",
)
def _(a: Archive) -> DataFrame:
    # Every child and grandchild has the attribute; only some of them are file locations.
    attrs = "MAP('URI', uri)"

    def child(tag: str, *kids: str) -> str:
        inner = ", ".join(
            f"NAMED_STRUCT('tag', '{clark('xnat:' + kid)}', 'attrs', {attrs})" for kid in kids
        )
        none = "ARRAY(NAMED_STRUCT('tag', CAST(NULL AS STRING), 'attrs', MAP('URI', uri)))"
        return (
            f"NAMED_STRUCT('tag', '{clark('xnat:' + tag)}', 'attrs', {attrs}, "
            f"'kids', {f'ARRAY({inner})' if inner else none})"
        )

    shape = [
        child("file"),
        child("note"),
        child("out", "file", "note"),
        child("in", "file"),
        child("resources", "resource", "file"),
    ]
    moved = a["uris"].select(
        "doc_id",
        el.rewrite_item_uris(
            F.expr(f"ARRAY({', '.join(shape)})"), F.col("src"), F.col("dst")
        ).alias("children"),
    )
    local = "REGEXP_REPLACE({}, '[{{].*[}}]', '')"
    return moved.selectExpr("doc_id", "INLINE(children) AS (tag, attrs, kids)").selectExpr(
        "doc_id",
        f"""INLINE(CASE WHEN kids[0].tag IS NULL
                THEN ARRAY(STRUCT({local.format('tag')} AS place, attrs['URI'] AS uri))
                ELSE TRANSFORM(kids, x -> STRUCT({local.format('tag')} || '/'
                     || {local.format('x.tag')} AS place, x.attrs['URI'] AS uri)) END)""",
    )


_SCAN_TAG = " ".join(
    f"WHEN {column} = 1 THEN '{MODALITY_TAGS[name].replace('{', '{{').replace('}', '}}')}'"
    for name, column in (("MR", "mr"), ("CT", "ct"))
)


@_query(
    "q_scan_tag",
    f"""SELECT project, experiment_id, id,
               CASE WHEN mr + ct + xx <> 1 THEN '{OTHER_SCAN_TAG}' {_SCAN_TAG}
                    ELSE '{OTHER_SCAN_TAG}' END AS tag
        FROM {{scan}}""",
)
def _(a: Archive) -> DataFrame:
    texts = F.concat(
        F.array_repeat(F.lit("MR"), F.col("mr").cast("int")),
        F.array_repeat(F.lit("CT"), F.col("ct").cast("int")),
        F.array_repeat(F.lit("XX"), F.col("xx").cast("int")),
        F.array(F.lit(""), F.lit(None)),
    )
    tag = el.scan_tag(F.lit(clark("xnat:imageScanData")), texts)
    return a["scan"].select("project", "experiment_id", "id", tag.alias("tag"))


_HEAD = "xmlns:xnat=\"http://nrg.wustl.edu/xnat\""
# Owned items with the ids their documents refer to; what is still to be created is pending.
_EXPECTED = "SELECT * FROM {expected}"


# Rows of the plan with their documents as text, but for the choice of items.
_PAYLOADS = f"""SELECT dst_project, e.item_type, e.id AS source_id, e.label,
            CASE e.item_type
            WHEN 'project' THEN '<xnat:Project {_HEAD} ID="' || dst_project || '" secondary_ID="'
                || dst_secondary_id || '" project="' || dst_project || '"><xnat:name>' || dst_name
                || '</xnat:name></xnat:Project>'
            WHEN 'subject' THEN '<xnat:Subject {_HEAD} project="' || dst_project || '" label="'
                || e.label || '" />'
            WHEN 'experiment' THEN '<xnat:MRSession {_HEAD} project="' || dst_project
                || '"><xnat:subject_ID>' || COALESCE(new_subject, e.subject_id) || '</xnat:subject_ID><xnat:resources>'
                || '<xnat:resource URI="/new/' || dst_project || '/r' || CAST(e.k AS VARCHAR)
                || '" /></xnat:resources></xnat:MRSession>'
            WHEN 'scan' THEN '<xnat:' || tag || ' {_HEAD} ID="' || e.id || '" project="'
                || dst_project || '"><xnat:image_session_ID>' || COALESCE(new_experiment, e.experiment_id)
                || '</xnat:image_session_ID>'
                || REPEAT('<xnat:modality>MR</xnat:modality>', CAST(mr AS INT))
                || REPEAT('<xnat:modality>CT</xnat:modality>', CAST(ct AS INT))
                || REPEAT('<xnat:modality>XX</xnat:modality>', CAST(xx AS INT))
                || '<xnat:modality /><xnat:file URI="/new/' || dst_project || '/' || e.id
                || '.dcm" /></xnat:' || tag || '>'
            ELSE '<xnat:Assessor {_HEAD} label="' || e.label || '" project="' || dst_project
                || '"><xnat:imageSession_ID>' || COALESCE(new_experiment, e.experiment_id)
                || '</xnat:imageSession_ID>'
                || '<xnat:scanID>' || COALESCE(new_scan, '1') || '</xnat:scanID><xnat:in><xnat:file URI="/else" />'
                || '</xnat:in><xnat:out><xnat:file URI="/new/' || dst_project
                || '/a"><xnat:note q="1">t</xnat:note></xnat:file></xnat:out></xnat:Assessor>' END
            AS payload_xml,
            CASE e.item_type WHEN 'project' THEN 0 WHEN 'subject' THEN 1 WHEN 'experiment' THEN 2
                ELSE 3 END AS level,
            CASE WHEN CASE e.item_type WHEN 'experiment' THEN new_subject IS NULL
                WHEN 'scan' THEN new_experiment IS NULL
                WHEN 'assessor' THEN new_experiment IS NULL OR new_scan IS NULL ELSE FALSE END
                THEN 'waiting' ELSE 'ready' END AS status
        FROM ({_EXPECTED}) e
        LEFT JOIN (SELECT project, experiment_id, id, mr, ct, xx,
                          CASE WHEN mr + ct + xx = 1 AND mr = 1 THEN 'MRScan'
                               WHEN mr + ct + xx = 1 AND ct = 1 THEN 'CTScan'
                               ELSE 'OtherDicomScan' END AS tag FROM {{scan}}) s
            ON e.item_type = 'scan' AND s.project = e.project
               AND s.experiment_id = e.experiment_id AND s.id = e.id"""


@_query(
    "q_xml_roundtrip",
    f"""{_PAYLOADS}
        WHERE e.k % 3 <> 0 AND CASE e.item_type
            WHEN 'experiment' THEN (new_subject IS NOT NULL OR due_subject) AND e.k % 19 <> 0
            WHEN 'scan' THEN new_experiment IS NOT NULL OR due_experiment
            WHEN 'assessor' THEN (new_experiment IS NOT NULL OR due_experiment)
                AND (new_scan IS NOT NULL OR due_scan)
            ELSE TRUE END""",
)
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    plan, _ = migration.create_plan(*_tables(a, staging), staging=staging)
    return plan.drop("target_path", "pending", "project", "experiment_id")


@_query(
    "q_rewrite_violations",
    f"""SELECT 'unmapped_reference' AS "check", project, item_type, id AS item_id,
               CASE item_type WHEN 'experiment' THEN 'subject ' || subject_id
                              ELSE 'experiment ' || experiment_id END AS detail
        FROM ({_EXPECTED}) e
        WHERE CASE item_type WHEN 'experiment' THEN new_subject IS NULL AND NOT due_subject
                             WHEN 'scan' THEN new_experiment IS NULL AND NOT due_experiment
                             WHEN 'assessor' THEN new_experiment IS NULL AND NOT due_experiment
                             ELSE FALSE END
        UNION ALL
        SELECT 'unmapped_reference', project, item_type, id, 'scan 1' FROM ({_EXPECTED}) e
        WHERE item_type = 'assessor' AND new_scan IS NULL AND NOT due_scan
        UNION ALL
        SELECT 'uri_outside_source', project, item_type, id,
               '/archive/lost/r' || CAST(k AS VARCHAR)
        FROM {{owned}} WHERE item_type = 'experiment' AND k % 19 = 0""",
)
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    return migration.create_plan(*_tables(a, staging), staging=staging)[1]


@_query(
    "q_first_run",
    """SELECT 'create' AS part, item_type, CASE item_type WHEN 'project' THEN 'ready'
              WHEN 'subject' THEN 'ready' ELSE 'waiting' END AS detail, COUNT(*) AS n
       FROM {owned} o
       WHERE CASE item_type
             WHEN 'experiment' THEN k % 19 <> 0 AND subject_id IN
                 (SELECT id FROM {owned} WHERE item_type = 'subject')
             WHEN 'scan' THEN experiment_id IN
                 (SELECT id FROM {owned} WHERE item_type IN ('experiment', 'assessor'))
             WHEN 'assessor' THEN experiment_id IN
                 (SELECT id FROM {owned} WHERE item_type IN ('experiment', 'assessor'))
                 AND project IN (SELECT project FROM {owned} WHERE item_type = 'scan' AND id = '1')
             ELSE TRUE END
       GROUP BY item_type
       UNION ALL
       SELECT 'violation', item_type, "check", COUNT(*) FROM (
           SELECT item_type, 'uri_outside_source' AS "check" FROM {owned}
           WHERE item_type = 'experiment' AND k % 19 = 0
           UNION ALL
           SELECT item_type, 'unmapped_reference' FROM {owned}
           WHERE item_type = 'experiment'
             AND subject_id NOT IN (SELECT id FROM {owned} WHERE item_type = 'subject')
           UNION ALL
           SELECT item_type, 'unmapped_reference' FROM {owned}
           WHERE item_type IN ('scan', 'assessor') AND experiment_id NOT IN
               (SELECT id FROM {owned} WHERE item_type IN ('experiment', 'assessor'))
           UNION ALL
           SELECT item_type, 'unmapped_reference' FROM {owned}
           WHERE item_type = 'assessor' AND project NOT IN
               (SELECT project FROM {owned} WHERE item_type = 'scan' AND id = '1')) v
       GROUP BY ALL""",
)
def _(a: Archive) -> DataFrame:
    """An empty destination: the whole tree is planned at once."""
    staging = _staged(a)
    plan, errors = migration.create_plan(*_empty_destination(a, a["src_items"]), staging=staging)
    found = plan.select(F.lit("create").alias("part"), "item_type", F.col("status").alias("detail"))
    failed = errors.select(F.lit("violation").alias("part"), "item_type", F.col("check").alias("detail"))
    rows = found.unionByName(failed).groupBy("part", "item_type", "detail")
    return rows.agg(F.count(F.lit(1)).alias("n"))


def _without_owners(a: Archive) -> DataFrame:
    """A listing that names no owner for a third of the items; assessors' documents do not either."""
    missing = F.when(F.col("k") % 3 != 0, F.col("owner_project"))
    return a["src_items"].withColumn("owner_project", missing)


@_query(
    "q_document_owners",
    """SELECT project, item_type, id, CASE WHEN k % 3 <> 0 OR item_type <> 'assessor' THEN home
              END AS owner_project
       FROM {src_items} WHERE item_type IN ('subject', 'experiment', 'assessor')""",
)
def _(a: Archive) -> DataFrame:
    known = items.with_owner(_without_owners(a))
    known = known.where(F.col("item_type").isin("subject", "experiment", "assessor"))
    return known.select("project", "item_type", "id", "owner_project")


@_query(
    "q_owner_violations",
    """SELECT 'owner_unknown' AS "check", project, item_type, id AS item_id
       FROM {src_items} JOIN {pm} ON src_project = project
       WHERE item_type = 'assessor' AND k % 3 = 0""",
)
def _(a: Archive) -> DataFrame:
    return items.owner_violations(items.with_owner(_without_owners(a)), a["pm"]).drop("detail")


@_query(
    "q_plan_contents",
    f"""SELECT item_type, COUNT(*) AS n, SUM(LENGTH(payload_xml)) AS chars,
               MIN(MD5(payload_xml)) AS least, MAX(MD5(payload_xml)) AS most
        FROM ({_ORACLES['q_xml_roundtrip']}) GROUP BY item_type""",
)
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    plan, _ = migration.create_plan(*_tables(a, staging), staging=staging)
    digest = F.md5("payload_xml")
    return plan.groupBy("item_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("payload_xml")).cast("decimal(38,0)").alias("chars"),
        F.min(digest).alias("least"),
        F.max(digest).alias("most"),
    )


# ---------------------------------------------------------------- sharing

_VISITS = """
    SELECT item_type, id AS source_id, label, home, seq, dst_project
    FROM {src_items} JOIN {pm} ON src_project = project
    WHERE item_type IN ('subject', 'experiment', 'assessor')"""


@_query(
    "q_share_groups",
    f"""SELECT item_type, source_id,
               MAX(label) FILTER (dst_project = 'D_' || home) AS label,
               MAX(dst_project) FILTER (dst_project = 'D_' || home) AS owner,
               COALESCE(STRING_AGG(dst_project, ',' ORDER BY seq)
                   FILTER (dst_project <> 'D_' || home), '') AS projects
        FROM ({_VISITS}) GROUP BY item_type, source_id""",
)
def _(a: Archive) -> DataFrame:
    groups = sharing.collect_sharing(a["src_items"], a["pm"])
    return groups.withColumn("projects", F.array_join("projects", ","))


@_query(
    "q_share_plan",
    f"""SELECT v.item_type, o.dst_project AS owner, any_id AS destination_id,
               v.dst_project AS project_id, v.label,
               '/data/projects/' || o.dst_project || '/' || v.item_type || 's/' || any_id
                   || '/projects/' || v.dst_project || '?label=' || v.label AS path
        FROM ({_VISITS}) v JOIN {{pm}} o ON o.src_project = v.home
        JOIN {{id_any}} m ON m.source_id = v.source_id
            AND m.map_type = CASE v.item_type WHEN 'subject' THEN 'subject' ELSE 'experiment' END
        WHERE v.dst_project <> o.dst_project""",
)
def _(a: Archive) -> DataFrame:
    return sharing.share_plan(a["src_items"], a["pm"], _id_map(a))


@_query(
    "q_share_violations",
    f"""SELECT v.dst_project AS project, v.item_type, v.source_id AS item_id,
               CASE WHEN o.dst_project IS NULL THEN 'owner_not_migrated'
                    ELSE 'no_destination_id' END AS detail
        FROM ({_VISITS}) v LEFT JOIN {{pm}} o ON o.src_project = v.home
        LEFT JOIN {{id_any}} m ON m.source_id = v.source_id
            AND m.map_type = CASE v.item_type WHEN 'subject' THEN 'subject' ELSE 'experiment' END
        WHERE v.dst_project <> 'D_' || v.home AND (o.dst_project IS NULL OR any_id IS NULL)""",
)
def _(a: Archive) -> DataFrame:
    found = sharing.share_violations(a["src_items"], a["pm"], _id_map(a))
    return found.drop("check")


# ---------------------------------------------------------------- users and settings


@_query(
    "q_align_users",
    """SELECT COALESCE(s.pos, d.pos) AS pos, s.id AS source_id, s.username AS source_username,
              d.id AS destination_id, d.username AS destination_username,
              CASE WHEN d.pos IS NULL THEN 'source_only' WHEN s.pos IS NULL THEN 'destination_only'
                   WHEN s.id <> d.id THEN 'id_conflict'
                   WHEN s.username <> d.username THEN 'username_mismatch'
                   ELSE 'match' END AS status
       FROM {usr_src} s FULL JOIN {usr_dst} d ON d.pos = s.pos""",
)
def _(a: Archive) -> DataFrame:
    return users.align_users(a["usr_src"], a["usr_dst"])


_PAYLOAD = """CASE WHEN username LIKE '%#EXT#' THEN SUBSTR(username, 1, LENGTH(username) - 5)
                   ELSE username END AS username, enabled, email, verified, firstName, lastName"""


@_query(
    "q_users_to_create",
    f"""SELECT {_PAYLOAD} FROM {{usr_src}}
        WHERE pos >= (SELECT COUNT(*) FROM {{usr_dst}})""",
)
def _(a: Archive) -> DataFrame:
    return users.users_to_create(a["usr_src"], a["usr_dst"])


@_query(
    "q_users_by_name",
    f"""SELECT {_PAYLOAD} FROM {{usr_src}}
        WHERE CASE WHEN username LIKE '%#EXT#' THEN SUBSTR(username, 1, LENGTH(username) - 5)
                   ELSE username END NOT IN (SELECT username FROM {{usr_dst}})""",
)
def _(a: Archive) -> DataFrame:
    return users.users_to_create(a["usr_src"], a["usr_dst"], by="username")


@_query(
    "q_config_plan",
    """SELECT dst_project, tool, path, contents,
              '/data/projects/' || dst_project || '/config/' || tool || '/' || path AS target_path
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dst_project, tool, path
                                          ORDER BY event_id DESC) AS rn
             FROM (SELECT n_name AS project, event_id, event_type AS tool,
                          'k' || CAST(user_id % 4 AS VARCHAR) AS path,
                          CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) AS contents
                   FROM {events} JOIN {nation} ON n_nationkey = user_id % 25
                   UNION ALL
                   SELECT n_name, event_id, event_type, 'raw',
                          event_type || CAST(event_id AS VARCHAR)
                   FROM {events} JOIN {nation} ON n_nationkey = user_id % 25) c
             JOIN {pm} ON src_project = project)
       WHERE rn = 1""",
)
def _(a: Archive) -> DataFrame:
    opened = listings.unwrap_resultset(
        a["cfg_listing"], "listing", "path: STRING, contents: STRING"
    )
    settings = opened.withColumn("pos", F.col("event_id") * 2 + F.col("pos"))
    # Tools as a listing has them, in an order of its own and each of them twice.
    tools = settings.groupBy("project", "tool").agg(F.max("event_id").alias("pos"))
    tools = tools.unionByName(tools.withColumn("pos", F.col("pos") % 7))
    return configs.config_plan(listings.config_settings(tools, settings), a["pm"])


# ---------------------------------------------------------------- files and catalogues

_WANTED = """
    SELECT f.project, dst_project, f.rel_path, f.length,
           REGEXP_MATCHES(f.rel_path, '(^|/)([^/]*[.]log|[.][^/]*|[^/]*[.]json)(/|$)') AS is_excluded,
           d.rel_path IS NOT NULL AS is_held
    FROM {files_src} f JOIN {fpm} ON src_project = f.project
    LEFT JOIN {files_dst} d ON d.project = dst_project AND d.rel_path = f.rel_path"""


@_query(
    "q_files_to_copy",
    f"""SELECT project, dst_project, rel_path, length FROM ({_WANTED})
        WHERE NOT is_excluded AND NOT is_held""",
)
def _(a: Archive) -> DataFrame:
    return files.files_to_copy(a["files_src"], a["files_dst"], a["fpm"])


@_query(
    "q_transfer_stats",
    f"""SELECT project, dst_project, COUNT(*) AS files, CAST(SUM(length) AS BIGINT) AS bytes,
               COUNT(*) FILTER (is_excluded) AS files_excluded,
               CAST(COALESCE(SUM(length) FILTER (is_excluded), 0) AS BIGINT) AS bytes_excluded,
               COUNT(*) FILTER (NOT is_excluded AND is_held) AS files_existing,
               CAST(COALESCE(SUM(length) FILTER (NOT is_excluded AND is_held), 0) AS BIGINT)
                   AS bytes_existing,
               COUNT(*) FILTER (NOT is_excluded AND NOT is_held) AS files_to_copy,
               CAST(COALESCE(SUM(length) FILTER (NOT is_excluded AND NOT is_held), 0) AS BIGINT)
                   AS bytes_to_copy
        FROM ({_WANTED}) GROUP BY project, dst_project""",
)
def _(a: Archive) -> DataFrame:
    return files.transfer_stats(a["files_src"], a["files_dst"], a["fpm"])


_BELOW = "'/archive/projects/' || project || '/subjects/' || subject_label || '/experiments/'"


@_query(
    "q_refresh_paths",
    f"""SELECT project, CAST(depth AS BIGINT) AS depth, CAST(step AS BIGINT) AS step, action, path
        FROM (
        SELECT project, 3 AS depth, 0 AS step, 'refresh' AS action,
               {_BELOW} || experiment_label || '/scans/' || id AS path
        FROM {{dst_after}} WHERE item_type = 'scan'
        UNION ALL SELECT project, 3, 1, 'refresh', {_BELOW} || experiment_label || '/assessors/' || label
        FROM {{dst_after}} WHERE item_type = 'assessor'
        UNION ALL SELECT project, 2, 2, 'refresh', {_BELOW} || label
        FROM {{dst_after}} WHERE item_type = 'experiment'
        UNION ALL SELECT project, 2, 3, 'viewer',
               '/xapi/viewer/projects/' || project || '/experiments/' || id
        FROM {{dst_after}} WHERE item_type = 'experiment'
        UNION ALL SELECT project, 1, 4, 'refresh', '/archive/projects/' || project || '/subjects/' || label
        FROM {{dst_after}} WHERE item_type = 'subject'
        UNION ALL SELECT project, 0, 5, 'refresh', '/archive/projects/' || project
        FROM {{dst_after}} WHERE item_type = 'project')""",
)
def _(a: Archive) -> DataFrame:
    found = catalogs.refresh_paths(a["dst_after"])
    return found.select(
        "project", F.col("depth").cast("long").alias("depth"),
        F.col("step").cast("long").alias("step"), "action", "path",
    )


@_query(
    "q_catalog_stats",
    """SELECT CASE GROUPING(subject, experiment, leaf) WHEN 7 THEN 'project' WHEN 3 THEN 'subject'
                   WHEN 1 THEN 'experiment' ELSE 'leaf' END AS level,
              project, subject, experiment, leaf, COUNT(*) AS files,
              CAST(SUM(length) AS BIGINT) AS bytes
       FROM {tree} GROUP BY GROUPING SETS ((project), (project, subject),
           (project, subject, experiment), (project, subject, experiment, leaf))""",
)
def _(a: Archive) -> DataFrame:
    return catalogs.catalog_stats(a["tree"])


@_query(
    "q_catalog_reconcile",
    """SELECT COALESCE(f.project, c.project) AS project, COALESCE(f.rel_path, c.rel_path) AS rel_path,
              CASE WHEN c.project IS NULL THEN 'append' WHEN f.project IS NULL THEN 'delete'
                   WHEN f.checksum IS DISTINCT FROM c.checksum THEN 'rechecksum'
                   ELSE 'keep' END AS action,
              c.checksum AS old_checksum, f.checksum AS new_checksum
       FROM {files_src} f FULL JOIN {listed} c ON c.project = f.project AND c.rel_path = f.rel_path""",
)
def _(a: Archive) -> DataFrame:
    return catalogs.catalog_reconcile(a["listed"], a["files_src"])


# ---------------------------------------------------------------- what waits in vain, and what has come


def _broken(a: Archive) -> DataFrame:
    """The items, of each type some with a document that no one can read."""
    bad = F.expr("""CASE item_type WHEN 'project' THEN k % 9 = 4 WHEN 'subject' THEN k % 23 = 0
                    WHEN 'experiment' THEN k % 31 = 0 WHEN 'scan' THEN k % 29 = 0 ELSE k % 37 = 0 END""")
    return a["src_items"].withColumn("xml", F.when(bad, "<broken").otherwise(F.col("xml")))


def _empty_destination(a: Archive, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return rows, a["dst_before"].limit(0), a["pm"], _id_map(a).limit(0)


@_query(
    "q_blocked",
    """SELECT * FROM (WITH RECURSIVE o AS (
           SELECT project, item_type, COALESCE(experiment_id, '') AS experiment_key, id, subject_id, experiment_id,
                  CASE WHEN item_type IN ('project', 'scan') THEN project ELSE '' END AS within,
                  CASE item_type WHEN 'scan' THEN experiment_id ELSE '' END AS inside,
                  CASE item_type WHEN 'assessor' THEN 'experiment' ELSE item_type END AS map_type,
                  CASE WHEN CASE item_type WHEN 'project' THEN k % 9 = 4 WHEN 'subject' THEN k % 23 = 0
                            WHEN 'experiment' THEN k % 31 = 0 WHEN 'scan' THEN k % 29 = 0 ELSE k % 37 = 0 END
                       THEN 'malformed_document'
                       WHEN item_type = 'assessor' AND project NOT IN
                            (SELECT project FROM {owned} WHERE item_type = 'scan' AND id = '1') THEN 'unmapped_reference'
                       WHEN item_type = 'experiment' AND k % 19 = 0 THEN 'uri_outside_source' END AS failed
           FROM {owned}),
       needs AS (
           SELECT project, item_type, experiment_key, id, within, inside, map_type,
                  project AS n_within, '' AS n_inside, 'project' AS n_type, project AS n_id
           FROM o WHERE failed IS NULL AND item_type IN ('subject', 'experiment')
           UNION ALL SELECT project, item_type, experiment_key, id, within, inside, map_type, '', '', 'subject', subject_id
           FROM o WHERE failed IS NULL AND item_type = 'experiment'
           UNION ALL SELECT project, item_type, experiment_key, id, within, inside, map_type, '', '', 'experiment', experiment_id
           FROM o WHERE failed IS NULL AND item_type IN ('scan', 'assessor')
           UNION ALL SELECT project, item_type, experiment_key, id, within, inside, map_type, project, experiment_id, 'scan', '1'
           FROM o WHERE failed IS NULL AND item_type = 'assessor'),
       r AS (
           SELECT project, item_type, experiment_key, id, within, inside, map_type, 0 AS distance,
                  item_type AS cause_type, id AS cause_id, failed AS cause FROM o WHERE failed IS NOT NULL
           UNION
           SELECT n.project, n.item_type, n.experiment_key, n.id, n.within, n.inside, n.map_type, r.distance + 1,
                  r.cause_type, r.cause_id, r.cause
           FROM needs n JOIN r ON r.within = n_within AND r.inside = n_inside AND r.map_type = n_type AND r.id = n_id)
       SELECT project, item_type, experiment_key, id, cause_type, cause_id, cause, distance FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY project, item_type, experiment_key, id
                                        ORDER BY distance, cause_type, cause_id, cause) AS rn FROM r)
       WHERE rn = 1 AND distance > 0)""",
)
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    rewritten = migration.rewritten_items(*_empty_destination(a, _broken(a)), staging=staging)
    return closure.blocked_items(rewritten, keep=staging.write)


@_query(
    "q_completed_plan",
    f"""{_PAYLOADS}
        WHERE CASE e.item_type
            WHEN 'experiment' THEN e.k % 19 <> 0
                AND e.subject_id IN (SELECT id FROM {{owned}} WHERE item_type = 'subject')
            WHEN 'scan' THEN e.experiment_id IN (SELECT id FROM {{owned}} WHERE item_type IN ('experiment', 'assessor'))
            WHEN 'assessor' THEN
                e.experiment_id IN (SELECT id FROM {{owned}} WHERE item_type IN ('experiment', 'assessor'))
                AND e.project IN (SELECT project FROM {{owned}} WHERE item_type = 'scan' AND id = '1')
            ELSE TRUE END""",
)
def _(a: Archive) -> DataFrame:
    """Planned for an empty destination, then completed with the ids it has afterwards."""
    staging = _staged(a)
    plan, _ = migration.create_plan(*_empty_destination(a, a["src_items"]), staging=staging)
    plan = staging.write(plan, "plan")
    staging.drop("judged")
    done = completion.complete_plan(plan, staging.write(_id_map(a), "id_map"), keep=staging.write)
    return done.drop("target_path", "pending", "project", "experiment_id")


_CHANGED = "(e.k % 4 = 0 OR e.k % 10 = 3)"


@_query("q_delta_plan", f"{_ORACLES['q_xml_roundtrip']} AND {_CHANGED}")
def _(a: Archive) -> DataFrame:
    """A fourth of the items had another document or date when the snapshot was taken, others were not there."""
    staging = _staged(a)
    rows, kind = a["src_items"], F.col("item_type")
    dates = a["meta"].select("project", "resource", "ID", "last_modified")
    dated = kind.isin("subject", "experiment")
    older = rows.where("k % 10 <> 3").withColumn(
        "xml", F.when((F.col("k") % 4 == 0) & ~dated, F.concat("xml", F.lit(" "))).otherwise(F.col("xml"))
    )
    old_dates = dates.withColumn(
        "last_modified",
        F.when(F.expr("CAST(last_modified AS BIGINT) % 4 = 0"), "earlier").otherwise(F.col("last_modified")),
    )
    changed = delta.changed_items(delta.item_snapshot(rows, dates), delta.item_snapshot(older, old_dates))
    changed = staging.write(changed, "changed")
    plan, _ = migration.create_plan(*_tables(a, staging), only=changed, staging=staging)
    return plan.drop("target_path", "pending", "project", "experiment_id")


@_query(
    "q_delta_items",
    """SELECT project, item_type, COALESCE(experiment_id, '') AS experiment_key, id, 'gone' AS change
       FROM {src_items} WHERE k % 10 = 3
       UNION ALL
       SELECT project, item_type, COALESCE(experiment_id, ''), id, 'changed'
       FROM {src_items} WHERE k % 10 <> 3 AND k % 4 = 0""",
)
def _(a: Archive) -> DataFrame:
    """The other way round: what was there before and is not, and what has another label now."""
    staging = _staged(a)
    rows = a["src_items"]
    now = rows.where("k % 10 <> 3").withColumn(
        "label", F.when(F.col("k") % 4 == 0, "renamed").otherwise(F.col("label"))
    )
    before, after = delta.item_snapshot(rows), delta.item_snapshot(now)
    gone = staging.write(delta.gone_items(after, before).withColumn("change", F.lit("gone")), "gone")
    return gone.unionByName(staging.write(delta.changed_items(after, before), "changed"))


def _merged(a: Archive) -> tuple[DataFrame, DataFrame]:
    """Owned items whose projects go three to one, with labels that recur, and a destination with such labels too."""
    label = "CASE item_type WHEN 'subject' THEN 'L' || CAST(k % 40 AS STRING) ELSE 'E' || CAST(k % 3 AS STRING) END"
    rows = a["src_items"].drop("xml").withColumn("label", F.expr(label))
    pairs = a["pm"].withColumn("dst_project", F.expr("'D_' || CAST(seq % 7 AS STRING)"))
    held = a["dst_all"].withColumn("label", F.expr(label)).drop("k")
    return items.with_destination(items.owned_items(rows), pairs), held


_LABEL = "CASE item_type WHEN 'subject' THEN 'L' || CAST(k % 40 AS VARCHAR) ELSE 'E' || CAST(k % 3 AS VARCHAR) END"
_PLACE = """item_type,
            CASE WHEN item_type IN ('experiment', 'scan', 'assessor') THEN subject_label ELSE '' END AS place_subject,
            CASE WHEN item_type IN ('scan', 'assessor') THEN experiment_label ELSE '' END AS place_experiment,
            CASE item_type WHEN 'project' THEN '' WHEN 'scan' THEN id ELSE label END AS place_name"""
_CLAIMS = f"""
    SELECT 'source' AS side, 'D_' || CAST(seq % 7 AS VARCHAR) AS dst_project, {_PLACE.replace('ELSE label', f'ELSE {_LABEL}')},
           project, item_type AS kind, COALESCE(experiment_id, '') AS experiment_key, id FROM {{owned}}
    UNION ALL
    SELECT 'destination', project, {_PLACE.replace('ELSE label', f'ELSE {_LABEL}')}, project, item_type, '', id
    FROM {{dst_all}}"""
_CROWDED = f"""
    SELECT side, dst_project, item_type, place_subject, place_experiment, place_name, COUNT(*) AS n,
           MIN([project, experiment_key, id]) AS least, MAX([project, experiment_key, id]) AS greatest
    FROM ({_CLAIMS}) c GROUP BY ALL HAVING least <> greatest"""


@_query(
    "q_place_conflicts",
    f"""SELECT side, dst_project, item_type, place_subject, place_experiment, place_name, n,
               ARRAY_TO_STRING(least, '|') AS least, ARRAY_TO_STRING(greatest, '|') AS greatest FROM ({_CROWDED})""".replace(
        "GROUP BY ALL", "GROUP BY side, dst_project, item_type, place_subject, place_experiment, place_name"
    ),
)
def _(a: Archive) -> DataFrame:
    told = conflicts.place_conflicts(*_merged(a))
    parts = {c: F.concat_ws("|", f"{c}.project", f"{c}.experiment_key", f"{c}.id") for c in ("least", "greatest")}
    return told.withColumns(parts)


@_query(
    "q_conflict_violations",
    f"""SELECT * FROM (WITH crowded AS ({_CROWDED}), claims AS ({_CLAIMS})
        SELECT CASE c.side WHEN 'source' THEN 'place_claimed_twice' ELSE 'place_held_twice' END AS "check", o.project,
               o.item_type, o.id AS item_id,
               CONCAT_WS('/', o.dst_project, NULLIF(o.place_subject, ''), NULLIF(o.place_experiment, ''),
                         NULLIF(o.place_name, '')) AS detail
        FROM claims o JOIN crowded c ON c.dst_project = o.dst_project AND c.item_type = o.item_type
             AND c.place_subject = o.place_subject AND c.place_experiment = o.place_experiment
             AND c.place_name = o.place_name
        WHERE o.side = 'source')""".replace(
        "GROUP BY ALL", "GROUP BY side, dst_project, item_type, place_subject, place_experiment, place_name"
    ),
)
def _(a: Archive) -> DataFrame:
    return conflicts.conflict_violations(*_merged(a))


_LOCATIONS = """
    SELECT doc_id, source AS project, CASE doc_id % 7
           WHEN 0 THEN '/archive/' || source || '/a/f' WHEN 1 THEN '/archive/src2/sub/src3/b'
           WHEN 2 THEN '/archive/src' || CAST(doc_id % 20 AS {text}) || '/c' WHEN 3 THEN '/archive/src1'
           WHEN 4 THEN '/archive/src1x/f' WHEN 5 THEN CAST(NULL AS {text}) ELSE '/archive/src2/sub/src33/b' END AS uri
    FROM {{documents}}"""
# Some archives lie below another project's root.
_NESTED = """
    SELECT seq, src_project, CASE WHEN seq % 4 = 3 THEN '/archive/src' || CAST(seq - 1 AS {text}) || '/sub'
                                  ELSE '/archive' END AS src_archive FROM {{fpm}}"""


@_query(
    "q_uri_owner",
    f"""SELECT doc_id, project, uri, owner, CASE WHEN uri IS NULL THEN NULL WHEN owner IS NULL THEN 'uri_outside_source'
               WHEN owner = project THEN 'own' ELSE 'other_project' END AS relation FROM (
            SELECT l.*, src_project AS owner, ROW_NUMBER() OVER (PARTITION BY doc_id
                   ORDER BY LENGTH(src_archive || '/' || src_project) DESC NULLS LAST) AS rn
            FROM ({_LOCATIONS.format(text='VARCHAR')}) l LEFT JOIN ({_NESTED.format(text='VARCHAR')}) p
                 ON STARTS_WITH(uri || '/', src_archive || '/' || src_project || '/'))
        WHERE rn = 1""",
)
def _(a: Archive) -> DataFrame:
    pairs = a.sql(_NESTED.format(text="STRING"))
    return locations.with_uri_owner(a.sql(_LOCATIONS.format(text="STRING")), pairs)


@_query(
    "q_reconcile_by_folder",
    f"SELECT * FROM ({_ORACLES['q_catalog_reconcile']}) WHERE action <> 'keep'",
)
def _(a: Archive) -> DataFrame:
    return folders.reconcile_by_folder(a["listed"], a["files_src"])


@_query(
    "q_tree_files",
    """SELECT project, folder, COUNT(*) AS files FROM (
           SELECT project, UNNEST(LIST_DISTINCT(LIST_VALUE('', REGEXP_EXTRACT(rel_path, '^([^/]*)/', 1),
                  REGEXP_EXTRACT(rel_path, '^(.*)/[^/]*$', 1)))) AS folder FROM {files_src})
       GROUP BY project, folder""",
)
def _(a: Archive) -> DataFrame:
    """Files below each folder, summed up from the folders' own digests."""
    found = folders.tree_digests(folders.folder_digests(a["files_src"]))
    return found.select("project", "folder", F.col("files").cast("long").alias("files"))


# ---------------------------------------------------------------- reading and writing


def _staging(a: Archive) -> migration.Staging:
    return migration.Staging(a.spark, shared_folder(a.spark))


def _levels(a: Archive) -> dict[str, DataFrame]:
    """The listings of an archive: one of each type, whose rows know the item above them by its id."""
    above = {"project": [], "subject": [], "experiment": ["subject_id"], "scan": ["experiment_id"], "assessor": ["experiment_id"]}
    rows = a["src_items"].drop("xml")
    return {
        kind: rows.where(F.col("item_type") == kind).select("k", "project", "id", "label", *ids)
        for kind, ids in above.items()
    }


@_query(
    "q_read_items",
    """SELECT i.project, i.item_type, i.id, i.label, i.subject_id, s.label AS subject_label, i.experiment_id,
              i.experiment_label
       FROM {src_items} i LEFT JOIN {subj} s ON s.project = i.project AND s.id = i.subject_id""",
)
def _(a: Archive) -> DataFrame:
    """A shared experiment's subject is not always listed in the project that shows it."""
    with _staging(a) as staging:
        paths = {kind: staging.path(kind) for kind in _levels(a)}
        for kind, rows in _levels(a).items():
            rows.write.parquet(paths[kind])
        found = listings.read_items(a.spark, paths)
        return checkpointed(found.drop("owner_project", "xsi_type", "ordinal", "xml"))


@_query(
    "q_listing_violations",
    """SELECT 'parent_not_listed' AS "check", project, item_type, id AS item_id, 'experiment ' || experiment_id AS detail
       FROM {src_items} WHERE item_type IN ('scan', 'assessor') AND experiment_id IN
           (SELECT id FROM {expt} WHERE k % 13 = 0)
       UNION ALL
       SELECT 'parent_not_listed', i.project, i.item_type, i.id, 'subject ' || i.subject_id
       FROM {src_items} i LEFT JOIN {subj} s ON s.project = i.project AND s.id = i.subject_id
       WHERE i.item_type = 'experiment' AND i.k % 13 <> 0 AND s.id IS NULL
       UNION ALL
       SELECT 'parent_not_listed', project, item_type, id, 'subject none' FROM {src_items}
       WHERE item_type = 'experiment' AND k % 13 <> 0 AND k % 17 = 0
       UNION ALL
       SELECT 'several_parents', project, item_type, id,
              'subject ' || LEAST(subject_id, 'none') || ' ' || GREATEST(subject_id, 'none') FROM {src_items}
       WHERE item_type = 'experiment' AND k % 13 <> 0 AND k % 17 = 0""",
)
def _(a: Archive) -> DataFrame:
    """Some experiments are not listed, some are listed below a subject that is not there as well."""
    levels = _levels(a)
    kept = levels["experiment"].where("k % 13 <> 0")
    levels["experiment"] = kept.unionByName(kept.where("k % 17 = 0").withColumn("subject_id", F.lit("none")))
    return listings.listing_violations(levels)


@_query(
    "q_walked_files",
    """SELECT source AS project, 'lang=' || lang AS folder, CAST(SUM(STRLEN(text) + 1) AS BIGINT) AS length
       FROM {documents} WHERE lang NOT LIKE 'd%' GROUP BY source, lang""",
)
def _(a: Archive) -> DataFrame:
    """Project folders as they lie on a disk: a file for each language, of which some are not to be entered."""
    with _staging(a) as staging:
        path = staging.path("projects")
        texts = a["documents"].select("source", "lang", "text").repartition("source", "lang")
        texts.write.partitionBy("source", "lang").text(path)
        root = F.concat(F.lit(path.removeprefix("file://") + "/source="), "source")
        roots = a["documents"].select(F.col("source").alias("project"), root.alias("root")).distinct()
        found = manifest.walk_folders(roots, exclude=(".*", "lang=d*")).files
        return checkpointed(found.select("project", folders.folder_of(F.col("rel_path")).alias("folder"), "length"))


@_query(
    "q_read_datatypes",
    """SELECT 'source' AS server, element_name FROM {dt_src}
       UNION ALL SELECT 'destination', element_name FROM {dt_dst}""",
)
def _(a: Archive) -> DataFrame:
    """Lists of both servers as they are exported: JSON arrays of objects."""
    found = []
    with _staging(a) as staging:
        for server, rows in (("source", a["dt_src"]), ("destination", a["dt_dst"])):
            listed = rows.groupBy(F.pmod(F.xxhash64("element_name"), F.lit(8)).alias("part")).agg(
                F.to_json(F.collect_list(F.struct(F.col("element_name").alias("elementName")))).alias("value")
            )
            path = staging.path(server)
            listed.write.partitionBy("part").text(path)
            found.append(listings.read_datatypes(a.spark, path, server))
        return checkpointed(found[0].unionByName(found[1]))


@_query(
    "q_read_profiles",
    "SELECT pos, id, username, enabled, email, verified, firstName, lastName FROM {usr_src}",
)
def _(a: Archive) -> DataFrame:
    """One list in the order of the server, as it is exported."""
    users_of = a["usr_src"]
    with _staging(a) as staging:
        ordered = F.array_sort(F.collect_list(F.struct("pos", *[c for c in users_of.columns if c != "pos"])))
        path = staging.path("users")
        users_of.agg(F.to_json(ordered).alias("value")).write.text(path)
        return checkpointed(listings.read_profiles(a.spark, path))


def _published(
    a: Archive, staging: migration.Staging, rows: DataFrame, write: Callable[[DataFrame, str], None], fmt: str = "parquet"
) -> DataFrame:
    """What readers of the published table get, after a former run of it was replaced."""
    path = staging.path("published")
    publish.publish(rows.limit(0), write, path, fmt=fmt)
    publish.publish(rows, write, path, fmt=fmt)
    return publish.read_published(a.spark, path, check=True)


def _written(a: Archive, rows: DataFrame, write: Callable[[DataFrame, str], None], fmt: str = "parquet") -> DataFrame:
    with _staging(a) as staging:
        return checkpointed(_published(a, staging, rows, write, fmt))


@_query("q_written_metadata", "SELECT * FROM {meta}")
def _(a: Archive) -> DataFrame:
    return _written(a, metadata.metadata_columns(a["meta"]), sinks.write_metadata, "csv")


@_query(
    "q_written_id_map",
    "SELECT src_project, map_type, source_id, destination_id FROM {id_map} WHERE map_type IN ('subject', 'experiment')",
)
def _(a: Archive) -> DataFrame:
    return _written(a, _id_map(a), sinks.write_id_map, "csv")


@_query("q_written_create", _ORACLES["q_xml_roundtrip"])
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    plan, _ = migration.create_plan(*_tables(a, staging), staging=staging)
    plan = staging.write(plan, "plan")
    staging.drop("judged", "id_map")
    back = _published(a, staging, plan, sinks.write_create_plan)
    return back.drop("target_path", "pending", "project", "experiment_id")


@_query("q_written_config", _ORACLES["q_config_plan"])
def _(a: Archive) -> DataFrame:
    return _written(a, _QUERIES["q_config_plan"](a), sinks.write_config_plan)


@_query("q_written_share", _ORACLES["q_share_plan"])
def _(a: Archive) -> DataFrame:
    return _written(a, _QUERIES["q_share_plan"](a), sinks.write_share_plan)


@_query("q_written_users", _ORACLES["q_users_to_create"])
def _(a: Archive) -> DataFrame:
    return _written(a, _QUERIES["q_users_to_create"](a), sinks.write_user_plan)


@_query("q_written_refresh", _ORACLES["q_refresh_paths"])
def _(a: Archive) -> DataFrame:
    back = _written(a, catalogs.refresh_paths(a["dst_after"]), sinks.write_refresh_plan)
    return back.select(
        "project", F.col("depth").cast("long").alias("depth"),
        F.col("step").cast("long").alias("step"), "action", "path",
    )


# ---------------------------------------------------------------- metadata and the whole


@_query("q_metadata", "SELECT * FROM {meta}")
def _(a: Archive) -> DataFrame:
    return metadata.metadata_columns(a["meta"])


@_query(
    "q_metadata_for_destination",
    """SELECT m.src_project, m.map_type, m.source_id, label, insert_user, insert_date,
              last_modified, destination_id
       FROM {meta} JOIN {id_map} m ON m.src_project = project AND m.source_id = ID
            AND m.map_type = CASE resource WHEN 'subjects' THEN 'subject' ELSE 'experiment' END""",
)
def _(a: Archive) -> DataFrame:
    return metadata.metadata_for_destination(a["meta"], _id_map(a))


def _plans(a: Archive, rows: DataFrame, **options) -> DataFrame:
    settings = listings.unwrap_resultset(
        a["cfg_listing"], "listing", "path: STRING, contents: STRING"
    )
    plans = migration.migration_plan(
        migration.Inputs(
            project_map=a["pm"],
            src_items=rows,
            dst_items=a["dst_before"],
            dst_after=a["dst_after"],
            src_datatypes=a["dt_src"],
            dst_datatypes=a["dt_dst"],
            schema_datatypes=a["dt_schema"],
            src_users=a["usr_src"],
            dst_users=a["usr_dst"],
            metadata=a["meta"],
            settings=settings,
            src_files=a["nat_src"],
            dst_files=a["nat_dst"],
        ),
        **options,
    )
    counts = [f"SELECT '{name}' AS plan, COUNT(*) AS n FROM {{{name}}}" for name in plans]
    return a.spark.sql(" UNION ALL ".join(counts), **plans)


_COMMON_COUNTS = """
    UNION ALL SELECT 'users', COUNT(*) FROM {usr_src} WHERE pos >= (SELECT COUNT(*) FROM {usr_dst})
    UNION ALL SELECT 'metadata', COUNT(*) FROM {meta} JOIN {pm} ON src_project = project
    UNION ALL SELECT 'files', COUNT(*) FROM {nat_src} s JOIN {pm} ON src_project = s.project
        LEFT JOIN {nat_dst} d ON d.project = dst_project AND d.rel_path = s.rel_path
        WHERE d.rel_path IS NULL AND NOT REGEXP_MATCHES(s.rel_path,
            '(^|/)([^/]*[.]log|[.][^/]*|[^/]*[.]json)(/|$)')
    UNION ALL SELECT 'transfer', COUNT(DISTINCT project) FROM {nat_src}
        JOIN {pm} ON src_project = project
    UNION ALL SELECT 'failures', 4 * COUNT(*) FROM {pm}
    UNION ALL SELECT 'totals', COUNT(*) FROM {pm}
    UNION ALL SELECT 'config', COUNT(*) FROM (
        SELECT DISTINCT n_name, event_type, path FROM (
            SELECT n_name, event_type, 'k' || CAST(user_id % 4 AS VARCHAR) AS path
            FROM {events} JOIN {nation} ON n_nationkey = user_id % 25 WHERE n_nationkey < 20
            UNION ALL SELECT n_name, event_type, 'raw'
            FROM {events} JOIN {nation} ON n_nationkey = user_id % 25 WHERE n_nationkey < 20))
    UNION ALL SELECT 'refresh', COUNT(*) + COUNT(*) FILTER (item_type = 'experiment')
        FROM {dst_after}"""
_CHECK_COUNTS = """
    (SELECT COUNT(*) FROM (SELECT element_name FROM {dt_src} WHERE element_name NOT LIKE 'xdat:%'
                           EXCEPT SELECT element_name FROM {dt_dst}))
    + (SELECT COUNT(*) FROM {usr_src} s JOIN {usr_dst} d ON d.pos = s.pos AND d.id <> s.id)"""


@_query(
    "q_plan_summary",
    f"""SELECT 'violations' AS plan, {_CHECK_COUNTS}
            + (SELECT COUNT(*) FROM {{expt}} JOIN {{pm}} ON src_project = project
               WHERE xsi_type NOT IN (SELECT element_name FROM {{dt_schema}}))
            + (SELECT COUNT(*) FROM ({_ORACLES['q_rewrite_violations']}))
            + (SELECT COUNT(*) FROM ({_ORACLES['q_share_violations']})) AS n
        UNION ALL SELECT 'create', COUNT(*) FROM ({_ORACLES['q_xml_roundtrip']})
        UNION ALL SELECT 'id_map', COUNT(*) FROM {{id_map}}
        UNION ALL SELECT 'share', COUNT(*) FROM ({_ORACLES['q_share_plan']})
        {_COMMON_COUNTS}""",
)
def _(a: Archive) -> DataFrame:
    staging = _staged(a)
    return _plans(a, a["src_items"], staging=staging)


@_query(
    "q_plan_files_only",
    f"""SELECT 'violations' AS plan, {_CHECK_COUNTS} AS n
        UNION ALL SELECT 'create', COUNT(*) FROM {{pm}} WHERE seq % 3 <> 0
        UNION ALL SELECT 'id_map', COUNT(*) FROM {{pm}}
        UNION ALL SELECT 'share', 0
        {_COMMON_COUNTS}""",
)
def _(a: Archive) -> DataFrame:
    return _plans(a, _documents(a), files_only=True)
