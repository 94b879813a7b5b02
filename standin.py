"""Archive tables derived from the given tables.

Every view is one SQL text that Spark and DuckDB both run, but for the names of two
functions, with the tables it reads in braces. The archive it describes: customers are subjects, orders experiments, order lines
scans, events assessors; nations 0 to 19 are migrated. ``k`` is the number in an item's id
and ``home`` the project that owns it.
"""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from ferryline.sources.projects import with_roots

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

# Fixed value: the namespace of archive documents.
_NS = "http://nrg.wustl.edu/xnat"

VIEWS = {
    "pm": """
        SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS src_project,
               'D_' || n_name AS dst_project, 'D_' || n_name AS dst_secondary_id,
               'Title ' || n_name AS dst_name, '/archive' AS src_archive, '/new' AS dst_archive
        FROM {nation} WHERE n_nationkey < 20""",
    "prj": """
        SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS project, n_name AS home, n_name AS id
        FROM {nation}""",
    # Every seventh subject and every eleventh experiment is also shown in the next project.
    "subj": """
        SELECT k, 'NATION_' || CAST((home + shift) % 25 AS STRING) AS project,
               'NATION_' || CAST(home AS STRING) AS home, 'S' || CAST(k AS STRING) AS id, label
        FROM (SELECT c_custkey AS k, c_name AS label, c_nationkey AS home,
                     EXPLODE(CASE WHEN c_custkey % 7 = 0 THEN ARRAY(0, 1) ELSE ARRAY(0) END)
                         AS shift
              FROM {customer}) shown""",
    "expt": """
        SELECT k, 'NATION_' || CAST((home + shift) % 25 AS STRING) AS project,
               'NATION_' || CAST(home AS STRING) AS home, 'O' || CAST(k AS STRING) AS id,
               'E' || CAST(k AS STRING) AS label, xsi_type,
               'S' || CAST(c_custkey AS STRING) AS subject_id, subject_label, o_orderdate
        FROM (SELECT o_orderkey AS k, c_custkey, c_name AS subject_label, c_nationkey AS home,
                     o_orderpriority AS xsi_type, o_orderdate,
                     EXPLODE(CASE WHEN o_orderkey % 11 = 0 THEN ARRAY(0, 1) ELSE ARRAY(0) END)
                         AS shift
              FROM {orders} JOIN {customer} ON c_custkey = o_custkey) shown""",
    "line": """
        SELECT l_orderkey, l_linenumber,
               LEAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 2) AS mr,
               LEAST(SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END), 2) AS ct,
               LEAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 2) AS xx
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "scan": """
        SELECT l_orderkey + l_linenumber AS k, project, home, CAST(l_linenumber AS STRING) AS id,
               subject_id, subject_label, e.id AS experiment_id, label AS experiment_label,
               mr, ct, xx
        FROM {line} JOIN {expt} e ON e.k = l_orderkey""",
    "asr": """
        SELECT e.k, project, home, 'A' || CAST(e.k AS STRING) AS id,
               event_type || '_' || CAST(e.k AS STRING) AS label,
               subject_id, subject_label, e.id AS experiment_id, e.label AS experiment_label
        FROM {events} JOIN {expt} e ON e.k = event_id""",
    # A scan names the project it is seen in as its owner, which must not be believed.
    "src_items": f"""
        SELECT k, project, home, 'project' AS item_type, id, id AS label, home AS owner_project,
               CAST(NULL AS STRING) AS xsi_type, CAST(NULL AS STRING) AS subject_id,
               CAST(NULL AS STRING) AS subject_label, CAST(NULL AS STRING) AS experiment_id,
               CAST(NULL AS STRING) AS experiment_label, k AS ordinal,
               '<p:Project xmlns:p="{_NS}" ID="' || id || '" secondary_ID="old"><p:name>' || id
               || '</p:name><p:experiments><p:experiment ID="E"/></p:experiments></p:Project>'
                   AS xml
        FROM {{prj}}
        UNION ALL
        SELECT k, project, home, 'subject', id, label, home, NULL, NULL, NULL, NULL, NULL, k,
               '<xnat:Subject xmlns:xnat="{_NS}" ID="' || id || '" project="' || home
               || '" label="' || label
               || '"><xnat:sharing><xnat:share label="x"/></xnat:sharing>&amp;</xnat:Subject>'
        FROM {{subj}}
        UNION ALL
        SELECT k, project, home, 'experiment', id, label, home, xsi_type, subject_id,
               subject_label, NULL, NULL, k,
               '<xnat:MRSession xmlns:xnat="{_NS}" ID="' || id || '" project="' || home || '">'
               || '<xnat:subject_ID>' || subject_id || '</xnat:subject_ID><xnat:scans/>'
               || '<xnat:resources><xnat:resource URI="/archive/'
               || CASE WHEN k % 19 = 0 THEN 'lost' ELSE home END || '/r' || CAST(k AS STRING)
               || '"/></xnat:resources></xnat:MRSession>'
        FROM {{expt}}
        UNION ALL
        SELECT k, project, home, 'scan', id, id, project, NULL, subject_id, subject_label,
               experiment_id, experiment_label, k,
               '<xnat:imageScanData xmlns:xnat="{_NS}" ID="' || id || '" project="' || home
               || '"><xnat:image_session_ID>' || experiment_id || '</xnat:image_session_ID>'
               || REPEAT('<xnat:modality>MR</xnat:modality>', CAST(mr AS INT))
               || REPEAT('<xnat:modality>CT</xnat:modality>', CAST(ct AS INT))
               || REPEAT('<xnat:modality>XX</xnat:modality>', CAST(xx AS INT))
               || '<xnat:modality/><xnat:file URI="/archive/' || home || '/' || id || '.dcm"/>'
               || '</xnat:imageScanData>'
        FROM {{scan}}
        UNION ALL
        SELECT k, project, home, 'assessor', id, label, home, NULL, subject_id, subject_label,
               experiment_id, experiment_label, k,
               '<xnat:Assessor xmlns:xnat="{_NS}" ID="' || id || '" label="' || label || '">'
               || '<xnat:imageSession_ID>' || experiment_id || '</xnat:imageSession_ID>'
               || '<xnat:scanID>1</xnat:scanID><xnat:in><xnat:file URI="/else"/></xnat:in>'
               || '<xnat:out><xnat:file URI="/archive/' || home
               || '/a"><xnat:note q="1">t</xnat:note></xnat:file></xnat:out></xnat:Assessor>'
        FROM {{asr}}""",
    # References as the documents hold them, for projects that are visited.
    "refs": """
        SELECT project, item_type, '' AS experiment_key, id, 0 AS ord, 'subject' AS map_type,
               subject_id AS source_id
        FROM {src_items} JOIN {pm} ON src_project = project WHERE item_type = 'experiment'
        UNION ALL
        SELECT project, item_type, experiment_id, id, 0, 'experiment', experiment_id
        FROM {src_items} JOIN {pm} ON src_project = project
        WHERE item_type IN ('scan', 'assessor')
        UNION ALL
        SELECT project, item_type, experiment_id, id, 1, 'scan', '1'
        FROM {src_items} JOIN {pm} ON src_project = project WHERE item_type = 'assessor'""",
    "dst_all": """
        SELECT dst_project AS project, item_type,
               CASE item_type WHEN 'scan' THEN id WHEN 'project' THEN dst_project
                              ELSE 'X' || id END AS id,
               CASE item_type WHEN 'project' THEN dst_project ELSE label END AS label,
               subject_label, experiment_label, k
        FROM {src_items} JOIN {pm} ON src_project = project
        WHERE project = home""",
    "dst_before": """
        SELECT project, item_type, id, label, subject_label, experiment_label
        FROM {dst_all} WHERE k % 3 = 0""",
    "dst_after": """
        SELECT project, item_type, id, label, subject_label, experiment_label
        FROM {dst_all} WHERE item_type = 'project' OR k % 97 <> 0""",
    "dt_src": """
        SELECT CASE WHEN p_partkey % 10 = 0 THEN 'xdat:' || p_type
                    ELSE p_type || '_' || p_brand END AS element_name
        FROM {part}""",
    "dt_dst": """
        SELECT p_type || '_' || p_brand AS element_name FROM {part} WHERE p_type <> 'PROMO'""",
    "dt_schema": """
        SELECT DISTINCT o_orderpriority AS element_name FROM {orders}
        WHERE o_orderpriority NOT LIKE '1%'""",
    # The position is added by each engine's own means.
    "usr": """
        SELECT s_suppkey AS id,
               s_name || CASE WHEN s_suppkey % 5 = 0 THEN '#EXT#' ELSE '' END AS username,
               s_acctbal > 0 AS enabled, 'u' || CAST(s_suppkey AS STRING) || '@example.org' AS email,
               s_nationkey % 2 = 0 AS verified, 'First' || CAST(s_nationkey AS STRING) AS firstName,
               s_name AS lastName
        FROM {supplier}""",
    "usr_dst": """
        SELECT pos, CASE WHEN id % 29 = 0 THEN id + 1000000 ELSE id END AS id,
               CASE WHEN id % 17 = 0 THEN username || '_x' ELSE username END AS username
        FROM {usr_src} WHERE pos * 10 < 6 * (SELECT COUNT(*) FROM {usr_src})""",
    "fpm": """
        SELECT CAST(SUBSTR(source, 4) AS BIGINT) AS seq, source AS src_project,
               'dst' || SUBSTR(source, 4) AS dst_project
        FROM (SELECT DISTINCT source FROM {documents}) s
        WHERE CAST(SUBSTR(source, 4) AS BIGINT) < 18""",
    "files_src": """
        SELECT doc_id, source AS project,
               CASE doc_id % 5 WHEN 0 THEN 's/' || CAST(doc_id AS STRING) || '.dcm'
                               WHEN 1 THEN 's/' || CAST(doc_id AS STRING) || '.log'
                               WHEN 2 THEN CAST(doc_id AS STRING) || '.json'
                               WHEN 3 THEN '.cache/' || CAST(doc_id AS STRING) || '.dcm'
                               ELSE '_x.logs/a.LOG/' || CAST(doc_id AS STRING) || '.dcm' END
                   AS rel_path,
               n_chars AS length, lang || CAST(n_chars AS STRING) AS checksum
        FROM {documents}""",
    "files_dst": """
        SELECT dst_project AS project, rel_path, length, checksum
        FROM {files_src} JOIN {fpm} ON src_project = project WHERE doc_id % 4 = 0""",
    # The same files spread over the nations, for the migration as a whole.
    "nat_src": """
        SELECT 'NATION_' || CAST(doc_id % 25 AS STRING) AS project, rel_path, length, checksum
        FROM {files_src}""",
    "nat_dst": """
        SELECT 'D_NATION_' || CAST(doc_id % 25 AS STRING) AS project, rel_path, length, checksum
        FROM {files_src} WHERE doc_id % 4 = 0""",
    # What the catalogue lists: most files, some with an old checksum, and some long gone.
    "listed": """
        SELECT project, CASE WHEN doc_id % 9 = 0 THEN 'gone/' || rel_path ELSE rel_path END AS rel_path,
               CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE checksum END AS checksum
        FROM {files_src} WHERE doc_id % 8 <> 0""",
    "tree": """
        SELECT source AS project, lang AS subject, lang || CAST(doc_id % 3 AS STRING) AS experiment,
               'scan' || CAST(doc_id % 7 AS STRING) AS leaf, n_chars AS length
        FROM {documents}""",
    "uris": """
        SELECT doc_id, source AS project,
               '/archive/' || source AS src, '/new/dst' || SUBSTR(source, 4) AS dst,
               CASE doc_id % 4 WHEN 0 THEN '/archive/' || source || '/archive/' || source || '/f'
                               WHEN 1 THEN '/mnt/archive/' || source || '0/f'
                               WHEN 2 THEN '/elsewhere/' || CAST(doc_id AS STRING)
                               ELSE NULL END AS uri
        FROM {documents}""",
    # One exported listing per event, as the server sends it.
    "cfg_listing": """
        SELECT event_id, n_name AS project, event_type AS tool,
               '{{"ResultSet":{{"Result":[{{"path":"k' || CAST(user_id % 4 AS STRING)
               || '","contents":' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING)
               || '}},{{"path":"raw","contents":"' || event_type || CAST(event_id AS STRING)
               || '"}}]}}}}' AS listing
        FROM {events} JOIN {nation} ON n_nationkey = user_id % 25""",
    "meta": """
        SELECT project, 'subjects' AS resource, id AS ID, label,
               'u' || CAST(k % 10 AS STRING) AS insert_user, '2020-01-01' AS insert_date,
               CAST(k AS STRING) AS last_modified
        FROM {subj}
        UNION ALL
        SELECT project, 'experiments', id, label, 'u' || CAST(k % 10 AS STRING),
               SUBSTR(CAST(o_orderdate AS STRING), 1, 10), CAST(k AS STRING)
        FROM {expt}""",
}

# The position in DuckDB; in Spark it comes from the operator under test.
ORACLE_ONLY = {
    "usr_src": "SELECT ROW_NUMBER() OVER (ORDER BY id) - 1 AS pos, * FROM {usr}",
    "id_map": """
        SELECT src_project, map_type, source_id, destination_id, seq FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY src_project, map_type, source_id
                ORDER BY seq DESC, ordinal DESC, destination_id DESC) AS rn
            FROM {resolved} WHERE destination_id IS NOT NULL) r
        WHERE rn = 1""",
    "owned": """
        SELECT i.*, pm.* FROM {src_items} i JOIN {pm} pm ON src_project = project
        WHERE project = home""",
    "resolved": """
        SELECT seq, src_project, o.item_type,
               CASE o.item_type WHEN 'assessor' THEN 'experiment' ELSE o.item_type END AS map_type,
               o.id AS source_id, ordinal,
               CASE o.item_type WHEN 'project' THEN dst_project WHEN 'scan' THEN o.id
                                ELSE d.id END AS destination_id
        FROM {owned} o LEFT JOIN {dst_after} d
            ON d.project = dst_project AND d.item_type = o.item_type AND d.label = o.label
               AND (o.item_type = 'subject'
                    OR (d.subject_label = o.subject_label
                        AND (o.item_type = 'experiment'
                             OR d.experiment_label = o.experiment_label)))
               AND o.item_type IN ('subject', 'experiment', 'assessor')""",
    # Ids that documents refer to, and whether an item is still to be created for them.
    "expected": """
        SELECT o.*, COALESCE(sm.destination_id, sa.any_id) AS new_subject,
               COALESCE(em.destination_id, ea.any_id) AS new_experiment,
               cm.destination_id AS new_scan,
               ds.source_id IS NOT NULL AS due_subject, de.source_id IS NOT NULL AS due_experiment,
               dc.project IS NOT NULL AS due_scan
        FROM {owned} o
        LEFT JOIN {id_map} sm ON sm.src_project = o.src_project AND sm.map_type = 'subject'
            AND sm.source_id = o.subject_id
        LEFT JOIN {id_any} sa ON sa.map_type = 'subject' AND sa.source_id = o.subject_id
        LEFT JOIN {id_map} em ON em.src_project = o.src_project AND em.map_type = 'experiment'
            AND em.source_id = o.experiment_id
        LEFT JOIN {id_any} ea ON ea.map_type = 'experiment' AND ea.source_id = o.experiment_id
        LEFT JOIN {id_map} cm ON cm.src_project = o.src_project AND cm.map_type = 'scan'
            AND cm.source_id = '1'
        LEFT JOIN (SELECT DISTINCT id AS source_id FROM {owned}
                   WHERE item_type = 'subject' AND k % 3 <> 0) ds ON ds.source_id = o.subject_id
        LEFT JOIN (SELECT DISTINCT id AS source_id FROM {owned}
                   WHERE item_type IN ('experiment', 'assessor') AND k % 3 <> 0) de
            ON de.source_id = o.experiment_id
        LEFT JOIN (SELECT DISTINCT project FROM {owned}
                   WHERE item_type = 'scan' AND id = '1' AND k % 3 <> 0) dc
            ON dc.project = o.project""",
    "id_any": """
        SELECT map_type, source_id, ARG_MIN(destination_id, seq) AS any_id
        FROM {id_map} GROUP BY map_type, source_id""",
}


def _names(text: str) -> list[str]:
    """Names in braces, each once."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


def sql(text: str) -> str:
    """A query for DuckDB: the views it needs come before it as common table expressions."""
    known = {**VIEWS, **ORACLE_ONLY}
    opened: dict[str, str] = {}

    def open_up(part: str) -> str:
        for name in _names(part):
            if name in known and name not in opened:
                view = open_up(known[name])
                opened[name] = view
        return part.format_map({name: name for name in _names(part)})

    body = open_up(text)
    # The two engines name these differently.
    body, *views = [
        part.replace("EXPLODE(", "UNNEST(").replace("ARRAY(", "LIST_VALUE(")
        for part in (body, *opened.values())
    ]
    opened = dict(zip(opened, views, strict=True))
    parts = ",\n".join(f"{name} AS MATERIALIZED ({view})" for name, view in opened.items())
    return f"WITH {parts}\n{body}" if parts else body


class Archive:
    """The views over one folder of tables, as DataFrames made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name == "usr_src":
            from ferryline.operators.users import with_position

            return with_position(self["usr"], "id")
        rows = self.sql(VIEWS[name])
        if name in ("pm", "fpm"):
            roots = {"src_files": "/data/from", "dst_files": "/data/to"}
            return with_roots(rows, src_archive="/archive", dst_archive="/new", **roots)
        return rows

    def keep(self, write: Callable[[DataFrame, str], DataFrame], *names: str) -> None:
        """Have views written, in this order; what is asked for from then on goes on from what was written."""
        for name in names:
            self._made[name] = write(self[name], name)

    def sql(self, text: str) -> DataFrame:
        """Run a text over this folder."""
        return self.spark.sql(text, **{name: self[name] for name in _names(text)})
