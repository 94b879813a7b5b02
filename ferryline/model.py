"""Fixed values and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# XML namespace prefixes of archive documents.
NAMESPACES = {
    "xnat": "http://nrg.wustl.edu/xnat",
    "prov": "http://www.nbirn.net/prov",
    "xdat": "http://nrg.wustl.edu/xdat",
    "xs": "http://www.w3.org/2001/XMLSchema",
    "proc": "http://nrg.wustl.edu/proc",
    "fs": "http://nrg.wustl.edu/fs",
    "icr": "http://icr.ac.uk/icr",
}


def clark(name: str) -> str:
    """``prefix:local`` as ``{uri}local``; other names are returned as they are."""
    prefix, _, local = name.partition(":")
    return f"{{{NAMESPACES[prefix]}}}{local}" if local and prefix in NAMESPACES else name


# The item types an archive knows.
ITEM_TYPES = (
    "server",
    "project",
    "subject",
    "experiment",
    "scan",
    "assessor",
    "reconstruction",
    "resource",
    "in_resource",
    "out_resource",
    "file",
)

# Item type -> namespace its ids live in. Assessors are experiments.
ID_NAMESPACES = {
    "project": "project",
    "subject": "subject",
    "experiment": "experiment",
    "assessor": "experiment",
    "reconstruction": "reconstruction",
    "scan": "scan",
}

# Direct children whose text refers to another item, and that item's type.
REFERENCE_TAGS = {
    clark("icr:subjectID"): "subject",
    clark("xnat:subject_ID"): "subject",
    clark("xnat:image_session_ID"): "experiment",
    clark("xnat:imageSession_ID"): "experiment",
    clark("xnat:session_id"): "experiment",
    clark("xnat:scanID"): "scan",
    clark("xnat:imageScan_ID"): "scan",
}

# Direct children that are not carried over.
DROPPED_TAGS = (
    clark("xnat:experiments"),
    clark("xnat:scans"),
    clark("xnat:assessors"),
    clark("xnat:reconstructions"),
    clark("xnat:prearchivePath"),
    clark("xnat:sharing"),
)

# Modality of a generic scan -> root tag of the specific scan.
MODALITY_TAGS = {
    "MR": clark("xnat:MRScan"),
    "CT": clark("xnat:CTScan"),
    "US": clark("xnat:USScan"),
    "PT": clark("xnat:PETScan"),
    "NM": clark("xnat:NMScan"),
}
GENERIC_SCAN_TAG = clark("xnat:imageScanData")
OTHER_SCAN_TAG = "xnat:OtherDicomScan"
MODALITY_TAG = clark("xnat:modality")
NAME_TAG = clark("xnat:name")
FILE_TAG = clark("xnat:file")

# Parent tag -> child tag whose URI attribute is a file location.
NESTED_URI_TAGS = {
    clark("xnat:out"): FILE_TAG,
    clark("xnat:resources"): clark("xnat:resource"),
}

# Internal datatypes have this prefix; external accounts this suffix.
INTERNAL_DATATYPE_PREFIX = "xdat:"
EXTERNAL_USER_SUFFIX = "#EXT#"

# File name patterns left out of a file transfer.
EXCLUDED_FILE_PATTERNS = ("*.log", ".*", "*.json")

# Columns of a metadata listing.
METADATA_COLUMNS = ("ID", "label", "insert_user", "insert_date", "last_modified")

# Listing name -> type of the items it lists.
RESOURCE_TYPES = {"subjects": "subject", "experiments": "experiment"}

# Item types whose failures are counted, those that can be shown in other
# projects, and the namespaces whose ids are unique on a whole server.
COUNTED_TYPES = ("subject", "experiment", "scan", "assessor")
SHAREABLE_TYPES = ("subject", "experiment", "assessor")
SERVER_WIDE = ("subject", "experiment")

_ATTRS = "MAP<STRING, STRING>"
_KID = f"STRUCT<tag: STRING, text: STRING, tail: STRING, attrs: {_ATTRS}, raw: STRING>"
_CHILD = (
    "STRUCT<ord: INT, tag: STRING, text: STRING, tail: STRING, "
    f"attrs: {_ATTRS}, kids: ARRAY<{_KID}>>"
)

#: An item document down to its grandchildren; whatever lies deeper is text in ``raw``.
ELEMENT = f"STRUCT<tag: STRING, text: STRING, attrs: {_ATTRS}, children: ARRAY<{_CHILD}>>"

_REFS = "ARRAY<STRUCT<ord: INT, map_type: STRING, source_id: STRING>>"

_NAMES = f"refs: {_REFS}, uris: ARRAY<STRING>"

#: A document's element, the references it holds, by place, and the file locations.
DOCUMENT = f"STRUCT<element: {ELEMENT}, {_NAMES}>"

#: The same without the element.
NAMED = f"STRUCT<{_NAMES}>"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


PROJECT_MAP = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *_strings(
            "src_project",
            "dst_project",
            "dst_secondary_id",
            "dst_name",
            "src_archive",
            "dst_archive",
            "src_files",
            "dst_files",
        ),
    ]
)

SRC_ITEM = T.StructType(
    [
        *_strings(
            "project",
            "item_type",
            "id",
            "label",
            "owner_project",
            "xsi_type",
            "subject_id",
            "subject_label",
            "experiment_id",
            "experiment_label",
        ),
        T.StructField("ordinal", T.LongType()),
        *_strings("xml"),
    ]
)

DST_ITEM = T.StructType(
    _strings("project", "item_type", "id", "label", "subject_label", "experiment_label")
)

ITEM_METADATA = T.StructType(_strings("project", "resource", *METADATA_COLUMNS))

CONFIG_SETTING = T.StructType(
    [
        *_strings("project", "tool", "path", "contents"),
        T.StructField("pos", T.LongType()),
    ]
)

USER_PROFILE = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("email", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("firstName", T.StringType()),
        T.StructField("lastName", T.StringType()),
    ]
)

FILE_ENTRY = T.StructType(
    [
        *_strings("project", "rel_path"),
        T.StructField("length", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        *_strings("checksum"),
    ]
)

VIOLATION = T.StructType(_strings("check", "project", "item_type", "item_id", "detail"))
