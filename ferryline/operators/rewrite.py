"""Turning source documents into documents the destination can take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.functions import element as el
from ferryline.functions.ids import id_namespace
from ferryline.functions.paths import archive_path
from ferryline.functions.texts import rewrite_text
from ferryline.functions.uris import uri_mismatch
from ferryline.functions.xmlio import parse_documents, parse_names
from ferryline.model import SERVER_WIDE, clark
from ferryline.operators.items import with_destination

#: Identity of a visited item; scan ids are unique within their experiment only.
ITEM_KEY = ["project", "item_type", "experiment_key", "id"]


def with_item_key(items: DataFrame) -> DataFrame:
    """Add ``experiment_key``, the experiment id or an empty string."""
    return items.withColumn("experiment_key", F.coalesce("experiment_id", F.lit("")))


def item_references(items: DataFrame) -> DataFrame:
    """One row per reference of an item: key, ``ord``, ``map_type`` and ``source_id``."""
    listed = "refs" if "refs" in items.columns else el.references(F.col("element.children"))
    keyed = items if "experiment_key" in items.columns else with_item_key(items)
    opened = keyed.select(*ITEM_KEY, F.explode(listed).alias("ref"))
    return opened.select(*ITEM_KEY, "ref.*")


def plannable(items: DataFrame) -> DataFrame:
    """``project, map_type, source_id`` of items that are still to be created."""
    kept = ["project", id_namespace(F.col("item_type")).alias("map_type"), F.col("id").alias("source_id")]
    return items.select(*kept).where(F.col("map_type").isNotNull()).distinct()


def _within(map_type: Column, project: Column) -> Column:
    """The project that a name belongs to; empty where names mean the same on the whole server."""
    return F.when(map_type.isin(*SERVER_WIDE), "").otherwise(project)


def known_names(id_map: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """What references are looked up in, one row for each name: ``within, map_type, source_id``.

    ``own`` has the new id by project, ``any_id`` that of the earliest project; ``is_planned`` tells whether an item of
    that name is still to be created. A name of the whole server is known to the projects that own such an item,
    which are few; others to one project.
    """
    ids = id_map.select(
        "map_type",
        "source_id",
        F.col("src_project").alias("project"),
        F.struct("seq", "destination_id").alias("known"),
    )
    if planned is not None:
        ids = ids.unionByName(planned.select("map_type", "source_id", "project", F.lit(None).alias("known")))
    within = _within(F.col("map_type"), F.col("project"))
    entry = F.when(F.col("known").isNotNull(), F.struct("project", F.col("known.destination_id").alias("id")))
    return ids.groupBy(within.alias("within"), "map_type", "source_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("own"),
        F.min("known").getField("destination_id").alias("any_id"),
        F.bool_or(F.col("known").isNull()).alias("is_planned"),
    )


def resolve_references(
    refs: DataFrame, id_map: DataFrame, planned: DataFrame | None = None
) -> DataFrame:
    """Add ``new_id``: the referring project's own mapping, else that of any project.

    Other projects are asked for ids that are unique on the whole server only: a scan's number means
    nothing outside its project. With ``planned``, of :func:`plannable`, also ``is_planned``: whether the
    name is that of an item still to be created, in the same way. Unresolved and empty names get null.

    One join to a table that is unique on the name: where many items refer to the same, adaptive execution splits them.
    """
    on = ["within", "map_type", "source_id"]
    named = refs.withColumn("within", _within(F.col("map_type"), F.col("project")))
    found = named.join(known_names(id_map, planned), on, "left")
    new_id = F.coalesce(F.try_element_at("own", F.col("project")), "any_id")
    flags = [] if planned is None else [F.coalesce("is_planned", F.lit(False)).alias("is_planned")]
    return found.select(*refs.columns, new_id.alias("new_id"), *flags)


def remap_references(
    references: DataFrame, id_map: DataFrame, planned: DataFrame | None = None
) -> DataFrame:
    """Per item ``new_ids MAP<ord, id>``, the ``pending`` and the ``unmapped`` references.

    ``references`` has the columns of :func:`item_references`. Pending are those to an item that is still to be created,
    with ``nth``, which of the document's references each is; unmapped are those to nothing. The lists are bounded by the document the references stand in.
    """
    ref = F.struct("ord", "map_type", "source_id")
    resolved = resolve_references(references, id_map, planned)
    awaited = F.lit(False) if planned is None else F.col("is_planned")
    # One list, as the aggregate costs by their number; it is parted afterwards.
    told = F.array_sort(F.collect_set(F.struct(ref.alias("ref"), "new_id", awaited.alias("awaited"))))
    found = resolved.groupBy(*ITEM_KEY).agg(told.alias("told"))

    def parted(which: Callable[[Column], Column], part: Callable[[Column], Column]) -> Column:
        return F.array_distinct(F.transform(F.filter("told", which), part))

    new_id = parted(
        lambda t: t["new_id"].isNotNull(), lambda t: F.struct(t["ref"]["ord"].alias("ord"), t["new_id"].alias("new_id"))
    )
    found = found.select(
        *ITEM_KEY,
        F.map_from_entries(new_id).alias("new_ids"),
        F.array_distinct(F.transform("told", lambda t: t["ref"]["ord"])).alias("places"),
        parted(lambda t: t["new_id"].isNull() & t["awaited"], lambda t: t["ref"]).alias("pending"),
        parted(lambda t: t["new_id"].isNull() & ~t["awaited"], lambda t: t["ref"]).alias("unmapped"),
    )
    # Children go from documents on the way, references do not: the how manieth one it is stays true.
    nth = lambda p: F.array_position("places", p["ord"]).cast("int") - 1
    return found.withColumn("pending", F.transform("pending", lambda p: p.withField("nth", nth(p)))).drop("places")


def rewritten_element(
    item_type: Column,
    new_ids: Column,
    project: dict[str, Column],
    *,
    element: Column | None = None,
    bounded: bool = False,
) -> Column:
    """The rewritten document as one expression.

    ``project`` gives ``dst_project``, ``dst_secondary_id``, ``dst_name`` and the archive
    roots ``src_path`` and ``dst_path``.
    """
    doc = F.col("element") if element is None else element
    dst = project["dst_project"]
    attrs = el.retitle_attrs(doc["attrs"], item_type, dst, project["dst_secondary_id"])
    attrs = el.set_project_attr(el.drop_id_attr(attrs, item_type), dst)
    children = el.retitle_children(doc["children"], item_type, project["dst_name"])
    children = el.replace_references(el.drop_child_tags(children), new_ids)
    children = el.rewrite_item_uris(
        children, project["src_path"], project["dst_path"], bounded=bounded
    )
    tag = el.scan_tag(doc["tag"], el.modalities(doc["children"]))
    rebuilt = F.struct(
        tag.alias("tag"),
        doc["text"].alias("text"),
        attrs.alias("attrs"),
        children.alias("children"),
    )
    return F.when(doc.isNotNull(), rebuilt)


def _error(check: str, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def document_errors(
    item_type: Column,
    unmapped: Column,
    src_path: Column,
    dst_path: Column,
    *,
    readable: Column | None = None,
    bounded: bool = False,
) -> Column:
    """``ARRAY<STRUCT<check, detail>>`` of what keeps a document from being rewritten.

    Where there is no ``element`` to see it by, ``readable`` tells whether the document is well-formed.
    """
    known_root = src_path.isNotNull() & dst_path.isNotNull()

    def when(condition: Column, check: str, detail: Column) -> Column:
        return F.when(condition, F.array(_error(check, detail)))

    # With a root missing every location is an error, otherwise those outside are.
    misplaced = F.filter(
        F.col("uris"),
        lambda uri: ~known_root | uri_mismatch(uri, src_path, bounded=bounded),
    )
    parts = [
        when(F.col("element").isNull() if readable is None else ~readable, "malformed_document", F.lit(None)),
        when(id_namespace(item_type).isNull(), "type_has_no_ids", item_type),
        F.transform(
            unmapped,
            lambda ref: _error(
                "unmapped_reference",
                F.concat(ref["map_type"], F.lit(" "), F.coalesce(ref["source_id"], F.lit(""))),
            ),
        ),
        F.transform(
            misplaced,
            lambda uri: F.struct(
                F.when(known_root, "uri_outside_source").otherwise("archive_unknown").alias("check"),
                uri.alias("detail"),
            ),
        ),
    ]
    empty = F.array().cast("ARRAY<STRUCT<check: STRING, detail: STRING>>")
    return F.concat(*[F.coalesce(part, empty) for part in parts])


_DOCUMENT_PARTS = ("element", "refs", "uris")


def _identified(items: DataFrame) -> DataFrame:
    return with_item_key(items).where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in ITEM_KEY)))


def _held(items: DataFrame, facts: list[str]) -> DataFrame:
    """``ITEM_KEY, held``: documents, and facts if wanted, at the place where all that has to do with an item meets.

    Documents are parsed where they are read and move once. Two plans go on from here, one with the references and one
    with the element, and Spark runs a shuffle once for both only if both want the same columns of it: hence one
    column, from an array that parts are not cut out of, and the filter that either would add by itself.
    """
    items = _identified(items)
    if "element" in items.columns:
        element = F.col("element")
        refs = F.col("refs") if "refs" in items.columns else el.references(element["children"])
        uris = F.col("uris") if "uris" in items.columns else el.item_uris(element["children"])
        parts = [element, refs.alias("refs"), uris.alias("uris")]
    else:
        items = items.withColumn("_document", parse_documents("xml"))
        parts = [F.col("_document")[part].alias(part) for part in _DOCUMENT_PARTS]
    held = F.array(F.struct(*parts, F.struct(F.lit(1).alias("_"), *facts).alias("facts")))
    return items.select(*ITEM_KEY, held.alias("held")).repartition(*ITEM_KEY)


def _part(name: str) -> Column:
    """A part of what is held."""
    return F.get(F.transform("held", lambda d: d[name]), F.lit(0))


def rewrite_items(
    items: DataFrame,
    project_map: DataFrame,
    id_map: DataFrame,
    *,
    chosen: DataFrame | None = None,
    planned: DataFrame | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Rewrite item documents for the destination and list what stands in the way.

    Items come with ``element``, or with ``xml`` that is parsed here. ``element`` is
    replaced, ``errors`` and ``pending`` are added; an item with errors cannot be created, one
    with pending references not yet: they keep their old ids. Items without a project, type or id are left out.

    ``chosen`` gives the items to rewrite, without their documents and with the columns of
    :func:`~ferryline.operators.items.with_destination`. ``planned`` is that of :func:`resolve_references`.
    """
    documents = ("xml", *_DOCUMENT_PARTS)
    if chosen is None:
        rows = with_destination(items, project_map)
        facts = [c for c in rows.columns if c not in documents and c not in ITEM_KEY]
        held = _held(rows, facts)
        joined = held
    else:
        held, facts = _held(items, []), []
        joined = with_item_key(chosen).join(held, ITEM_KEY)
    listed = F.explode_outer(_part("refs")).alias("ref")
    refs = held.select(*ITEM_KEY, listed).where("ref IS NOT NULL").select(*ITEM_KEY, "ref.*")
    # Both sides stand on the key the documents were moved by, so they do not move again.
    joined = joined.join(remap_references(refs, id_map, planned), ITEM_KEY, "left")
    opened = {part: _part(part) for part in (*_DOCUMENT_PARTS, "facts")}
    joined = joined.withColumns(opened).withColumns({c: F.col("facts")[c] for c in facts})
    kind, paths = F.col("item_type"), _paths()
    used = ("element", "refs", "uris", "held", "facts", "experiment_key", "new_ids", "pending", "unmapped")
    kept = [c for c in joined.columns if c not in used]
    return joined.select(
        *kept,
        rewritten_element(kind, F.col("new_ids"), {**_titles(), **paths}, bounded=bounded).alias(
            "element"
        ),
        _pending().alias("pending"),
        document_errors(kind, F.col("unmapped"), **paths, bounded=bounded).alias("errors"),
    )


def _paths() -> dict[str, Column]:
    return {
        "src_path": archive_path(F.col("src_archive"), F.col("project")),
        "dst_path": archive_path(F.col("dst_archive"), F.col("dst_project")),
    }


def _titles() -> dict[str, Column]:
    return {c: F.col(c) for c in ("dst_project", "dst_secondary_id", "dst_name")}


def _pending() -> Column:
    empty = F.array().cast("ARRAY<STRUCT<ord: INT, map_type: STRING, source_id: STRING, nth: INT>>")
    return F.coalesce("pending", empty)


def document_names(items: DataFrame) -> DataFrame:
    """``ITEM_KEY, text_hash, readable, refs, uris`` of items with ``xml``: what plans want to know of documents, narrow.

    ``text_hash`` tells documents apart that share a key. Documents are read and do not move.
    """
    named = _identified(items).withColumn("_names", parse_names("xml"))
    parts = [F.col("_names").isNotNull().alias("readable"), *[F.col("_names")[c].alias(c) for c in ("refs", "uris")]]
    return named.select(*ITEM_KEY, F.xxhash64("xml").alias("text_hash"), *parts)


def judge_items(names: DataFrame, references: DataFrame, *, chosen: DataFrame, bounded: bool = False) -> DataFrame:
    """What :func:`rewrite_items` finds of items but for their documents: ``pending``, ``errors``, and for :func:`rewrite_judged`
    the key, ``text_hash`` and ``new_ids``.

    ``names`` are those of :func:`document_names`, ``references`` of :func:`remap_references`.
    """
    joined = with_item_key(chosen).join(names.drop("refs"), ITEM_KEY).join(references, ITEM_KEY, "left")
    errors = document_errors(
        F.col("item_type"), F.col("unmapped"), **_paths(), readable=F.col("readable"), bounded=bounded
    )
    kept = [c for c in joined.columns if c not in ("readable", "uris", "pending", "unmapped")]
    return joined.select(*kept, _pending().alias("pending"), errors.alias("errors"))


def rewrite_judged(judged: DataFrame, items: DataFrame, *, bounded: bool = False) -> DataFrame:
    """The rows of :func:`judge_items` with ``payload_xml``, the rewritten document as text, of those without errors.

    Texts move, which are smaller than elements, and are parsed, rewritten and written at once where they meet what is known of them:
    of items alone that are left by then, so filter on the other columns. Each text of a key comes once, so that the join is left out
    where no document is asked for.
    """
    on = [*ITEM_KEY, "text_hash"]
    texts = _identified(items).where("xml IS NOT NULL").select(*ITEM_KEY, F.xxhash64("xml").alias("text_hash"), "xml")
    joined = judged.join(texts.repartition(*on).dropDuplicates(on), on, "left")
    text = F.when(F.size("errors") == 0, F.col("xml"))
    payload = rewrite_text(text, F.col("item_type"), F.col("new_ids"), {**_titles(), **_paths()}, bounded=bounded)
    kept = [c for c in judged.columns if c not in ("experiment_key", "text_hash", "new_ids")]
    return joined.select(*kept, payload.alias("payload_xml"))


def reconstruction_counts(items: DataFrame) -> DataFrame:
    """Reconstructions per project that are dropped from documents and not migrated."""
    held = F.filter(F.col("element.children"), lambda c: c["tag"] == clark("xnat:reconstructions"))
    count = F.aggregate(held, F.lit(0), lambda n, c: n + F.size(c["kids"]))
    return items.groupBy("project").agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("reconstructions")
    )


def rewrite_violations(rewritten: DataFrame) -> DataFrame:
    """The errors of :func:`rewrite_items`, one row each."""
    return rewritten.select(
        F.explode("errors").alias("error"), "project", "item_type", F.col("id").alias("item_id")
    ).select("error.check", "project", "item_type", "item_id", "error.detail")
