"""Native column functions that rewrite :data:`~ferryline.model.ELEMENT` structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryline.functions.ids import literal_map
from ferryline.functions.uris import rewrite_uri
from ferryline.model import (
    DROPPED_TAGS,
    FILE_TAG,
    GENERIC_SCAN_TAG,
    MODALITY_TAG,
    MODALITY_TAGS,
    NAME_TAG,
    NESTED_URI_TAGS,
    OTHER_SCAN_TAG,
    REFERENCE_TAGS,
)


def set_attr(attrs: Column, name: str, value: Column) -> Column:
    """Set an attribute in place, or add it at the end."""
    return F.map_zip_with(
        attrs,
        F.create_map(F.lit(name), value),
        lambda key, old, new: F.when(key == name, new).otherwise(old),
    )


def drop_id_attr(attrs: Column, item_type: Column) -> Column:
    """Drop ``ID``, which the destination assigns, except on projects and scans."""
    return F.when(item_type.isin("project", "scan"), attrs).otherwise(
        F.map_filter(attrs, lambda k, _: k != "ID")
    )


def set_project_attr(attrs: Column, dst_project: Column) -> Column:
    """Point ``project`` at the destination project, whether or not it was there."""
    return set_attr(attrs, "project", dst_project)


def retitle_attrs(
    attrs: Column, item_type: Column, dst_project: Column, secondary_id: Column
) -> Column:
    """Give a project document its destination id and secondary id."""
    titled = set_attr(set_attr(attrs, "ID", dst_project), "secondary_ID", secondary_id)
    return F.when(item_type == "project", titled).otherwise(attrs)


def retitle_children(children: Column, item_type: Column, name: Column) -> Column:
    """Give every direct name child of a project document the destination name."""
    titled = F.transform(
        children,
        lambda c: F.when(c["tag"] == NAME_TAG, c.withField("text", name)).otherwise(c),
    )
    return F.when(item_type == "project", titled).otherwise(children)


def drop_child_tags(children: Column, tags: tuple[str, ...] = DROPPED_TAGS) -> Column:
    """Drop direct children by tag."""
    return F.filter(children, lambda c: ~c["tag"].isin(*tags))


def modalities(children: Column) -> Column:
    """Texts of the modality children."""
    return F.transform(F.filter(children, lambda c: c["tag"] == MODALITY_TAG), lambda c: c["text"])


def scan_tag(tag: Column, modality_texts: Column) -> Column:
    """Specific root tag of a generic scan with exactly one known, non-empty modality."""
    given = F.filter(modality_texts, lambda m: m != "")
    specific = F.when(
        F.size(given) == 1, F.try_element_at(literal_map(MODALITY_TAGS), F.get(given, F.lit(0)))
    )
    return F.when(tag == GENERIC_SCAN_TAG, F.coalesce(specific, F.lit(OTHER_SCAN_TAG))).otherwise(
        tag
    )


def references(children: Column) -> Column:
    """``ARRAY<STRUCT<ord, map_type, source_id>>`` of the children that name other items."""
    hits = F.filter(children, lambda c: c["tag"].isin(*REFERENCE_TAGS))
    kind = literal_map(REFERENCE_TAGS)
    return F.transform(
        hits,
        lambda c: F.struct(
            c["ord"].alias("ord"),
            F.element_at(kind, c["tag"]).alias("map_type"),
            c["text"].alias("source_id"),
        ),
    )


def replace_references(children: Column, new_ids: Column) -> Column:
    """Put the ids of a ``MAP<ord, id>`` into the children that name other items.

    A name that has no id there stays.
    """
    return F.transform(
        children,
        lambda c: F.when(
            c["tag"].isin(*REFERENCE_TAGS),
            c.withField("text", F.coalesce(F.try_element_at(new_ids, c["ord"]), c["text"])),
        ).otherwise(c),
    )


def item_uris(children: Column) -> Column:
    """File locations of a document: those of files, and of the children below that hold some."""
    direct = F.transform(
        F.filter(children, lambda c: c["tag"] == FILE_TAG), lambda c: c["attrs"]["URI"]
    )

    def below(parent: str, tag: str) -> Column:
        holders = F.filter(children, lambda c: c["tag"] == parent)
        return F.flatten(
            F.transform(
                holders,
                lambda c: F.transform(
                    F.filter(c["kids"], lambda k: k["tag"] == tag), lambda k: k["attrs"]["URI"]
                ),
            )
        )

    nested = [below(parent, tag) for parent, tag in NESTED_URI_TAGS.items()]
    return F.filter(F.concat(direct, *nested), lambda uri: uri.isNotNull())


def rewrite_item_uris(
    children: Column, src: Column, dst: Column, *, bounded: bool = False
) -> Column:
    """Rewrite the locations :func:`item_uris` lists and no others."""

    def moved(node: Column) -> Column:
        attrs = F.transform_values(
            node["attrs"],
            lambda k, v: F.when(k == "URI", rewrite_uri(v, src, dst, bounded=bounded)).otherwise(v),
        )
        return node.withField("attrs", attrs)

    def kids_moved(child: Column, tag: str) -> Column:
        return F.transform(child["kids"], lambda k: F.when(k["tag"] == tag, moved(k)).otherwise(k))

    def one(child: Column) -> Column:
        out = F.when(child["tag"] == FILE_TAG, moved(child))
        for parent, tag in NESTED_URI_TAGS.items():
            moved_child = child.withField("kids", kids_moved(child, tag))
            out = out.when(child["tag"] == parent, moved_child)
        return out.otherwise(child)

    return F.transform(children, one)


