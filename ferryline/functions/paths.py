"""Column functions that spell the server paths of items.

Writes address parents by label, reads address them by id. Labels are put into paths as
they stand; :func:`share_path` can escape the label it passes as a query value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_COLLECTIONS = {
    "subject": "subjects",
    "experiment": "experiments",
    "scan": "scans",
    "assessor": "assessors",
}


def _by_type(item_type: Column, spell: Callable[[str], Column]) -> Column:
    out = F.when(item_type == "project", spell("project"))
    for name in _COLLECTIONS:
        out = out.when(item_type == name, spell(name))
    return out


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _below_project(kind: str, subject: Column, experiment: Column) -> list[Column | str]:
    if kind == "subject":
        return []
    parts: list[Column | str] = ["/subjects/", subject]
    if kind in ("scan", "assessor"):
        parts += ["/experiments/", experiment]
    return parts


def target_path(
    item_type: Column, dst_project: Column, subject_label: Column, experiment_label: Column
) -> Column:
    """Collection a missing item is created in."""

    def spell(kind: str) -> Column:
        if kind == "project":
            return F.lit("/data/projects")
        parents = _below_project(kind, subject_label, experiment_label)
        return _join("/data/projects/", dst_project, *parents, f"/{_COLLECTIONS[kind]}")

    return _by_type(item_type, spell)


def source_path(
    item_type: Column, src_project: Column, subject_id: Column, experiment_id: Column, id_: Column
) -> Column:
    """Location an item's document is read from."""

    def spell(kind: str) -> Column:
        if kind == "project":
            return _join("/data/projects/", src_project)
        parents = _below_project(kind, subject_id, experiment_id)
        return _join("/data/projects/", src_project, *parents, f"/{_COLLECTIONS[kind]}/", id_)

    return _by_type(item_type, spell)


def refresh_path(
    item_type: Column,
    project: Column,
    subject_label: Column,
    experiment_label: Column,
    id_: Column,
    label: Column,
) -> Column:
    """Catalogue location of an item; scans go by id, everything else by label."""

    def spell(kind: str) -> Column:
        if kind == "project":
            return _join("/archive/projects/", project)
        parents = _below_project(kind, subject_label, experiment_label)
        name = id_ if kind == "scan" else label
        return _join("/archive/projects/", project, *parents, f"/{_COLLECTIONS[kind]}/", name)

    return _by_type(item_type, spell)


def viewer_path(project: Column, experiment_id: Column) -> Column:
    """Location that regenerates an experiment's viewer session, by id."""
    return _join("/xapi/viewer/projects/", project, "/experiments/", experiment_id)


def share_path(
    item_type: Column,
    owner: Column,
    destination_id: Column,
    project: Column,
    label: Column,
    *,
    escape: bool = False,
) -> Column:
    """Request that shows an item in a further project under its label."""
    kind = F.when(item_type == "subject", "subjects")
    kind = kind.when(item_type == "experiment", "experiments")
    kind = kind.when(item_type == "assessor", "assessors")
    name = F.url_encode(label) if escape else label
    return _join(
        "/data/projects/", owner, "/", kind, "/", destination_id, "/projects/", project,
        "?label=", name,
    )


def config_path(dst_project: Column, tool: Column, path: Column) -> Column:
    """Location of one setting of one tool."""
    return _join("/data/projects/", dst_project, "/config/", tool, "/", path)


def archive_path(archive: Column, project: Column) -> Column:
    """Root of a project's files as item documents spell it; null if unknown."""
    return _join(archive, "/", project)
