"""Putting the operators together."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.functions.paths import target_path
from ferryline.functions.xmlio import to_xml
from ferryline.operators import catalogs, checks, configs, conflicts, files, identity, metadata, sharing, users
from ferryline.operators.items import (
    may_be_owned,
    missing_items,
    owned_items,
    owner_violations,
    with_destination,
    with_owner,
    with_presence,
)
from ferryline.operators.rewrite import (
    ITEM_KEY,
    document_names,
    item_references,
    judge_items,
    plannable,
    remap_references,
    rewrite_items,
    rewrite_judged,
    rewrite_violations,
    with_item_key,
)
from ferryline.session import without_shuffles
from ferryline.sources.projects import root_violations


class Staging:
    """A folder, shared by all executors, for tables that several plans read.

    Plans stay plans without one: nothing is written unless it is asked for. As a context
    manager it removes what was written, so carry the plans out inside.
    """

    def __init__(self, spark: SparkSession, uri: str):
        if "://" not in uri:
            raise ValueError("name the file system: a bare path is another folder on each machine")
        self._spark, self._folder = spark, f"{uri.rstrip('/')}/staging-{uuid.uuid4().hex}"
        self._written: dict[str, str] = {}

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()

    def path(self, name: str) -> str:
        """A new folder in here, for something that is written by other means."""
        return f"{self._folder}/{name}-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        """Write rows now, and go on from what was written; the shuffles that led to them are removed."""
        path = self._written[name] = self.path(name)
        with without_shuffles(self._spark):
            rows.write.parquet(path)
        return self._spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Delete what was last written by these names, when nothing reads it any more."""
        for name in names:
            self._at(self._written.pop(name), lambda system, path: system.delete(path, True))

    def remove(self) -> None:
        """Delete all that was written here."""
        self._at(self._folder, lambda system, path: system.delete(path, True))

    def remove_at_exit(self) -> None:
        """Delete all that was written here when the driver ends, for results that are read at any time until then."""
        self._at(self._folder, lambda system, path: (system.mkdirs(path), system.deleteOnExit(path)))

    def _at(self, folder: str, do: Callable) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(folder)
        do(path.getFileSystem(self._spark._jsc.hadoopConfiguration()), path)


def missing_targets(
    src_items: DataFrame, dst_items: DataFrame, project_map: DataFrame
) -> DataFrame:
    """Owned items the destination lacks, with the collection to create each in."""
    owned = with_destination(owned_items(src_items), project_map)
    columns = [F.col(c) for c in ("item_type", "dst_project", "subject_label", "experiment_label")]
    return missing_items(owned, dst_items).withColumn("target_path", target_path(*columns))


_DOCUMENT = ("xml", "element", "refs", "uris")


def item_facts(src_items: DataFrame) -> DataFrame:
    """Items without their documents, whose owner is read from the document where the listing names none.

    Many parts of a plan start from these, and documents are nearly all there is to read, so the column is read for items alone whose
    owner is asked for and not named: a filter that the scan gets, and that skips whole row groups.
    """
    if "xml" not in src_items.columns and "element" not in src_items.columns:
        return src_items
    unasked = F.coalesce(F.col("item_type").isin("project", "scan"), F.lit(False))
    named = src_items.where(F.col("owner_project").isNotNull() | unasked).drop(*_DOCUMENT)
    others = with_owner(src_items.where(F.col("owner_project").isNull() & ~unasked)).drop(*_DOCUMENT)
    return named.unionByName(others)


def _owned(facts: DataFrame, project_map: DataFrame, files_only: bool) -> DataFrame:
    """Owned items of visited projects; projects, if they are all there is, own themselves."""
    return with_destination(facts if files_only else owned_items(facts), project_map)


# What plans, violations and the closure read of items.
_PLANNED = (
    *("project", "item_type", "id", "label", "subject_id", "subject_label", "experiment_id", "experiment_label"),
    *("dst_project", "dst_secondary_id", "dst_name", "src_archive", "dst_archive", "is_missing"),
)


def rewritten_items(
    src_items: DataFrame,
    dst_items: DataFrame,
    project_map: DataFrame,
    id_map: DataFrame,
    *,
    files_only: bool = False,
    bounded: bool = False,
    only: DataFrame | None = None,
    facts: DataFrame | None = None,
    staging: Staging | None = None,
) -> DataFrame:
    """Owned items of visited projects with their rewritten documents, ``errors``, ``pending`` and ``is_missing``.

    What the create plan, its violations and :func:`~ferryline.plans.closure.blocked_items` are read from. Each document is
    parsed once. ``only`` limits the documents that are read to its items (``ITEM_KEY``), as for a later run; what they
    refer to is looked up among all items nevertheless. ``facts`` are those of :func:`item_facts`, if they are at hand.

    With ``staging`` all but the documents is written first, step by step, narrow, so that no more than one step's shuffles are there at
    once. Documents are read where they lie for what they refer to, and move as texts, once, if they are asked for; of those that are
    wanted the rewritten text is made, ``payload_xml`` instead of ``element``. Columns that no plan reads are left out.
    """
    if files_only:
        src_items = src_items.where(F.col("item_type") == "project")
    facts = item_facts(src_items) if facts is None else facts
    src_items = with_owner(src_items)
    owned = with_presence(_owned(facts, project_map, files_only), dst_items)
    documents = may_be_owned(src_items, project_map)
    if only is not None:
        documents = with_item_key(documents).join(only.select(*ITEM_KEY), ITEM_KEY, "left_semi").drop("experiment_key")
    if staging is None or "xml" not in src_items.columns:
        planned = plannable(owned.where("is_missing"))
        return rewrite_items(documents, project_map, id_map, chosen=owned, planned=planned, bounded=bounded)
    owned = staging.write(owned.select(*_PLANNED), "owned")
    if only is not None:
        documents = staging.write(documents.select("project", "item_type", "experiment_id", "id", "xml"), "documents")
    names = staging.write(document_names(documents), "names")
    planned = plannable(owned.where("is_missing"))
    references = staging.write(remap_references(item_references(names), id_map, planned), "references")
    judged = staging.write(judge_items(names, references, chosen=owned, bounded=bounded), "judged")
    staging.drop("owned", "names", "references")
    return rewrite_judged(judged, documents, bounded=bounded)


def plan_rows(rewritten: DataFrame) -> DataFrame:
    """The items of :func:`rewritten_items` that can be created, with where, in what order and as what."""
    ready = rewritten.where(F.col("is_missing") & (F.size("errors") == 0))
    kind = F.col("item_type")
    level = F.when(kind == "project", 0).when(kind == "subject", 1).when(kind == "experiment", 2)
    place = [F.col(c) for c in ("item_type", "dst_project", "subject_label", "experiment_label")]
    return ready.select(
        "project",
        "experiment_id",
        "dst_project",
        "item_type",
        F.col("id").alias("source_id"),
        "label",
        target_path(*place).alias("target_path"),
        level.otherwise(3).alias("level"),
        F.when(F.size("pending") > 0, "waiting").otherwise("ready").alias("status"),
        "pending",
        F.col("payload_xml") if "payload_xml" in rewritten.columns else to_xml("element").alias("payload_xml"),
    )


def create_plan(
    src_items: DataFrame,
    dst_items: DataFrame,
    project_map: DataFrame,
    id_map: DataFrame,
    *,
    files_only: bool = False,
    bounded: bool = False,
    staging: Staging | None = None,
    only: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Items to create with their documents, and what keeps owned items from it.

    One run plans the whole tree. ``level`` is 0 for projects to 3 for scans and assessors; ``status``
    is ``ready``, or ``waiting`` for an item that refers to others of the plan: ``pending`` lists
    them, and its document holds their old ids until theirs are known, see
    :func:`~ferryline.plans.completion.complete_plan`. Items whose owner no
    one names, documents with references to nothing and other errors are violations, whether
    the item is missing or not. Documents of owned items of visited projects alone are moved and parsed (and those of
    scans in sessions that are shown there), and those of missing items without errors written. ``files_only`` leaves
    every level but the project out. With ``staging`` the steps before the documents are rewritten are carried out and written, see
    :func:`rewritten_items`.
    """
    if files_only:
        src_items = src_items.where(F.col("item_type") == "project")
    facts = item_facts(src_items)
    options = {"files_only": files_only, "bounded": bounded, "only": only, "facts": facts, "staging": staging}
    rewritten = rewritten_items(src_items, dst_items, project_map, id_map, **options)
    unknown = owner_violations(facts, project_map)
    return plan_rows(rewritten), rewrite_violations(rewritten).unionByName(unknown)


@dataclass
class Inputs:
    """Tables a migration is planned from; see :mod:`ferryline.model` for their columns.

    ``dst_after`` is the destination's listing after items were created; before that it
    is the same as ``dst_items``.
    """

    project_map: DataFrame
    src_items: DataFrame
    dst_items: DataFrame
    src_datatypes: DataFrame
    dst_datatypes: DataFrame
    schema_datatypes: DataFrame
    src_users: DataFrame
    dst_users: DataFrame
    metadata: DataFrame
    settings: DataFrame
    src_files: DataFrame
    dst_files: DataFrame
    dst_after: DataFrame | None = None


def migration_plan(
    inputs: Inputs, *, files_only: bool = False, staging: Staging | None = None
) -> dict[str, DataFrame]:
    """All plans of a migration, by name, in the order they are to be carried out.

    Each is a plan of its own that runs when it is written or counted; with ``staging`` what
    several need is computed and written first. ``violations``
    gathers what should be looked at first. With ``files_only`` nothing below projects is
    created or mapped; users, metadata, settings, files and refresh are planned as ever.
    """
    pairs, items = inputs.project_map, inputs.src_items
    after = inputs.dst_items if inputs.dst_after is None else inputs.dst_after
    if files_only:
        items = items.where(F.col("item_type") == "project")
    facts = item_facts(items)
    if staging is not None:
        facts = staging.write(facts, "facts")

    owned = _owned(facts, pairs, files_only)
    resolved = identity.resolve_ids(owned, after)
    if staging is not None:
        resolved = staging.write(resolved, "resolved")
    id_map = identity.dedupe_id_map(resolved)
    failures = identity.failure_counts(resolved, pairs)
    if staging is not None:
        id_map, failures = staging.write(id_map, "id_map"), staging.write(failures, "failures")
        staging.drop("resolved")
    rewritten = rewritten_items(
        items, inputs.dst_items, pairs, id_map, files_only=files_only, facts=facts, staging=staging
    )
    shares = sharing.share_rows(facts, pairs, id_map)
    if staging is not None:
        shares = staging.write(shares, "shares")

    missing = checks.missing_datatypes(inputs.src_datatypes, inputs.dst_datatypes)
    experiments = with_destination(facts.where(F.col("item_type") == "experiment"), pairs)
    unsupported = checks.unsupported_experiments(experiments, inputs.schema_datatypes)
    aligned = users.align_users(inputs.src_users, inputs.dst_users)
    return {
        "violations": checks.all_violations(
            root_violations(pairs),
            checks.datatype_violations(missing),
            checks.experiment_violations(unsupported),
            users.user_violations(aligned),
            rewrite_violations(rewritten),
            owner_violations(facts, pairs),
            conflicts.conflict_violations(owned, inputs.dst_items),
            sharing.unplanned_shares(shares),
        ),
        "users": users.users_to_create(inputs.src_users, inputs.dst_users),
        "metadata": metadata.metadata_columns(with_destination(inputs.metadata, pairs)),
        "files": files.files_to_copy(inputs.src_files, inputs.dst_files, pairs),
        "transfer": files.transfer_stats(inputs.src_files, inputs.dst_files, pairs),
        "create": plan_rows(rewritten),
        "failures": identity.running_failures(failures),
        "totals": identity.subject_totals(facts, pairs),
        "config": configs.config_plan(inputs.settings, pairs),
        "id_map": id_map,
        "refresh": catalogs.refresh_paths(
            after.join(
                pairs.select(F.col("dst_project").alias("project")), "project", "left_semi"
            )
        ),
        "share": sharing.planned_shares(shares),
    }
