"""Column functions on names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryline.model import EXTERNAL_USER_SUFFIX, ID_NAMESPACES, INTERNAL_DATATYPE_PREFIX


def literal_map(values: dict[str, str]) -> Column:
    """A constant map, folded by the optimizer."""
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def id_namespace(item_type: Column) -> Column:
    """Namespace the ids of an item type live in; null for types that have none."""
    return F.try_element_at(literal_map(ID_NAMESPACES), item_type)


def strip_ext(username: Column) -> Column:
    """Drop one trailing external-account marker."""
    size = len(EXTERNAL_USER_SUFFIX)
    kept = F.substring(username, F.lit(1), F.length(username) - size)
    return F.when(F.endswith(username, F.lit(EXTERNAL_USER_SUFFIX)), kept).otherwise(username)


def is_user_datatype(name: Column) -> Column:
    """Whether a datatype is not one of the server's internal ones (case-sensitive)."""
    return ~F.startswith(name, F.lit(INTERNAL_DATATYPE_PREFIX))
