"""Accounts the destination lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferryline.functions.ids import strip_ext
from ferryline.operators.checks import violation


def with_position(
    rows: DataFrame, order_by: str, *, position: str = "pos", ranges: int = 64
) -> DataFrame:
    """Number rows from 0 by a unique numeric column without sorting them in one task.

    Approximate quantiles of ``order_by``, a subquery of the plan, part the rows into ranges; rows are then numbered within
    their range and shifted by the sizes of the ranges before it. No job runs before the plan does.
    """
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    bounds = rows.agg(F.percentile_approx(order_by, cuts, F.lit(100 * ranges)).alias("bounds")).scalar()
    bounded = rows.withColumn("_bounds", bounds)
    before_key = F.filter("_bounds", lambda bound: bound < F.col(order_by))
    placed = bounded.withColumn("_range", F.coalesce(F.size(before_key), F.lit(0))).drop("_bounds")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so this window and its broadcast stay under `ranges` rows.
    starts = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order_by)) - 1
    return (
        placed.withColumn("_within", within)
        .join(F.broadcast(starts), "_range")
        .withColumn(position, F.col("_start") + F.col("_within"))
        .drop("_range", "_within", "_start")
    )


def align_users(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Compare the profiles at each position of both lists.

    ``status`` is ``id_conflict`` where both have one and the ids differ, else
    ``username_mismatch``, ``match``, ``source_only`` or ``destination_only``.
    """
    src = source.select("pos", F.col("id").alias("source_id"), F.col("username").alias("source_username"))
    dst = destination.select(
        "pos", F.col("id").alias("destination_id"), F.col("username").alias("destination_username")
    )
    both = src.withColumn("_s", F.lit(True)).join(
        dst.withColumn("_d", F.lit(True)), "pos", "full_outer"
    )
    status = (
        F.when(F.col("_d").isNull(), "source_only")
        .when(F.col("_s").isNull(), "destination_only")
        .when(~F.col("source_id").eqNullSafe(F.col("destination_id")), "id_conflict")
        .when(~F.col("source_username").eqNullSafe(F.col("destination_username")), "username_mismatch")
        .otherwise("match")
    )
    return both.withColumn("status", status).drop("_s", "_d")


def user_violations(aligned: DataFrame) -> DataFrame:
    """Positions whose ids differ; the reason not to create any user in strict mode."""
    return violation(
        aligned.where(F.col("status") == "id_conflict"),
        "user_id_conflict",
        item_id=F.col("source_username"),
        detail=F.concat_ws(" != ", "source_id", "destination_id"),
    )


def user_payload(profiles: DataFrame) -> DataFrame:
    """What is sent to create a user; the id is assigned by the destination."""
    return profiles.select(
        strip_ext(F.col("username")).alias("username"),
        "enabled",
        "email",
        "verified",
        "firstName",
        "lastName",
    )


def users_to_create(source: DataFrame, destination: DataFrame, *, by: str = "position") -> DataFrame:
    """Payloads of the users to create.

    ``by="position"`` takes the tail of the source list beyond the destination's length;
    ``by="username"`` takes the source users whose name the destination does not have.
    """
    if by == "position":
        length = destination.agg(F.count(F.lit(1)).alias("length"))
        chosen = source.where(F.col("pos") >= length.scalar())
    elif by == "username":
        names = destination.select(F.col("username").alias("_name")).distinct()
        chosen = source.withColumn("_name", strip_ext(F.col("username"))).join(
            names, "_name", "left_anti"
        )
    else:
        raise ValueError(f"users are chosen by position or username, not by {by!r}")
    return user_payload(chosen)
