"""Joins with a key that holds much of the rows give what a plain join gives."""

import pytest
from pyspark.sql import functions as F

from ferryline.operators.items import owned_scans
from ferryline.operators.rewrite import resolve_references
from ferryline.operators.users import with_position


@pytest.fixture
def settings(spark):
    """A function that sets values for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def test_plain_joins_are_split_by_adaptive_execution(spark, settings):
    """Scans of one experiment that holds most of them are read by several tasks."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    scans = spark.range(0, 60_000, 1, 8).select(
        F.lit("p").alias("project"),
        F.when(F.col("id") % 10 < 8, "E0").otherwise(F.concat(F.lit("E"), "id")).alias("experiment_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"),
    )
    experiments = scans.select("project", F.col("experiment_id").alias("id")).distinct().select(
        "project", "id", F.lit("experiment").alias("item_type"), F.lit("p").alias("owner_project")
    )
    found = owned_scans(scans, experiments)
    found.write.format("noop").mode("overwrite").save()
    assert found.count() == 60_000
    found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()


def test_resolving_with_hot_names(spark):
    """A name that most items refer to is resolved like any other."""
    refs = spark.range(2000).select(
        F.concat(F.lit("p"), F.col("id") % 2).alias("project"),
        F.lit("scan").alias("item_type"),
        F.lit("").alias("experiment_key"),
        F.col("id").cast("string").alias("id"),
        F.lit(0).alias("ord"),
        F.lit("scan").alias("map_type"),
        F.when(F.col("id") % 4 < 3, "1").when(F.col("id") % 5 == 0, None).otherwise(
            (F.col("id") % 300).cast("string")
        ).alias("source_id"),
    )
    id_map = spark.createDataFrame(
        [("p0", "scan", str(i), f"own{i}", 0) for i in range(0, 300, 3)]
        + [("p9", "scan", "1", "late", 9), ("p8", "scan", "1", "early", 8)],
        "src_project STRING, map_type STRING, source_id STRING, destination_id STRING, seq LONG",
    )
    found = resolve_references(refs, id_map)
    assert found.count() == 2000

    def expected(project, name):
        if name is None:
            return None
        # Numbers of scans mean nothing in other projects.
        return f"own{name}" if project == "p0" and int(name) % 3 == 0 else None

    for row in found.collect():
        assert row["new_id"] == expected(row["project"], row["source_id"])


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_positions(spark, n):
    # Far from evenly spread.
    rows = spark.range(n).select((F.col("id") * F.col("id") * F.col("id") % 1_000_003).alias("x"))
    rows = rows.distinct()
    found = with_position(rows, "x", ranges=64).orderBy("x").collect()
    assert [row["pos"] for row in found] == list(range(len(found)))
