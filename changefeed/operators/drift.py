"""Schema drift: columns of a table compared between consecutive versions.

A schema table has ``fqn``, ``version`` (integer), ``column`` and ``type``, one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changefeed.operators.envelope import image_fields
from changefeed.operators.skew import previous_row

SCHEMA_COLUMNS = "fqn STRING, version BIGINT, column STRING, type STRING"


UNKNOWN_TYPE = "VOID"


def observed_schema(events: DataFrame, version: int) -> DataFrame:
    """Columns and JSON types seen in the images of ``events``, as one version per table.

    All numbers are NUMBER, as JSON does not tell 5 from 5.0. A column that is only ever null has type
    VOID; of several types the last by name counts, so the result does not depend on row order.
    """
    images = F.filter(F.array(image_fields(F.col("before")), image_fields(F.col("after"))), lambda m: m.isNotNull())
    name = F.regexp_replace(F.schema_of_variant("_value"), r"[(<].*", "")
    kind = F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit("NUMBER")).otherwise(name)
    return (
        events.select("fqn", F.explode(images).alias("_fields"))
        .select("fqn", F.explode("_fields").alias("column", "_value"))
        .groupBy("fqn", "column")
        .agg(F.max(F.when(kind != UNKNOWN_TYPE, kind)).alias("_type"))
        .select("fqn", F.lit(version).cast("bigint").alias("version"), "column",
                F.coalesce("_type", F.lit(UNKNOWN_TYPE)).alias("type"))
    )


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """Columns of each table's newest version."""
    newest = schemas.groupBy("fqn").agg(F.max("version").alias("version"))
    return schemas.join(newest, ["fqn", "version"])


def _classify(paired: DataFrame) -> DataFrame:
    """Paired (fqn, version, column, old_type, new_type) rows to changes.

    Exactly one column gone and one new of the same type, in one step of one table, is a rename.
    """
    step = Window.partitionBy("fqn", "version")
    added, removed = F.col("old_type").isNull(), F.col("new_type").isNull()
    marked = paired.where(~F.col("old_type").eqNullSafe(F.col("new_type"))).select(
        "*",
        (F.count_if(added).over(step) == 1).alias("_one_added"),
        (F.count_if(removed).over(step) == 1).alias("_one_removed"),
        F.max(F.when(added, F.col("column"))).over(step).alias("_added"),
        F.max(F.when(added, F.col("new_type"))).over(step).alias("_added_type"),
        F.max(F.when(removed, F.col("old_type"))).over(step).alias("_removed_type"),
    )
    renamed = F.col("_one_added") & F.col("_one_removed") & (F.col("_added_type") == F.col("_removed_type"))
    kind = (
        F.when(added, F.lit("COLUMN_ADDED"))
        .when(removed & renamed, F.lit("COLUMN_RENAMED"))
        .when(removed, F.lit("COLUMN_REMOVED"))
        .otherwise(F.lit("TYPE_CHANGED"))
    )
    return marked.where(~(added & F.coalesce(renamed, F.lit(False)))).select(
        "fqn",
        "version",
        kind.alias("change"),
        "column",
        F.when(kind == "COLUMN_RENAMED", F.col("_added")).alias("new_name"),
        F.when(kind != "COLUMN_RENAMED", F.col("old_type")).alias("old_type"),
        "new_type",
    )


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Changes between consecutive versions of each table; a table's first version is its baseline."""
    versions = previous_row(schemas.select("fqn", "version").distinct(), ["fqn"], "version", ["version"])
    steps = versions.where(F.col("p_version").isNotNull())
    old = schemas.select("fqn", F.col("version").alias("p_version"), "column", F.col("type").alias("old_type"))
    before = steps.join(old, ["fqn", "p_version"]).select("fqn", "version", "column", "old_type")
    after = schemas.join(steps.select("fqn", "version"), ["fqn", "version"]).select(
        "fqn", "version", "column", F.col("type").alias("new_type")
    )
    return _classify(before.join(after, ["fqn", "version", "column"], "full_outer"))


def _against_newest(observed: DataFrame, registered: DataFrame) -> DataFrame:
    """(fqn, version, column, old_type, new_type) of the observed tables; a table not registered yet has
    no old types. A type not known on one side is taken from the other."""
    newest = latest_schemas(registered).select("fqn", "column", F.col("type").alias("old_type"))
    tables = observed.select("fqn", "version").distinct()
    before = newest.join(tables, "fqn").select("fqn", "version", "column", "old_type")
    after = observed.select("fqn", "version", "column", F.col("type").alias("new_type"))
    old, new = F.col("old_type"), F.col("new_type")
    return before.join(after, ["fqn", "version", "column"], "full_outer").select(
        "fqn",
        "version",
        "column",
        F.when((old == UNKNOWN_TYPE) & new.isNotNull(), new).otherwise(old).alias("old_type"),
        F.when((new == UNKNOWN_TYPE) & old.isNotNull(), old).otherwise(new).alias("new_type"),
    )


def detect_changes(observed: DataFrame, registered: DataFrame) -> DataFrame:
    """Changes of ``observed`` (one version per table) against the newest registered version of its tables.

    A table that is not registered yet has no changes.
    """
    known = registered.select("fqn").distinct()
    return _classify(_against_newest(observed, registered).join(known, "fqn", "left_semi"))


def schemas_to_register(observed: DataFrame, registered: DataFrame) -> DataFrame:
    """New versions for the tables of ``observed``, types filled in from the registered version."""
    return (
        _against_newest(observed, registered)
        .where(F.col("new_type").isNotNull())
        .select("fqn", "version", "column", F.col("new_type").alias("type"))
    )
