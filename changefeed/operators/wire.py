"""Outgoing JSON and its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.functions.instants import iso_instant

# The outgoing contract.
WIRE_OPERATIONS = ("INSERT", "UPDATE", "DELETE")
WIRE_CONNECTORS = ("postgres", "mysql", "sqlserver", "oracle")
VERSION_PATTERN = r"\A\d+\.\d+\.\d+\z"
TIME_PATTERN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"

_WIRE_SCHEMA = (
    "`table` STRUCT<database: STRING, `schema`: VARIANT, `table`: STRING>, operation STRING, `timestamp` STRING, "
    "position STRUCT<sourcePartition: STRING, offset: VARIANT>, before VARIANT, after VARIANT, "
    "metadata STRUCT<source: STRING, version: STRING, connector: STRING, schemaVersion: BIGINT>, _bad STRING"
)


def to_wire_json() -> Column:
    """Canonical event as JSON text. Absent images and a NULL schema are left out; NULL columns inside
    an image are kept."""
    return F.to_json(
        F.struct(
            F.col("table"),
            F.col("operation"),
            iso_instant(F.col("timestamp")).alias("timestamp"),
            F.struct(
                F.col("position.source_partition").alias("sourcePartition"),
                F.col("position.offset").alias("offset"),
            ).alias("position"),
            F.col("before"),
            F.col("after"),
            F.col("metadata"),
        )
    )


def _kind(value: Column) -> Column:
    """'object', 'null' (JSON null or absent) or 'other'."""
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit("null"))
        .when(F.try_variant_get(value, "$", "struct<_:variant>").isNotNull(), F.lit("object"))
        .otherwise(F.lit("other"))
    )


def wire_violations(wire: Column) -> dict[str, Column]:
    """Boolean column per contract rule, over ``wire`` parsed by ``parse_wire``; true where it is broken."""
    table, metadata, position = wire["table"], wire["metadata"], wire["position"]
    before, after = _kind(wire["before"]), _kind(wire["after"])
    expected = (
        F.when(wire["operation"] == "INSERT", (before == "null") & (after == "object"))
        .when(wire["operation"] == "UPDATE", (before == "object") & (after == "object"))
        .when(wire["operation"] == "DELETE", (before == "object") & (after == "null"))
    )
    missing = (
        table.isNull() | wire["operation"].isNull() | wire["timestamp"].isNull() | position.isNull() | metadata.isNull()
    )
    checks = {
        "not_json": wire.isNull() | wire["_bad"].isNotNull(),
        "required": missing,
        "table": F.coalesce(table["database"], F.lit("")).eqNullSafe("")
        | F.coalesce(table["table"], F.lit("")).eqNullSafe(""),
        "operation_enum": ~wire["operation"].isin(*WIRE_OPERATIONS),
        "timestamp_format": ~wire["timestamp"].rlike(TIME_PATTERN),
        "position": position["sourcePartition"].isNull() | (_kind(position["offset"]) != "object"),
        "metadata_required": metadata["source"].isNull() | metadata["version"].isNull(),
        "version_pattern": ~metadata["version"].rlike(VERSION_PATTERN),
        "connector_enum": ~metadata["connector"].isin(*WIRE_CONNECTORS),
        "schema_version": metadata["schemaVersion"] < 1,
        "images": ~expected,
    }
    return {rule: F.coalesce(broken, F.lit(False)) for rule, broken in checks.items()}


def parse_wire(messages: DataFrame, value: str = "value") -> DataFrame:
    parsed = F.from_json(value, _WIRE_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    return messages.select("*", F.explode(F.array(parsed)).alias("wire"))


def validate_wire(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row per contract rule with the number of messages that break it."""
    checks = wire_violations(F.col("wire"))
    counts = parse_wire(messages, value).agg(*[F.count_if(broken).alias(rule) for rule, broken in checks.items()])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in checks]))
    )


def to_messages(routed: DataFrame) -> DataFrame:
    """Routed events as ``topic``, ``key``, ``value``, the row contract of a Kafka sink, with ``event_id`` and ``position``, by which a sink orders them."""
    return routed.select("topic", "key", to_wire_json().alias("value"), "event_id", "position")
