"""Where change records come from: files, Kafka, table snapshots, several systems at once.

A change feed has ``value`` and, where the source gives them, ``source_partition`` and
``source_offset`` (see ``operators.envelope``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.functions.normalize import normalize_frame
from changefeed.operators import envelope

FEED_SCHEMA = "value STRING, source_partition STRING, source_offset STRING"

FILE_FORMATS = ("parquet", "orc", "json", "text")


def from_kafka(df: DataFrame) -> DataFrame:
    """Rows of the Kafka source (key, value, topic, partition, offset, ...) as a feed, with the record's key as text in ``record_key``.

    A record's identity and position are its coordinates: a partition of a topic is a source of its own, in which the offset gives the order. The place that
    the source database gave stays in the envelope.
    """
    place = F.struct(F.col("topic"), F.col("partition"), F.col("offset"))
    return df.select(
        F.col("value").cast("string").alias("value"),
        F.concat(F.lit("{topic="), F.col("topic"), F.lit(", partition="), F.col("partition").cast("string"), F.lit("}")).alias("source_partition"),
        F.to_json(place).alias("source_offset"),
        F.col("key").cast("string").alias("record_key"),
    )


def read_changes(
    spark: SparkSession, path: str | None = None, source: str = "parquet", options: Mapping[str, str] | None = None
) -> DataFrame:
    """Batch scan. ``text`` holds one envelope per line; the other file formats hold feed columns;
    ``kafka`` takes its options (and needs its connector on the class path)."""
    reader = spark.read.options(**(options or {}))
    if source == "kafka":
        return from_kafka(reader.format("kafka").load())
    if source not in FILE_FORMATS:
        raise ValueError(f"source must be kafka or one of {FILE_FORMATS}: {source!r}")
    if source == "text":
        return reader.text(path)
    return reader.schema(FEED_SCHEMA).format(source).load(path)


def stream_changes(
    spark: SparkSession,
    path: str | None = None,
    source: str = "parquet",
    per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same as a stream. ``per_trigger`` bounds a micro-batch: records for kafka, files otherwise."""
    reader = spark.readStream.options(**(options or {}))
    if source == "kafka":
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return from_kafka(reader.format("kafka").load())
    if source not in FILE_FORMATS:
        raise ValueError(f"source must be kafka or one of {FILE_FORMATS}: {source!r}")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if source == "text":
        return reader.format("text").load(path)
    return reader.schema(FEED_SCHEMA).format(source).load(path)


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table to snapshot, read in parallel ranges of ``column``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **(options or {}))
        .load()
    )


def snapshot_changes(
    rows: DataFrame,
    database: str,
    table: str,
    key: Sequence[str],
    at_ms: Column,
    schema: str | None = "public",
    connector: str = "postgresql",
    server: str = "snapshot",
    app_name: str = "changefeed",
    version: str = "1.0.0",
    mode: str = "typed",
    epoch_units: Mapping[str, str] | None = None,
) -> DataFrame:
    """Existing rows as canonical INSERT events (operation code ``r``), values normalized.

    The key values are part of the offset: they make the events of one snapshot distinct.
    """
    marked = rows.select("*", at_ms.cast("bigint").alias("_at_ms"), F.array(*[F.col(k).cast("string") for k in key]).alias("_key"))
    packed = normalize_frame(marked, mode, epoch_units, keep=("_at_ms", "_key"))
    at = F.col("_at_ms")
    offset = F.to_variant_object(
        F.struct(F.lit(True).alias("snapshot"), at.alias("timestamp"), F.to_json("_key").alias("key"))
    )
    table_struct = F.struct(
        F.lit(database).alias("database"), F.lit(schema).cast("string").alias("schema"), F.lit(table).alias("table")
    )
    partition = F.lit(f"{{server={server}}}")
    staged = packed.select(
        table_struct.alias("table"),
        F.timestamp_millis("_at_ms").alias("timestamp"),
        F.struct(
            partition.alias("source_partition"),
            offset.alias("offset"),
            at.alias("ts_key"),
            F.lit(None).cast("bigint").alias("seq_key"),
            F.lit(None).cast("string").alias("log_file"),
            F.lit(None).cast("bigint").alias("log_key"),
        ).alias("position"),
        F.to_variant_object(F.struct(*rows.columns)).alias("after"),
    )
    fqn = ".".join(p for p in (database, schema, table) if p and p.strip())
    event_id = F.sha2(F.concat_ws("|", partition, F.to_json(F.col("position.offset")), F.lit(fqn), F.lit("INSERT")), 256)
    return staged.select(
        event_id.alias("event_id"),
        "table",
        F.lit(fqn).alias("fqn"),
        envelope.decode_operation(F.lit("r")).alias("operation"),
        "timestamp",
        "position",
        F.lit(None).cast("variant").alias("before"),
        "after",
        envelope.metadata_struct(F.lit(connector), app_name, version).alias("metadata"),
        F.col("timestamp").alias("source_ts"),
    )


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Events of several source systems, each marked with its ``source_system``."""
    marked = [events.withColumn("source_system", F.lit(name)) for name, events in sources.items()]
    union = marked[0]
    for events in marked[1:]:
        union = union.unionByName(events)
    return union
