"""Where events go: Kafka, files by topic, dead letters, saved positions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.operators.positions import latest_positions, order_parts, with_order
from changefeed.sources import folders

# Producer settings.
PRODUCER_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.retries": "3",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "10",
    "kafka.compression.type": "snappy",
}

POSITION = (
    "STRUCT<source_partition: STRING, offset: VARIANT, ts_key: BIGINT, seq_key: BIGINT, log_file: STRING, "
    "log_key: BIGINT>"
)
POSITIONS_SCHEMA = f"source_partition STRING, position {POSITION}"


# What a sink is given: the messages of a batch (MESSAGE) and the batch's number.
Sink = Callable[[DataFrame, int], None]
MESSAGE = ("topic", "key", "value", "event_id", "position")

ROWS_PER_FILE = 100_000


def write_kafka(messages: DataFrame, servers: str, options: Mapping[str, str] | None = None):
    """Publish (topic, key, value) and, where they have them, headers. A batch is written at once; for a stream the writer is returned,
    to be given a checkpoint and started."""
    settings = {"kafka.bootstrap.servers": servers, **PRODUCER_OPTIONS, **(options or {})}
    rows = messages.select("topic", "key", "value", *[c for c in messages.columns if c == "headers"])
    if messages.isStreaming:
        return rows.writeStream.format("kafka").options(**settings)
    return rows.write.format("kafka").options(**settings).save()


def in_key_order(messages: DataFrame) -> DataFrame:
    """Messages (MESSAGE) dealt out by topic and key, in log order within a key: what one task sends of a key, it sends in order, and nobody else sends of it.

    A hot table whose rows have keys of their own fills many tasks; all messages of one key need one.
    """
    dealt, order = with_order(messages.repartition("topic", "key"), order_parts())
    return dealt.sortWithinPartitions("topic", "key", *order, "event_id").select(*messages.columns)


def kafka_sink(servers: str, options: Mapping[str, str] | None = None) -> Sink:
    """A sink that publishes a batch to Kafka, in order within each key.

    A batch that runs again is sent again, in the same order: the header event_id lets consumers leave out what they have.
    """
    header = F.struct(F.lit("event_id").alias("key"), F.col("event_id").cast("binary").alias("value"))

    def publish(messages: DataFrame, batch_id: int) -> None:
        write_kafka(in_key_order(messages).withColumn("headers", F.array(header)), servers, options)

    return publish


def file_sink(path: str, rows_per_file: int = ROWS_PER_FILE) -> Sink:
    """A sink that writes each batch to files by topic, in order, under its own folder; a batch that runs again replaces what it wrote."""

    def publish(messages: DataFrame, batch_id: int) -> None:
        write_in_order(messages, f"{path}/batch_id={batch_id}", rows_per_file)

    return publish


def write_in_order(messages: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per topic; its files, by name, hold the messages (MESSAGE) in log order.

    Messages are dealt out by ranges of topic and position, as many as files of ``rows_per_file`` need, so a hot topic, or one hot key of it, fills many
    tasks and n messages make at most n / rows_per_file files and one more for each topic.
    """
    ranges = -(-messages.count() // rows_per_file) or 1
    keyed, order = with_order(messages, order_parts())
    keys = ["topic", *order, "event_id"]
    ordered = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    ordered.select("topic", "key", "value").write.mode("overwrite").partitionBy("topic").parquet(path)


def write_by_topic(messages: DataFrame, path: str, source: str = "parquet") -> None:
    """One folder per topic, without order. Tasks write their own files, so a hot topic is written by many tasks (and a small one too: see
    ``write_in_order`` for few files)."""
    messages.write.mode("overwrite").partitionBy("topic").format(source).save(path)


def write_rejected(rejected: DataFrame, path: str) -> None:
    rejected.write.mode("overwrite").parquet(path)


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """(source_partition, position) as last saved. One version is read, however many batches were saved."""
    return folders.read_version(spark, path, POSITIONS_SCHEMA)


def save_positions(events: DataFrame, path: str) -> None:
    """Save the newest position of each source in this batch: it replaces the saved one of its source. The positions are one small table, replaced as a whole."""
    newest = latest_positions(events).coalesce(1)
    folders.replace_version(
        events.sparkSession, path, POSITIONS_SCHEMA,
        lambda saved: saved.join(newest, "source_partition", "left_anti").unionByName(newest).coalesce(1),
    )


def delete_positions(spark: SparkSession, path: str, sources: Sequence[str]) -> None:
    """Delete the saved positions of ``sources``, also while a capture saves others; a source that has none is no error."""
    gone = F.col("source_partition").isin(list(sources))
    folders.replace_version(spark, path, POSITIONS_SCHEMA, lambda saved: saved.where(~gone).coalesce(1))
