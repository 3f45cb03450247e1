"""Transactions whose events lie in several micro-batches.

Each batch stores, for each transaction that it has events of, their number and first and last position. These add up, so a transaction is whole however its
events were spread and in whatever order the batches came. Whether it is closed is told from what has been read: by the number of events that it says it has, or by a
later position of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefeed.operators import envelope, state
from changefeed.operators.positions import sort_key
from changefeed.operators.skew import broadcast_if_small
from changefeed.session import written
from changefeed.sources import folders, sinks

PARTS = f"source_partition STRING, tx_id BIGINT, n_events BIGINT, said BIGINT, first_position {sinks.POSITION}, last_position {sinks.POSITION}"


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of transactions (PARTS) added up."""
    return parts.groupBy("source_partition", "tx_id").agg(
        F.sum("n_events").alias("n_events"), F.max("said").alias("said"),
        F.min_by("first_position", sort_key(F.col("first_position"))).alias("first_position"),
        F.max_by("last_position", sort_key(F.col("last_position"))).alias("last_position"),
    )


def store_batch(events: DataFrame, batch_id: int, out: str, tx_field: str = "txId", count_field: str | None = None) -> None:
    """Store a batch's parts. ``count_field`` is the entry of the offset that says how many events a transaction has, if there is one."""
    said = F.try_variant_get("position.offset", f"$.{count_field}", "bigint") if count_field else F.lit(None).cast("bigint")
    folders.merge_runs(events.sparkSession, f"{out}/transactions", PARTS, batch_id, merge_parts)
    parts = state.transaction_groups(events, tx_field, F.max(said).alias("said"))
    folders.write_run(parts.select("source_partition", "tx_id", "n_events", "said", "first_position", "last_position"), f"{out}/transactions", batch_id)


def transactions(spark: SparkSession, out: str) -> DataFrame:
    """source_partition, tx_id, n_events, first_position, last_position and closed of all transactions read so far.

    A transaction is closed when it has the number of events that it says, or, where it says none, when its source has a position after its last.
    """
    whole = written(merge_parts(folders.read_runs(spark, f"{out}/transactions", PARTS)), "transactions")
    last = F.struct(sort_key(F.col("last_position")).alias("key"))
    newest = whole.groupBy("source_partition").agg(F.max(last).alias("newest"))
    closed = F.when(F.col("said").isNotNull(), F.col("n_events") >= F.col("said")).otherwise(last < F.col("newest"))
    return whole.join(broadcast_if_small(newest), "source_partition").select(
        "source_partition", "tx_id", "n_events", "first_position", "last_position", closed.alias("closed")
    )


def start(changes: DataFrame, out: str, checkpoint: str, tx_field: str = "txId", count_field: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Collect the transactions of a feed stream under ``out``."""
    writer = envelope.accepted(envelope.to_canonical(changes)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: store_batch(batch, batch_id, out, tx_field, count_field)
    )
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "10 seconds"})).start()
