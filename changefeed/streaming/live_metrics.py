"""Metrics of a stream that lose nothing: exact counts of each micro-batch, merged when they are read.

Counts per table and period, and the histogram of latencies, of one part of a feed and of another add up to those of both, whatever the order of the parts. So
each batch stores its own, without a watermark: an event counts however late it comes. Batches pile up as runs that are merged sixteen at a time
(``sources.folders``), so a reader opens few files however long the stream has run. A batch that runs again replaces its own counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from changefeed.operators import envelope, metrics
from changefeed.sources import folders

HISTOGRAM = "published BOOLEAN, latency BIGINT, n BIGINT, first TIMESTAMP, last TIMESTAMP"


def store_batch(canonical: DataFrame, batch_id: int, out: str, period: str = "60 minutes") -> None:
    """Store what a batch (the output of ``to_canonical``) counts."""
    spark = canonical.sparkSession
    parts = (
        ("periods", metrics.PERIOD_COUNTS, metrics.merge_periods, lambda held: metrics.metrics_by_period(envelope.accepted(held), period)),
        ("latencies", HISTOGRAM, metrics.merge_histograms, metrics.latency_histogram),
    )
    held = canonical.persist()
    try:
        for name, schema, merge, count in parts:
            folders.merge_runs(spark, f"{out}/{name}", schema, batch_id, merge)
            folders.write_run(count(held), f"{out}/{name}", batch_id)
    finally:
        held.unpersist()


def period_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Operation counts per table and period of all batches stored so far."""
    return metrics.merge_periods(folders.read_runs(spark, f"{out}/periods", metrics.PERIOD_COUNTS))


def capture_metrics(spark: SparkSession, out: str) -> DataFrame:
    """The capture metrics of all batches stored so far, percentiles exact."""
    return metrics.metrics_of_histogram(metrics.merge_histograms(folders.read_runs(spark, f"{out}/latencies", HISTOGRAM)))


def start(changes: DataFrame, out: str, checkpoint: str, period: str = "60 minutes", available_now: bool = False) -> StreamingQuery:
    """Count a feed stream into files under ``out``. One ``out`` keeps to one period length."""
    writer = envelope.to_canonical(changes).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: store_batch(batch, batch_id, out, period)
    )
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": "10 seconds"})).start()
