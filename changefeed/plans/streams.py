"""Queries that run the feed as a stream of files and read what it wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from changefeed.functions.instants import iso_instant
from changefeed.operators import positions
from changefeed.operators.skew import broadcast_if_small, running_number
from changefeed.plans.capture import RULES_V1, row_fields, rule_table
from changefeed.plans.feed import FEED_SQL, change_feed, iso_ms_sql, pack, row_changes
from changefeed.plans.registry import query
from changefeed.plans.reports import _COUNTS_SQL, CAPTURE_SQL, show_capture
from changefeed.plans.rows import CUT_MS
from changefeed.session import discard, work_dir, written
from changefeed.sources import changelog, sinks
from changefeed.streaming import ingest, live_metrics, schemas, transactions


ROWS_PER_FILE = 50_000
FILES_PER_BATCH = 32


def feed_order() -> list:
    """Place of a feed's row in the log: time, number, and its text where these are missing or the same."""
    offset = F.try_parse_json("source_offset")
    return [*(F.try_variant_get(offset, f"$.{entry}", "bigint") for entry in ("timestamp", "lsn")), F.xxhash64("value", "source_partition", "source_offset")]


def ranged_feed(feed, parts: int, newest_first: bool = False) -> tuple:
    """The stored ``feed`` dealt out into files by ranges of rising, or falling, log position, and how many files make a micro-batch.

    A file has some ROWS_PER_FILE rows. There are ``parts`` batches, and more where one would have over FILES_PER_BATCH files, so that neither what a task reads nor what
    a batch holds grows with the feed.
    """
    files = max(parts, -(-feed.count() // ROWS_PER_FILE))
    keyed, order = positions.with_order(feed, feed_order())
    if newest_first:
        order = [F.col(name).desc_nulls_last() for name in keyed.columns[len(feed.columns):]]
    return keyed.repartitionByRange(files, *order).select(*feed.columns), min(FILES_PER_BATCH, -(-files // parts))


def write_feed(feed, path: str, files: int = 4, newest_first: bool = False) -> int:
    """Append the feed as files of rising, or falling, log position: ``files`` of them, or as many times more as its rows need. Returns how many of them make a
    micro-batch (see ``ranged_feed``)."""
    stored = written(feed, "feed")  # making the ranges reads the rows twice
    ranged, per_batch = ranged_feed(stored, files, newest_first)
    ranged.write.mode("append").parquet(path)
    discard(stored)
    return per_batch


def parts_of_feed(spark, feed):
    """The feed in parts of rising log position, each as many files as a micro-batch has."""
    stored, path = written(feed, "feed"), work_dir(spark, "parts")
    ranged, per_batch = ranged_feed(stored, 1)
    # the range of a row, and so its part, is the number of its task
    ranged.withColumn("part", F.expr(f"spark_partition_id() div {per_batch}")).write.partitionBy("part").parquet(path)
    discard(stored)
    parts = spark.read.schema(f"{changelog.FEED_SCHEMA}, part INT").parquet(path)
    numbers = [row.part for row in parts.select("part").distinct().orderBy("part").collect()]  # one for each micro-batch
    for number in numbers or [0]:
        yield parts.where(F.col("part") == number).select(*feed.columns)


def read_messages(spark, out: str):
    """Published messages of all batches, decoded."""
    wire = "operation STRING, position STRUCT<offset: VARIANT>, after VARIANT"
    stored = spark.read.option("basePath", f"{out}/messages").parquet(f"{out}/messages/batch_id=*")
    parsed = stored.select("topic", F.explode(F.array(F.from_json("value", wire))).alias("w"))
    return parsed.select(
        "topic", F.col("w.operation").alias("operation"), F.col("w.after").alias("after"),
        F.try_variant_get("w.position.offset", "$.lsn", "bigint").alias("lsn"),
    )


@query("stream_ingest", FEED_SQL + """SELECT 'cdc.cdcdb.' || CASE WHEN table_name = 'customers' THEN 'public.' ELSE '' END || table_name AS topic,
    operation, lsn, after_status, CASE WHEN table_name <> 'customers' THEN after_amount END AS after_amount
    FROM f WHERE table_name <> 'audit_log'""")
def stream_ingest(spark, sf_dir):
    """Capture under rules, in micro-batches of a few files; the feed is delivered twice, the second time newest first, and deduplicated."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "capture")
    changes = written(row_changes(spark, sf_dir), "changes")
    write_feed(pack(changes), feed)
    per_batch = write_feed(pack(changes), feed, newest_first=True)
    capture = ingest.start_capture(
        changelog.stream_changes(spark, feed, per_trigger=per_batch),
        out,
        f"{out}/checkpoint",
        load_rules=lambda: rule_table(spark, RULES_V1),
        dedupe=True,
        available_now=True,
    )
    capture.awaitTermination()
    return read_messages(spark, out).select("topic", "operation", "lsn", *row_fields("after"))


@query("stream_resume", FEED_SQL + """SELECT 'cdc.cdcdb.' || table_name AS topic, operation, lsn, after_status, after_amount FROM f""")
def stream_resume(spark, sf_dir):
    """Two runs over one checkpoint: the second takes only what came after the first."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "capture")
    changes = written(row_changes(spark, sf_dir), "changes")
    for part in (F.col("ts_ms") < CUT_MS, F.col("ts_ms") >= CUT_MS):
        per_batch = write_feed(pack(changes.where(part)), feed, files=2)
        run = ingest.start_capture(
            changelog.stream_changes(spark, feed, per_trigger=per_batch), out, f"{out}/checkpoint", available_now=True
        )
        run.awaitTermination()
    return read_messages(spark, out).select("topic", "operation", "lsn", *row_fields("after"))


@query("stream_metrics_by_period", FEED_SQL + f"""SELECT {iso_ms_sql('ts_ms // 3600000 * 3600000')} AS period_start, fqn, {_COUNTS_SQL} FROM f GROUP BY ts_ms // 3600000, fqn""")
def stream_metrics_by_period(spark, sf_dir):
    """Hourly metrics of a stream in micro-batches, the newest events first: every batch's counts add up, late hours included."""
    out = counted_stream(spark, sf_dir)
    counts = [f"{op}_count" for op in ("insert", "update", "delete")]
    return live_metrics.period_metrics(spark, out).select(iso_instant(F.col("period_start")).alias("period_start"), "fqn", *counts)


def counted_stream(spark, sf_dir, files: int = 6) -> str:
    """The folder of the metrics of the feed, streamed a part at a time from its newest part to its oldest."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "metrics")
    per_batch = write_feed(change_feed(spark, sf_dir), feed, files, newest_first=True)
    live_metrics.start(changelog.stream_changes(spark, feed, per_trigger=per_batch), out, f"{out}/checkpoint", available_now=True).awaitTermination()
    return out


@query("stream_capture_metrics", CAPTURE_SQL)
def stream_capture_metrics(spark, sf_dir):
    """The capture metrics of a stream, percentiles exact, from the histograms of its batches."""
    return show_capture(live_metrics.capture_metrics(spark, counted_stream(spark, sf_dir)))


@query("stream_transactions", FEED_SQL + """, t AS (SELECT source_partition, tx_id, count(*) AS n_events, min(ROW(ts_ms, lsn)) AS fst, max(ROW(ts_ms, lsn)) AS lst
    FROM f GROUP BY source_partition, tx_id)
    SELECT source_partition, tx_id, n_events, fst[2] AS first_lsn, lst[2] AS last_lsn, lst < max(lst) OVER (PARTITION BY source_partition) AS closed FROM t""")
def stream_transactions(spark, sf_dir):
    """Transactions whose events lie in several micro-batches, the newest events first."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "transactions")
    per_batch = write_feed(change_feed(spark, sf_dir), feed, 5, newest_first=True)
    transactions.start(changelog.stream_changes(spark, feed, per_trigger=per_batch), out, f"{out}/checkpoint", available_now=True).awaitTermination()
    return transactions.transactions(spark, out).select(
        "source_partition", "tx_id", "n_events", F.try_variant_get("first_position.offset", "$.lsn", "bigint").alias("first_lsn"),
        F.try_variant_get("last_position.offset", "$.lsn", "bigint").alias("last_lsn"), "closed",
    )


DRIFT_STEPS = 4


def drifting_feed(changes, step: int):
    """The row changes of one in DRIFT_STEPS parts, by log number, as inserts of rows whose columns change: ``channel`` is added in part 1, ``status`` is called
    ``state`` from part 2 on, and ``amount`` is text from part 3 on."""
    rows = changes.where((F.col("lsn") % DRIFT_STEPS == step) & F.col("after_status").isNotNull())
    columns = [F.col("key_id").alias("id"), F.col("after_status").alias("status" if step < 2 else "state"), F.col("after_amount").cast("string" if step > 2 else "double").alias("amount")]
    image = F.struct(*columns, *([F.lit("web").alias("channel")] if step > 0 else []))
    source = F.struct(F.lit("postgresql").alias("connector"), F.lit("cdcdb").alias("db"), F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), "lsn", F.col("source_ts_ms").alias("ts_ms"))
    return rows.select(
        F.to_json(F.struct(F.lit(None).cast("string").alias("before"), image.alias("after"), source.alias("source"), F.lit("c").alias("op"), "ts_ms")).alias("value"),
        "source_partition", F.to_json(F.struct("lsn", F.col("ts_ms").alias("timestamp"))).alias("source_offset"),
    )


@query("stream_drift", FEED_SQL + f""", parts AS (SELECT DISTINCT fqn, lsn % {DRIFT_STEPS} AS part FROM a WHERE after_status IS NOT NULL),
    steps AS (SELECT fqn, part, lag(part) OVER (PARTITION BY fqn ORDER BY part) AS earlier FROM parts)
    SELECT fqn, part::BIGINT AS batch_id, 'COLUMN_ADDED' AS change, 'channel' AS "column", NULL AS new_name, NULL AS old_type, 'STRING' AS new_type
      FROM steps WHERE earlier < 1 AND part >= 1
    UNION ALL SELECT fqn, part, 'COLUMN_RENAMED', 'status', 'state', NULL, NULL FROM steps WHERE earlier < 2 AND part >= 2
    UNION ALL SELECT fqn, part, 'TYPE_CHANGED', 'amount', NULL, 'NUMBER', 'STRING' FROM steps WHERE earlier < 3 AND part >= 3""")
def stream_drift(spark, sf_dir):
    """Schema changes that capture finds while it runs, batch by batch, against the registry that it keeps."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "capture")
    changes = written(row_changes(spark, sf_dir), "changes")
    for step in range(DRIFT_STEPS):
        write_feed(drifting_feed(changes, step), feed, 1)  # a step is one micro-batch, by its number
        stream = changelog.stream_changes(spark, feed)
        ingest.start_capture(stream, out, f"{out}/checkpoint", track_schemas=True, available_now=True).awaitTermination()
    return schemas.schema_changes(spark, f"{out}/schema_changes").select("fqn", "batch_id", "change", "column", "new_name", "old_type", "new_type")


@query("stream_in_order", FEED_SQL + "SELECT fqn, lsn, row_number() OVER (PARTITION BY fqn, source_partition ORDER BY ts_ms, lsn) AS place FROM f")
def stream_in_order(spark, sf_dir):
    """Capture into a sink that numbers what it is given: the messages of a key come in log order, source by source, from one task each and batch.

    Parts of rising log position arrive one after the other, each captured as a micro-batch."""
    feed, out = work_dir(spark, "feed"), work_dir(spark, "sent")

    def number(messages, batch_id: int) -> None:
        sent = sinks.in_key_order(messages).select("key", "position", F.monotonically_increasing_id().alias("at"))
        sent.write.mode("overwrite").parquet(f"{out}/messages/batch_id={batch_id}")

    for part in parts_of_feed(spark, change_feed(spark, sf_dir)):
        part.write.mode("append").parquet(feed)
        ingest.start_capture(changelog.stream_changes(spark, feed), out, f"{out}/checkpoint", sink=number, available_now=True).awaitTermination()
    sent = spark.read.option("basePath", f"{out}/messages").parquet(f"{out}/messages/batch_id=*").select(
        "batch_id", F.col("key").alias("fqn"), F.col("position.source_partition").alias("source"), F.try_variant_get("position.offset", "$.lsn", "bigint").alias("lsn"), "at",
    )
    # the place in a batch, after all that the batches before it sent of the key and source
    placed = running_number(sent, ["batch_id", "fqn", "source"], ["at"], "in_batch")
    before = Window.partitionBy("fqn", "source").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sent.groupBy("batch_id", "fqn", "source").agg(F.count("*").alias("n"))  # one row for each batch, key and source
    earlier = sizes.select("batch_id", "fqn", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = placed.join(broadcast_if_small(earlier), ["batch_id", "fqn", "source"])
    return numbered.select("fqn", "lsn", (F.col("in_batch") + F.col("earlier")).alias("place"))
