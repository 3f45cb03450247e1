"""What a task reads of a streamed feed, and what a batch holds, does not grow with the feed."""

import pytest
from pyspark.sql import functions as F

from changefeed.operators import envelope, positions
from changefeed.plans import streams
from changefeed.plans.feed import change_feed
from changefeed.sources import sinks
from tools.check_queries import check, connect


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 3)


def feed_rows(path, spark):
    return spark.read.parquet(path).withColumn("file", F.input_file_name())


@pytest.mark.parametrize("newest_first", [False, True])
def test_files_of_a_feed_grow_in_number(spark, sf_dir, tmp_path, small_files, newest_first):
    feed = change_feed(spark, sf_dir)
    rows = feed.count()
    per_batch = streams.write_feed(feed, str(tmp_path / "feed"), 2, newest_first)
    stored = feed_rows(str(tmp_path / "feed"), spark)
    sizes = [r["count"] for r in stored.groupBy("file").count().collect()]
    assert sum(sizes) == rows and len(sizes) >= rows // 100 and max(sizes) <= 300
    assert per_batch == 3
    assert stored.drop("file").exceptAll(feed).isEmpty()


def test_small_feeds_keep_their_batches(spark, sf_dir, tmp_path):
    assert streams.write_feed(change_feed(spark, sf_dir), str(tmp_path / "feed"), 4) == 1
    assert feed_rows(str(tmp_path / "feed"), spark).select("file").distinct().count() == 4


def test_rows_without_time_fill_many_files(spark, tmp_path, small_files):
    feed = spark.range(1000).select(F.col("id").cast("string").alias("value"), F.lit("{server=s}").alias("source_partition"), F.lit("{}").alias("source_offset"))
    streams.write_feed(feed, str(tmp_path / "feed"), 2)
    assert max(r["count"] for r in feed_rows(str(tmp_path / "feed"), spark).groupBy("file").count().collect()) <= 300


@pytest.mark.parametrize("name", ["stream_ingest", "stream_resume", "stream_drift", "stream_metrics_by_period", "stream_capture_metrics", "stream_transactions", "stream_in_order"])
def test_answer_of_many_files(spark, sf_dir, tmp_path, monkeypatch, small_files, name):
    monkeypatch.setattr(streams, "work_dir", lambda spark, purpose: str(tmp_path / purpose))
    ok, text = check(spark, connect(sf_dir), name, sf_dir)
    assert ok, text
    assert max(r["count"] for r in feed_rows(str(tmp_path / "feed"), spark).groupBy("file").count().collect()) <= 300


def test_feed_in_parts_of_rising_position(spark, sf_dir, small_files):
    at = F.try_variant_get(F.try_parse_json("source_offset"), "$.timestamp", "bigint")
    feed = change_feed(spark, sf_dir)
    parts = [part.agg(F.min(at), F.max(at), F.count("*")).first() for part in streams.parts_of_feed(spark, feed)]
    assert len(parts) > 2 and sum(n for _, _, n in parts) == feed.count()
    assert all(earlier[1] <= later[0] for earlier, later in zip(parts, parts[1:]))


def test_an_empty_feed_is_one_part(spark, sf_dir):
    assert [part.count() for part in streams.parts_of_feed(spark, change_feed(spark, sf_dir).limit(0))] == [0]


def test_what_orders_is_computed_once_a_row(spark, sf_dir):
    """Sorting and dealing out compare columns: they hold no expression, which would be computed at each comparison."""
    events = envelope.accepted(envelope.to_canonical(change_feed(spark, sf_dir)))
    messages = events.select(F.lit("t").alias("topic"), F.col("fqn").alias("key"), F.lit("v").alias("value"), "event_id", "position")
    for ordered in (positions.in_position_order(events), positions.in_delivery_order(events), positions.in_delivery_order(events, 3), sinks.in_key_order(messages)):
        plan = ordered._jdf.queryExecution().optimizedPlan().toString()
        compared = [line for line in plan.splitlines() if line.strip(" +-:").startswith(("Sort ", "RepartitionByExpression"))]
        assert compared and not any("regexp" in line or "rlike" in line.lower() for line in compared), compared


def test_events_are_decoded_once_to_be_numbered(spark, sf_dir):
    decoded = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(60), 4).map(lambda i: decoded.add(1) or (i,)), "id BIGINT")
    place = F.struct(F.lit("s").alias("source_partition"), F.lit(None).cast("bigint").alias("ts_key"), F.lit(None).cast("bigint").alias("seq_key"),
                     F.concat(F.lit("log."), F.col("id").cast("string")).alias("log_file"), F.col("id").alias("log_key"))
    numbered = positions.with_delivery_number(rows.select(F.lit("t").alias("fqn"), place.alias("position"), "id"))
    assert sorted((r.delivery_no, r.id) for r in numbered.collect()) == [(i + 1, i) for i in range(60)]
    assert decoded.value == 60
