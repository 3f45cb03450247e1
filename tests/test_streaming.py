"""Streams over files: resume, rules reloaded, copies, rejects, drift, batches that run again."""

import random

import pytest
from pyspark.sql import functions as F

from changefeed.operators import envelope
from changefeed.plans import pipeline
from changefeed.plans.capture import RULES_V1, RULES_V2, rule_table
from changefeed.plans.feed import change_feed
from changefeed.plans.streams import read_messages
from changefeed.session import discard, work_dir, written
from changefeed.sources import changelog, folders, sinks
from changefeed.streaming import ids, ingest, schemas, transactions
from tests.test_envelope import ROW, SOURCE, feed, record


@pytest.fixture
def box(tmp_path):
    return {name: str(tmp_path / name) for name in ("feed", "out", "checkpoint", "registry", "changes")}


def add(spark, box, values, offsets):
    rows = [(v, "{server=src}", o) for v, o in zip(values, offsets)]
    spark.createDataFrame(rows, changelog.FEED_SCHEMA).coalesce(1).write.mode("append").parquet(box["feed"])


def offset(n):
    return f'{{"lsn": {n}, "timestamp": {n}}}'


def run(spark, box, **options):
    query = ingest.start_capture(
        changelog.stream_changes(spark, box["feed"], per_trigger=1), box["out"], box["checkpoint"], available_now=True, **options
    )
    query.awaitTermination()


def published(spark, box):
    return sorted((r.lsn, r.topic) for r in read_messages(spark, box["out"]).collect())


def test_resume_and_rejects(spark, box):
    add(spark, box, [record(), "{bad", None], [offset(1), offset(2), offset(3)])
    run(spark, box)
    assert published(spark, box) == [(1, "cdc.shop.orders")]
    add(spark, box, [record(op="u", before=ROW), record(op="t")], [offset(4), offset(5)])
    run(spark, box)
    run(spark, box)
    assert [n for n, _ in published(spark, box)] == [1, 4]
    dead = spark.read.parquet(f"{box['out']}/rejected")
    assert sorted(r.reject_reason for r in dead.collect()) == ["MALFORMED", "UNKNOWN_OP"]
    saved = sinks.load_positions(spark, f"{box['out']}/positions").collect()
    assert [(r.source_partition, r.position.log_key) for r in saved] == [("{server=src}", 4)]
    source = saved[0].source_partition
    # one version is read, however many batches were saved, and one deleted is gone from the folder that the capture writes to
    assert len(folders.complete(spark, f"{box['out']}/positions", folders.VERSION)) <= folders.VERSIONS_KEPT
    sinks.delete_positions(spark, f"{box['out']}/positions", [source, "none of this name"])
    assert sinks.load_positions(spark, f"{box['out']}/positions").count() == len(saved) - 1
    add(spark, box, [record()], [offset(9)])
    run(spark, box)
    assert [r.position.log_key for r in sinks.load_positions(spark, f"{box['out']}/positions").collect()] == [9]


def test_rules_are_reloaded(spark, box):
    """The rules change while the stream runs: the first batch has no rule for the table, the second has."""
    tables = iter([RULES_V2, RULES_V1])
    source = {**SOURCE, "db": "cdcdb", "table": "customers"}
    for n in (1, 2):
        add(spark, box, [record(source=source)], [offset(n)])
    run(spark, box, load_rules=lambda: rule_table(spark, next(tables)))
    assert published(spark, box) == [(2, "cdc.cdcdb.public.customers")]


def test_copies_are_published_once(spark, box):
    for _ in range(2):
        add(spark, box, [record(), record(op="t")], [offset(1), offset(2)])
    run(spark, box, dedupe=True)
    assert [n for n, _ in published(spark, box)] == [1]
    assert spark.read.parquet(f"{box['out']}/rejected").count() == 2


@pytest.mark.parametrize("limit", [0, 2, 100_000])
def test_copies_are_found_by_their_ids_alone(spark, box, monkeypatch, limit):
    """Whatever is few or many: new events, copies of earlier ones, copies within a batch. Whole records are not dealt out for it where nothing came twice."""
    monkeypatch.setattr(ingest, "BROADCAST_ROWS", limit)
    got = []
    for batch_id, numbers in enumerate([[1, 2, 3], [3, 2, 1], [2, 4, 4, 3, 5], [1, 6, 7, 8], [9, 9, 9, 10, 10, 11, 11]]):
        rows = [*((record(), offset(n)) for n in numbers), ("{bad", offset(99))]
        batch = spark.createDataFrame([(value, "{server=src}", place) for value, place in rows], changelog.FEED_SCHEMA)
        held = ingest.unseen(envelope.to_canonical(batch), f"{box['out']}/seen", batch_id)
        if batch_id == 0:
            assert "hashpartitioning" not in held.rows._jdf.queryExecution().toString()
        found = held.rows.select("position.log_key", "reject_reason").collect()
        got.append(sorted(r.log_key for r in found if r.reject_reason is None))
        assert [r.reject_reason for r in found if r.reject_reason] == ["MALFORMED"]
        ids.store(envelope.accepted(held.rows).select("event_id"), f"{box['out']}/seen", batch_id)
        discard(*held.ids)
    assert got == [[1, 2, 3], [], [4, 5], [6, 7, 8], [9, 10, 11]]


def test_nothing_is_lost_after_tombstones_and_far_dates(spark, box):
    """Tombstones, a date far in the future and an impossible one come before events with older dates: all of these are published."""
    add(spark, box, [record(ts_ms=4102444800000), record(ts_ms=9223372036854775807), None], [offset(1), offset(2), offset(3)])
    for n in range(4, 8):
        add(spark, box, [record(ts_ms=1700000000000 - n * 86400000)], [offset(n)])
        add(spark, box, [record(ts_ms=1700000000000 - n * 86400000)], [offset(n)])
    run(spark, box, dedupe=True)
    assert sorted(n for n, _ in published(spark, box)) == [1, 4, 5, 6, 7]
    assert [r.reject_reason for r in spark.read.parquet(f"{box['out']}/rejected").collect()] == ["TIME_OUT_OF_RANGE"]


def test_a_batch_that_runs_again_replaces_itself(spark, box):
    canonical = envelope.to_canonical(feed(spark, [record()]))
    for _ in range(2):
        ingest.capture_batch(canonical, 0, box["out"])
    assert len(published(spark, box)) == 1


def test_lost_position_only_warns(spark, box, monkeypatch, caplog):
    def fail(*_):
        raise OSError("no space")

    monkeypatch.setattr(sinks, "save_positions", fail)
    ingest.capture_batch(envelope.to_canonical(feed(spark, [record()])), 0, box["out"])
    assert len(published(spark, box)) == 1 and "positions of batch 0" in caplog.text


def test_stream_gives_what_the_batch_gives(spark, sf_dir, box):
    change_feed(spark, sf_dir).repartition(3).write.parquet(box["feed"])
    run(spark, box)
    batch = envelope.accepted(envelope.to_canonical(changelog.read_changes(spark, box["feed"])))
    want = sorted(r[0] for r in batch.select(F.try_variant_get("position.offset", "$.lsn", "bigint")).collect())
    assert [n for n, _ in published(spark, box)] == want


def test_drift_on_a_stream(spark, box):
    batches = [
        {"id": 1, "name": "a", "note": None},
        {"id": 2.5, "name": None, "note": None},  # no change: a number is a number, null has no type
        {"id": 3, "name": "b", "note": "x"},  # note gets its type
        {"id": 4, "label": "b", "note": "x"},  # name renamed to label
        {"id": "5", "label": "b", "note": "x", "extra": True},
    ]
    for n, row in enumerate(batches):
        events = envelope.accepted(envelope.to_canonical(feed(spark, [record(after=row)])))
        for _ in range(2):  # a batch that runs again gives the same
            schemas.detect_and_register(events, n, box["registry"], box["changes"])
    found = spark.read.parquet(box["changes"]).select("batch_id", "change", "column", "new_name", "old_type", "new_type")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([
        (3, "COLUMN_RENAMED", "name", "label", None, None),
        (4, "TYPE_CHANGED", "id", None, "NUMBER", "STRING"),
        (4, "COLUMN_ADDED", "extra", None, None, "BOOLEAN"),
    ], key=repr)
    newest = schemas.registered_schemas(spark, box["registry"])
    assert {r.version for r in newest.collect()} == {4}  # the registry holds the newest schema of each table only
    assert {r.column: r.type for r in newest.collect()} == {
        "id": "STRING", "label": "STRING", "note": "STRING", "extra": "BOOLEAN",
    }


def test_drift_while_capturing(spark, box):
    for n, row in enumerate([{"id": 1, "name": "a"}, {"id": 2, "name": "b", "extra": 1.5}, {"id": "3", "label": "b", "extra": 2}]):
        add(spark, box, [record(after=row)], [offset(n)])
        run(spark, box, track_schemas=True)
    found = schemas.schema_changes(spark, f"{box['out']}/schema_changes")
    assert sorted((r.batch_id, r.change, r.column, r.new_name) for r in found.collect()) == [
        (1, "COLUMN_ADDED", "extra", None), (2, "COLUMN_RENAMED", "name", "label"), (2, "TYPE_CHANGED", "id", None),
    ]
    assert {r.column for r in schemas.registered_schemas(spark, f"{box['out']}/schemas").collect()} == {"id", "label", "extra"}


def test_ids_of_many_batches(spark, tmp_path, monkeypatch):
    """Every id is found again whatever run it has been merged into, and few folders and buckets are read for it."""
    monkeypatch.setattr(folders, "FAN", 3)
    path = str(tmp_path / "seen")

    def batch(names):
        return spark.createDataFrame([(n,) for n in names], "event_id string")

    assert ids.stored(batch(["a"]), path, 0).count() == 0
    for n in range(20):
        names = [f"id{n}-{i}" for i in range(40)]
        for _ in range(2 if n in (0, 9, 18) else 1):  # a batch that runs again does not see its own ids
            assert ids.stored(batch(names), path, n).count() == 0
            ids.store(batch(names), path, n)
    for n in (0, 7, 8, 9, 17, 18, 19):
        asked = [f"id{n}-3", f"id{n}-39", f"new{n}", f"new{n}"]
        assert {r.event_id for r in ids.stored(batch(asked), path, 20).collect()} == set(asked[:2])
    assert ids.stored(batch(["id5-1", "id19-1"]), path, 19).collect() == [("id5-1",)]
    runs = folders.covering(folders.complete(spark, path, folders.RUN), 20)
    assert len(runs) <= 2 * 3 and {r for r in runs if r[0]} <= set(folders.complete(spark, f"{path}-filters", folders.RUN))
    # a filter rules out most new ids: few buckets are read for them
    level, first = runs[0]
    filters = spark.read.schema(ids.FILTERS).parquet(folders.run_path(f"{path}-filters", level, first))
    new = ids._bucketed(batch([f"never{i}" for i in range(500)]))
    assert ids._maybe_stored(new, filters, filters.first().chunks).count() < 25
    old = ids._bucketed(batch([f"id{n}-{i}" for n in range(first, first + 3**level) for i in range(40)]))
    assert ids._maybe_stored(old, filters, filters.first().chunks).count() == 40 * 3**level


def publishable(spark, rows):
    df = spark.createDataFrame(rows, "topic string, key string, n bigint")
    position = F.struct(F.lit("p").alias("source_partition"), F.lit(None).cast("variant").alias("offset"), F.col("n").alias("ts_key"),
                        F.lit(None).cast("bigint").alias("seq_key"), F.lit(None).cast("string").alias("log_file"), F.lit(None).cast("bigint").alias("log_key"))
    return df.select("topic", "key", F.col("n").cast("string").alias("value"), F.concat("key", F.col("n").cast("string")).alias("event_id"), position.alias("position"))


def test_sinks_keep_the_order_of_a_key(spark, tmp_path):
    """A hot topic fills several files, few in all; read by name they hold each key in log order, twice the same."""
    rows = [("hot", f"k{n % 3}", n) for n in range(1000)] + [("one", "x", n) for n in (3, 1, 2)] + [("two", "y", 5)]
    random.Random(4).shuffle(rows)
    messages = publishable(spark, rows).repartition(7)
    contents = []
    for _ in range(2):
        sinks.file_sink(str(tmp_path / "out"), rows_per_file=200)(messages, 3)
        found = {}
        for topic in ("hot", "one", "two"):
            files = sorted((tmp_path / "out" / "batch_id=3" / f"topic={topic}").glob("part-*.parquet"))
            found[topic] = [(r.key, int(r.value)) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
            assert len(files) <= {"hot": 7, "one": 1, "two": 1}[topic] and (topic != "hot" or len(files) > 3)
        contents.append(found)
    assert contents[0] == contents[1] and [n for _, n in contents[0]["hot"]] == list(range(1000)) and contents[0]["one"] == [("x", 1), ("x", 2), ("x", 3)]
    sent = sinks.in_key_order(messages).select("key", F.col("value").cast("int").alias("n"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")).collect()
    for key in ("k0", "k1", "k2", "x", "y"):
        own = [r for r in sorted(sent, key=lambda r: r.at) if r.key == key]
        assert len({r.task for r in own}) == 1 and [r.n for r in own] == sorted(r.n for r in own)


def test_capture_into_a_sink(spark, box):
    """A replayed batch gives a sink the same rows in the same order; a table excluded or not routable sends nothing, and its events are not among those behind messages."""
    calls = []
    canonical = envelope.to_canonical(feed(spark, [record(), record(op="u", before=ROW), record(source={**SOURCE, "table": "x" * 300})]))
    for _ in range(2):
        ingest.capture_batch(canonical, 0, box["out"], sink=lambda messages, n: calls.append((n, [r.value for r in sinks.in_key_order(messages).collect()])))
    assert calls[0] == calls[1] and calls[0][0] == 0 and len(calls[0][1]) == 2
    outputs = pipeline.run(canonical)
    assert outputs.events.count() == 2 and outputs.messages.columns == ["topic", "key", "value"]
    assert [r.reject_reason for r in outputs.rejected.collect()] == ["INVALID_TOPIC"]


def test_transactions_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FAN", 2)
    rows = [(1, 10, 2), (1, 11, 2), (2, 12, 3), (3, 13, 1), (2, 14, 3), (4, 15, None), (5, 16, None)]  # transaction, place, events it says it has
    order = [6, 0, 3, 5, 1, 2, 4]
    for count_field, closed in ((None, {1, 2, 3, 4}), ("txCount", {1, 3, 4})):
        out = str(tmp_path / str(count_field))
        for n, at in enumerate(order):
            tx, place, said = rows[at]
            offset = f'{{"txId": {tx}, "timestamp": {place}, "txCount": {said if said else "null"}}}'
            events = envelope.accepted(envelope.to_canonical(feed(spark, [record()], offset=offset)))
            for _ in range(2 if n == 2 else 1):
                transactions.store_batch(events, n, out, count_field=count_field)
        got = {r.tx_id: r for r in transactions.transactions(spark, out).collect()}
        assert {t: (r.n_events, r.first_position.ts_key, r.last_position.ts_key) for t, r in got.items()} == {
            1: (2, 10, 11), 2: (2, 12, 14), 3: (1, 13, 13), 4: (1, 15, 15), 5: (1, 16, 16)}
        assert {t for t, r in got.items() if r.closed} == closed


def test_kafka_rows_are_known_by_their_coordinates(spark):
    rows = [(b'{"id":1}', record().encode(), "t", 0, 7), (b'{"id":2}', record().encode(), "t", 1, 7), (None, None, "t", 0, 8), (b"k", record().encode(), "u", 0, 12)]
    df = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint")
    canonical = envelope.to_canonical(changelog.from_kafka(df))
    events = canonical.where("reject_reason is null")
    assert events.select("event_id").distinct().count() == 3
    got = {(r.source_partition, r.log_key, r.record_key) for r in events.select("position.source_partition", "position.log_key", "record_key").collect()}
    assert got == {("{topic=t, partition=0}", 7, '{"id":1}'), ("{topic=t, partition=1}", 7, '{"id":2}'), ("{topic=u, partition=0}", 12, "k")}
    assert canonical.where("reject_reason = 'TOMBSTONE'").first().source_partition == "{topic=t, partition=0}"


class OnCluster:
    """A session whose cluster names a shared folder (the setting cannot change in a running one)."""

    class conf:
        @staticmethod
        def get(name, default):
            return "/shared/checkpoints/" if name == "spark.checkpoint.dir" else default


def test_work_folder(spark):
    assert work_dir(OnCluster, "x").startswith("/shared/checkpoints/x-")
    assert work_dir(spark, "x") != work_dir(spark, "x")
    assert written(spark.range(3), "rows").count() == 3


def test_kafka_writer_contract(spark):
    """The connector is not on this class path: only the row contract and the failure are seen here."""
    messages = spark.createDataFrame([("t", "k", "v", 1)], "topic string, key string, value string, extra int")
    with pytest.raises(Exception, match="(?i)kafka"):
        sinks.write_kafka(messages, "localhost:9092")
    assert sinks.PRODUCER_OPTIONS["kafka.acks"] == "all"
