"""Decoding, reject reasons, wire JSON."""

import json

import pytest
from pyspark.sql import functions as F

from changefeed.operators import envelope, routing, validate, wire
from changefeed.plans import pipeline
from changefeed.sources import changelog

SOURCE = {"connector": "postgresql", "name": "src", "db": "shop", "schema": "public", "table": "orders",
          "ts_ms": 1762151107000, "lsn": 7}
ROW = {"id": 1, "note": None}


def record(**changes):
    body = {"before": None, "after": ROW, "source": SOURCE, "op": "c", "ts_ms": 1762151107179}
    body.update(changes)
    return json.dumps(body)


def feed(spark, values, offset='{"lsn": 7, "timestamp": 5}', partition="{server=src}"):
    rows = [(v, partition, offset) for v in values]
    return spark.createDataFrame(rows, changelog.FEED_SCHEMA)


def reason(spark, value, **kwargs):
    options = {k: kwargs.pop(k) for k in ("check_identifiers",) if k in kwargs}
    return envelope.to_canonical(feed(spark, [value], **kwargs), **options).select("reject_reason").first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        (record(), None),
        (record(op="r"), None),
        (record(op="u", before=ROW), None),
        (record(op="d", before=ROW, after=None), None),
        (None, "TOMBSTONE"),
        ("{bad", "MALFORMED"),
        ("[1]", "MALFORMED"),
        (record(after=5), "MALFORMED"),
        (record(before=[1]), "MALFORMED"),
        (record(ts_ms="soon"), "MALFORMED"),
        ("{}", "MISSING_SOURCE"),
        (record(source=None), "MISSING_SOURCE"),
        (record(source={**SOURCE, "db": None}), "BLANK_DATABASE"),
        (record(source={**SOURCE, "table": " "}), "BLANK_TABLE"),
        (record(source={k: v for k, v in SOURCE.items() if k != "schema"}), None),
        (record(op="t"), "UNKNOWN_OP"),
        (record(op="m"), "UNKNOWN_OP"),
        (record(op=None), "UNKNOWN_OP"),
        (record(before=ROW), "INSERT_WITH_BEFORE"),
        (record(after=None), "INSERT_WITHOUT_AFTER"),
        (record(op="u"), "UPDATE_WITHOUT_BEFORE"),
        (record(op="u", before=ROW, after=None), "UPDATE_WITHOUT_AFTER"),
        (record(op="d", after=None), "DELETE_WITHOUT_BEFORE"),
        (record(op="d", before=ROW), "DELETE_WITH_AFTER"),
    ],
)
def test_reasons(spark, value, expected):
    assert reason(spark, value) == expected


def test_position_reasons(spark):
    assert reason(spark, record(), offset="{}") == "EMPTY_OFFSET"
    assert reason(spark, record(), offset='{"lsn": null}') == "EMPTY_OFFSET"
    assert reason(spark, record(), offset=None) == "EMPTY_OFFSET"
    assert reason(spark, record(), offset="nonsense") == "EMPTY_OFFSET"
    assert reason(spark, record(), partition=" ") == "BLANK_PARTITION"
    assert reason(spark, record(), partition=None) is None


def test_identifiers_are_checked_on_request(spark):
    value = record(source={**SOURCE, "db": "my-shop"})
    assert reason(spark, value) is None
    assert reason(spark, value, check_identifiers=True) == "INVALID_IDENTIFIER"
    assert reason(spark, record(), check_identifiers=True) is None
    assert set(validate.INTEGRITY_REASONS).isdisjoint(validate.REQUIRED_REASONS)


def test_rejects_keep_the_record(spark):
    canonical = envelope.to_canonical(feed(spark, [None, "{bad", record(), record(op="t")]))
    dead = {r.value: r for r in envelope.rejected(canonical).collect()}
    assert set(dead) == {"{bad", record(op="t")}
    assert dead["{bad"].reject_reason == "MALFORMED" and dead["{bad"].source_offset
    assert envelope.accepted(canonical).count() == 1


def test_positions_from_the_source_block(spark):
    """Plain JSON lines have no position columns."""
    df = spark.createDataFrame([(record(),)], "value string")
    row = envelope.accepted(envelope.to_canonical(df)).select(
        "position.source_partition", F.to_json("position.offset").alias("offset"), "position.log_key", "position.ts_key"
    ).first()
    assert (row.source_partition, row.log_key, row.ts_key) == ("{server=src}", 7, 1762151107000)
    assert json.loads(row.offset) == {"lsn": 7, "ts_ms": 1762151107000}


@pytest.mark.parametrize(
    "offset, keys",
    [
        ('{"lsn": "0/1", "timestamp": 9}', (9, None, "0/1", None)),
        ('{"lsn": "17", "timestamp": 9}', (9, None, None, 17)),
        ('{"scn": 99999999999999999999, "timestamp": 9}', (9, None, "99999999999999999999", None)),
        ('{"commit_lsn": "0000002a:00000758:0005", "change_lsn": "0000002a:00000758:0003"}', (None, None, "0000002a:00000758:0005/0000002a:00000758:0003", None)),
        ('{"timestamp": "9", "ts_ms": 8}', (8, None, None, None)),
        ('{"file": "bin.3", "pos": 12, "timestamp": 4}', (4, None, "bin.3", 12)),
        ('{"scn": 5, "sequence": "x", "event": 2}', (None, 2, None, 5)),
    ],
)
def test_position_keys(spark, offset, keys):
    events = envelope.accepted(envelope.to_canonical(feed(spark, [record()], offset=offset)))
    row = events.select("position.ts_key", "position.seq_key", "position.log_file", "position.log_key").first()
    assert tuple(row) == keys


def test_times(spark):
    no_time = record(ts_ms=None)
    typed = envelope.to_canonical(feed(spark, [no_time])).select("timestamp").first()[0]
    assert typed.timestamp() != 0 and str(typed).startswith("2025-11-03")
    compat = envelope.to_canonical(feed(spark, [no_time]), mode="compat")
    assert compat.where("abs(unix_seconds(timestamp) - unix_seconds(current_timestamp())) < 600").count() == 1


def test_event_id_tells_events_apart(spark):
    first = feed(spark, [record(), None, "{bad"])
    second = feed(spark, [record()], offset='{"lsn": 8}')
    ids = envelope.to_canonical(first.unionByName(second).unionByName(first)).select("event_id")
    assert ids.count() == 7 and ids.distinct().count() == 4


def test_wire_json(spark):
    source = {k: v for k, v in SOURCE.items() if k != "schema"}
    value = record(op="d", before=ROW, after=None, source=source)
    events = envelope.accepted(envelope.to_canonical(feed(spark, [value], offset='{"lsn": 7, "snapshot": null}')))
    assert json.loads(events.select(wire.to_wire_json()).first()[0]) == {
        "table": {"database": "shop", "table": "orders"},
        "operation": "DELETE",
        "timestamp": "2025-11-03T06:25:07.179Z",
        "position": {"sourcePartition": "{server=src}", "offset": {"lsn": 7}},
        "before": {"id": 1, "note": None},
        "metadata": {"source": "changefeed", "version": "1.0.0", "connector": "postgresql", "schemaVersion": 1},
    }


GOOD = {
    "table": {"database": "d", "schema": None, "table": "t"}, "operation": "INSERT", "timestamp": "2025-11-01T10:30:00Z",
    "position": {"sourcePartition": "p", "offset": {"lsn": 1}}, "before": None, "after": {"a": 1},
    "metadata": {"source": "s", "version": "1.0.0", "connector": "postgres", "schemaVersion": 1},
}


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, set()),
        ({"operation": "MERGE"}, {"operation_enum"}),
        ({"operation": None}, {"required"}),
        ({"timestamp": "2025-11-01 10:30"}, {"timestamp_format"}),
        ({"table": {"database": "", "table": "t"}}, {"table"}),
        ({"position": {"sourcePartition": "p", "offset": 3}}, {"position"}),
        ({"before": {"a": 1}}, {"images"}),
        ({"after": None}, {"images"}),
        ({"metadata": {**GOOD["metadata"], "version": "1.0"}}, {"version_pattern"}),
        ({"metadata": {**GOOD["metadata"], "connector": "postgresql"}}, {"connector_enum"}),
        ({"metadata": {**GOOD["metadata"], "schemaVersion": 0}}, {"schema_version"}),
        ({"metadata": {"version": "1.0.0"}}, {"metadata_required"}),
    ],
)
def test_wire_contract(spark, change, broken):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "value string")
    assert {r.rule for r in wire.validate_wire(df).where("violations > 0").collect()} == broken


def test_broken_json_breaks_the_contract(spark):
    rows = {r.rule: r.violations for r in wire.validate_wire(spark.createDataFrame([("{",)], "value string")).collect()}
    assert rows["not_json"] == 1 and rows["required"] == 1


def test_field_access(spark):
    df = spark.createDataFrame([('{"a": 1, "n": null}',), (None,)], "j string").select(F.parse_json("j").alias("v"))
    v = F.col("v")
    rows = df.select(
        envelope.get_field(v, "a", "int"), envelope.get_field(v, "a", "date"), envelope.has_field(v, "n"),
        envelope.has_field(v, "z"), envelope.field_count(v), envelope.is_empty_row(v),
    ).collect()
    assert [tuple(r) for r in rows] == [(1, None, True, False, 2, False), (None, None, False, False, 0, True)]


def test_invalid_topics_are_rejected(spark):
    canonical = envelope.to_canonical(feed(spark, [record(source={**SOURCE, "table": "t" * 300}), record()]))
    out = pipeline.run(canonical)
    assert out.messages.count() == 1
    assert [r.reject_reason for r in out.rejected.collect()] == ["INVALID_TOPIC"]


def test_pipeline_without_normalization(spark):
    row = {"id": 1, "created_at": "2025-11-01T10:30:00+02:00"}
    canonical = envelope.to_canonical(feed(spark, [record(after=row)]))
    plain = json.loads(pipeline.run(canonical, normalize=False).messages.first().value)
    assert plain["after"] == row
    changed = json.loads(pipeline.run(canonical).messages.first().value)
    assert changed["after"]["created_at"] == "2025-11-01T08:30:00Z"


def test_unwrap_keeps_tombstones(spark):
    values = [record(), record(op="d", before=ROW, after=None), None]
    rows = envelope.unwrap(envelope.to_canonical(feed(spark, values))).select(F.to_json("row")).collect()
    assert sorted((json.loads(r[0]) if r[0] else {}).get("__deleted", "none") for r in rows) == ["false", "none", "true"]


def test_snapshot_events_are_distinct(spark):
    rows = spark.sql("SELECT id, 'x' AS name, TIMESTAMP_NTZ'2024-01-15 10:30:00' AS created_at FROM range(5)")
    events = changelog.snapshot_changes(rows, "shop", "orders", ["id"], F.lit(1000), schema=None)
    assert events.select("event_id").distinct().count() == 5
    row = events.select("fqn", F.to_json("after").alias("after"), "operation").first()
    assert row.fqn == "shop.orders" and row.operation == "INSERT"
    assert json.loads(row.after)["created_at"] == "2024-01-15T10:30:00Z"
    assert envelope.to_canonical(feed(spark, [record()])).drop("value", "source_partition", "source_offset", "reject_reason").schema \
        .simpleString() == events.schema.simpleString()


def test_sources(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text(record() + "\n" + record(op="t") + "\n")
    lines = changelog.read_changes(spark, str(tmp_path / "lines"), "text")
    assert envelope.accepted(envelope.to_canonical(lines)).count() == 1
    for source in ("json", "orc", "parquet"):
        feed(spark, [record(), None]).write.format(source).save(str(tmp_path / source))
        read = changelog.read_changes(spark, str(tmp_path / source), source)
        assert envelope.accepted(envelope.to_canonical(read)).count() == 1
    with pytest.raises(ValueError):
        changelog.read_changes(spark, "x", "csv")


def test_topic_rules(spark):
    def one(expression):
        return spark.range(1).select(expression).first()[0]

    parts = {"my db": "my_db", "__a  b$$c_": "a_b_c", "$$": "unknown", "": "unknown", "  ": "unknown", "a.b-c": "a.b-c",
             "Ä": "unknown", "a__b": "a_b", "_": "unknown", "_a": "a", "a_": "a", "a_b": "a_b"}
    for part, expected in parts.items():
        assert one(routing.sanitize_topic_part(F.lit(part))) == expected
    assert one(routing.sanitize_topic_part(F.lit(None).cast("string"))) == "unknown"
    problems = {"": "EMPTY", ".": "DOTS", "..": "DOTS", "a" * 250: "TOO_LONG", "a b": "BAD_CHARACTERS", "a" * 249: None}
    for topic, expected in problems.items():
        assert one(routing.topic_problem(F.lit(topic))) == expected
    table = F.struct(F.lit("d b").alias("database"), F.lit(None).cast("string").alias("schema"), F.lit("t").alias("table"))
    assert one(routing.topic_name(table)) == "cdc.d_b.t"
    assert one(routing.topic_name(table, F.lit("{schema}/{table}"))) == "public/t"
    route = lambda t: one(routing.regex_route(F.lit(t), r"([^.]+)\.([^.]+)\.([^.]+)", "cdc-full.$3"))
    assert route("a.b.c") == "cdc-full.c" and route("a.b") == "a.b" and route("a.b.c.d") == "a.b.c.d"
