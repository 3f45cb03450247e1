"""Rules, positions, state, differences, drift and the two-level helpers, against brute force."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changefeed.operators import diff, drift, envelope, metrics, positions, rules, skew, state
from changefeed.plans import feed as plan_feed
from changefeed.plans.capture import RULES_V1, RULES_V2, events, rule_table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- two-level helpers -------------------------------------------------------------------------------------

def hot_rows(n=3000):
    """One key has a third of all rows; another is NULL."""
    dice = random.Random(3)
    return [(dice.choice(["hot", "hot", "a", "b", None, "c"]), i * 3, dice.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_previous_row(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    want, last = [], {}
    for k, o, v in rows:
        want.append((k, o, v, last.get(k)))
        last[k] = v
    assert rows_of(skew.previous_row(df, ["k"], "o", ["v"], width=width)) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [5, 1000, 1 << 20])
def test_running_number(spark, width):
    rows = [(k, o // 10, v * 1000 + i) for i, (k, o, v) in enumerate(hot_rows())]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    want, seen = [], {}
    for k, o, v in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, o, v, seen[k]))
    assert rows_of(skew.running_number(df, ["k"], ["o", "v"], "n", width)) == sorted(want, key=repr)


@pytest.mark.parametrize("values", [[5], [1, 2], [7] * 500 + list(range(-300, 900, 7)), list(range(1000))])
def test_percentiles(spark, values):
    counts = spark.createDataFrame([(v,) for v in values], "v bigint").groupBy("v").count()
    got = skew.exact_percentiles(counts, "v", "count", [0.0, 0.5, 0.95, 0.99, 1.0], list("abcde"), width=16).first()
    want = spark.createDataFrame([(v,) for v in values], "v bigint").select(
        F.percentile("v", F.lit([0.0, 0.5, 0.95, 0.99, 1.0]))
    ).first()[0]
    assert list(got) == pytest.approx(want)


def test_broadcast_needs_a_small_side(spark):
    def hinted(df):
        return "BroadcastExchange" in plan(spark.range(10).join(df, "id")) and "ResolvedHint" in logical(df)

    def logical(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert hinted(skew.broadcast_if_small(spark.range(5), 5))
    assert "ResolvedHint" not in logical(skew.broadcast_if_small(spark.range(6), 5))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- plans -------------------------------------------------------------------------------------------------

def test_one_parse_per_record_and_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "feed")
    spark.createDataFrame([("{}", "p", "{}", 1)], "value string, source_partition string, source_offset string, other int").write.parquet(path)
    accepted = envelope.accepted(envelope.to_canonical(spark.read.parquet(path).drop("other")))
    text = plan(accepted.select("fqn", "operation", "before", "after"))
    assert text.count("_malformed,StringType") == 1
    assert "Exchange" not in text and "other" not in text


def test_replay_limits_groups_before_the_shuffle(spark, sf_dir):
    keyed = events(spark, sf_dir).withColumn("id", F.coalesce(envelope.get_field(F.col("after"), "id"), envelope.get_field(F.col("before"), "id")).cast("bigint"))
    text = plan(state.replay_state(keyed, ["fqn", "id"]))
    assert "row_number(), 1, Partial" in text
    assert "partial_min_by" in plan(state.net_changes(keyed, ["fqn", "id"]))
    assert "partial_" in plan(state.dedupe(keyed))


# --- rules -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    "name, kind, expected",
    [("orders", "POSTGRESQL", ("app", "public", "orders")), ("sales.orders", "SQLSERVER", ("app", "sales", "orders")),
     ("orders", "mysql", ("app", None, "orders")), ("shop.orders", "MYSQL", ("shop", None, "orders")),
     ("a.b.c", "POSTGRESQL", None), ("a.b.c.d", "MYSQL", None), ("orders.", "ORACLE", ("app", "public", "orders"))],
)
def test_split_qualified_name(spark, name, kind, expected):
    split = rules.split_qualified_name(F.lit(name), F.lit(kind), F.lit("app"))
    got = spark.range(1).select(split.alias("s")).first().s
    assert (tuple(got) if got else None) == expected


def test_rules(spark):
    short = spark.createDataFrame([("orders",), ("x.y",), ("a.b.c",)], "table string")
    assert rows_of(rules.resolve_rule_names(short, "d", "POSTGRESQL").select("fqn")) == [("d.public.orders",), ("d.x.y",)]
    keys = spark.createDataFrame([(["a"],), ([],), (["a", "a"],), (None,)], "k array<string>")
    assert [r[0] for r in keys.select(rules.valid_key_columns(F.col("k"))).collect()] == [True, False, False, False]


def test_rule_table_diff(spark):
    old, new = rule_table(spark, RULES_V1), rule_table(spark, RULES_V2)
    assert [r.fqn for r in diff.rows_added(new, old, ["fqn"]).collect()] == ["cdcdb.audit_log"]
    assert [r.fqn for r in diff.rows_removed(new, old, ["fqn"]).collect()] == ["cdcdb.public.customers"]
    assert [r.fqn for r in diff.rows_changed(new, old, ["fqn"]).collect()] == ["cdcdb.public.orders"]
    assert diff.rows_changed(new, old, ["fqn"], ["include_mode", "column_filter"]).count() == 0
    assert diff.rows_added(new, None, ["fqn"]).count() == 2 and diff.rows_removed(new, None, ["fqn"]).count() == 0
    assert diff.has_changed(new, old, ["fqn"]).first().changed is True
    assert diff.has_changed(new, new, ["fqn"]).first().changed is False
    assert diff.has_changed(new, None, ["fqn"]).first().changed is True
    assert {r.operation for r in diff.snapshot_diff(new, None, ["fqn"]).collect()} == {"INSERT"}


# --- positions ---------------------------------------------------------------------------------------------

POSITION = "struct<source_partition: string, ts_key: bigint, seq_key: bigint, log_file: string, log_key: bigint>"
small = st.none() | st.integers(0, 3)
texts = st.none() | st.sampled_from(["bin.9", "bin.10", "bin.010", "bin", "0/FF", "0/100", "1/0", "2a:7:5", "2A:10:5", "[\"9\",\"10\"]", "[\"9\",\"9\"]", ""])
places = st.tuples(st.sampled_from(["p", "q"]), small, small, texts, small)


def expected_key(at):
    """The key of a position, from Python's own order: what is missing first, numbers in text by value."""

    def number(digits):
        return f"{len(digits.lstrip(chr(48))):03}{digits.lstrip(chr(48)).lower()}"

    def text(t):
        if re.fullmatch("[0-9A-Fa-f]+([:/][0-9A-Fa-f]+)+", t):
            return ":".join(number(g) for g in re.split("[:/]", t))
        return "".join(number(g) if g.isdigit() else g for g in re.findall("[0-9]+|[^0-9]+", t))

    parts = (at[1], at[2], None if at[3] is None else text(at[3]), at[4])
    return (at[0], *((p is not None, p or 0 if not isinstance(p, str) else p) for p in parts))


def sign(a, b):
    x, y = expected_key(a), expected_key(b)
    return (x > y) - (x < y)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(places, places), min_size=20, max_size=60))
def test_compare_positions(spark, pairs):
    """Comparison is the sign of the order of keys, whatever parts are missing."""
    df = spark.createDataFrame(pairs, f"a {POSITION}, b {POSITION}")
    a, b = F.col("a"), F.col("b")
    keys = [F.struct(at["source_partition"], positions.sort_key(at)) for at in (a, b)]
    rows = df.select(
        "a", "b", positions.compare(a, b), positions.compare(b, a), positions.is_after(a, b), positions.is_before(a, b),
        F.when(keys[0] < keys[1], -1).when(keys[0] > keys[1], 1).otherwise(0),
    ).collect()
    for r in rows:
        s = sign(r.a, r.b)
        assert tuple(r)[2:] == (s, -s, s > 0, s < 0, s), (r.a, r.b)
    ordered = df.select(F.col("a").alias("position")).orderBy(*positions.order_columns()).collect()
    assert all(sign(x[0], y[0]) <= 0 for x, y in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("rising", [
    ["mysql-bin.000099", "mysql-bin.000100", "mysql-bin.999999", "mysql-bin.1000000"],
    ["0/FF", "0/16B3748", "1/0", "1/1", "A/0", "10/0"],
    ["0000002A:00000758:0005", "0000002a:00000758:000a", "0000002A:00000759:0001", "0000010A:00000001:0001"],
    ['["9","10"]', '["9","11"]', '["10","1"]', '["100","2"]'],
    ["99999999999999999999", "100000000000000000000"],
])
def test_places_order_as_the_log_does(spark, rising):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(rising)], "t string, i int")
    assert [r.i for r in df.orderBy(positions.place_text(F.col("t"))).collect()] == list(range(len(rising)))


def test_compat_compares_by_time_else_sequence(spark):
    df = spark.createDataFrame([(("p", 5, None, None, 9), ("p", 5, 3, None, 10)), (("p", None, 2, "z", 1), ("p", 7, 3, "a", 2)), (("p", 1, 9, "a", 1), None)], f"a {POSITION}, b {POSITION}")
    got = [tuple(r) for r in df.select(positions.compare(F.col("a"), F.col("b"), "compat"), positions.compare(F.col("a"), F.col("b"))).collect()]
    assert got == [(0, -1), (-1, -1), (None, None)]


def placed(spark, rows):
    """Events (fqn, source, time, sequence, file, number)."""
    df = spark.createDataFrame(rows, "fqn string, s string, t bigint, q bigint, f string, l bigint")
    at = F.struct(F.col("s").alias("source_partition"), F.col("t").alias("ts_key"), F.col("q").alias("seq_key"), F.col("f").alias("log_file"), F.col("l").alias("log_key"))
    return df.select("fqn", at.alias("position"))


def test_resume_by_log_place_alone(spark):
    """Positions without a time: the file, then the number, tells what comes after."""
    rows = [("t", "p", None, None, f"bin.{n}", m) for n in (9, 10, 100) for m in (1, 2)]
    saved = spark.createDataFrame([("p", ("p", None, None, "bin.10", 1))], f"source_partition string, position {POSITION}")
    left = positions.resume_after(placed(spark, rows), saved).select("position.log_file", "position.log_key")
    assert rows_of(left) == [("bin.10", 2), ("bin.100", 1), ("bin.100", 2)]
    assert positions.latest_positions(placed(spark, rows)).first().position.log_file == "bin.100"


def test_delivery_numbers(spark):
    """A table with all its events at one moment, one of two events and one without a name; the numbering needs one exchange of the events."""
    rng = random.Random(2)
    rows = [("hot", "p", 7, n, None, n) for n in range(500)] + [("b", "p", 1, None, None, None), ("b", "p", None, 1, None, None), (None, "p", 1, 1, None, None)]
    rng.shuffle(rows)
    numbered = positions.with_delivery_number(placed(spark, rows).repartition(4), partitions=6)
    got = {(r.fqn, r.position.ts_key, r.position.seq_key): r.delivery_no for r in numbered.collect()}
    assert got == {("hot", 7, n): n + 1 for n in range(500)} | {("b", None, 1): 1, ("b", 1, None): 2, (None, 1, 1): 1}


def test_delivery_order_on_disk(spark, sf_dir, tmp_path):
    """Files in name order hold each table in log order, and a table may fill several files."""
    path = str(tmp_path / "ordered")
    ordered = positions.in_delivery_order(events(spark, sf_dir), partitions=6)
    ordered.select("fqn", "position.source_partition", "position.ts_key", "position.seq_key").write.parquet(path)
    files = sorted(str(f) for f in (tmp_path / "ordered").glob("part-*.parquet"))
    assert len(files) > 3
    rows = [tuple(r) for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    assert rows == sorted(rows)


# --- state -------------------------------------------------------------------------------------------------

CHANGES = [  # key, time, op
    ("a", 1, "INSERT"), ("a", 2, "UPDATE"), ("b", 1, "INSERT"), ("b", 2, "DELETE"), ("c", 1, "UPDATE"), ("c", 2, "DELETE"),
    ("d", 1, "DELETE"), ("d", 2, "INSERT"), ("e", 1, "UPDATE"), ("f", 1, "INSERT"), ("f", 2, "DELETE"), ("f", 3, "INSERT"),
]


def small_events(spark):
    df = spark.createDataFrame(CHANGES, "key string, t bigint, operation string")
    image = F.to_variant_object(F.struct(F.col("t")))
    return df.select(
        F.lit("db.t").alias("fqn"), "key", "operation", F.timestamp_seconds("t").alias("timestamp"),
        F.when(F.col("operation") != "INSERT", image).alias("before"),
        F.when(F.col("operation") != "DELETE", image).alias("after"),
        F.struct(F.lit("p").alias("source_partition"), F.lit(None).cast("variant").alias("offset"), F.col("t").alias("ts_key"),
                 F.lit(None).cast("bigint").alias("seq_key"), F.lit(None).cast("string").alias("log_file"),
                 F.lit(None).cast("bigint").alias("log_key")).alias("position"),
    )


def test_net_changes(spark):
    net = state.net_changes(small_events(spark), ["key"]).select("key", "operation")
    assert rows_of(net) == [("a", "INSERT"), ("c", "DELETE"), ("d", "UPDATE"), ("e", "UPDATE"), ("f", "INSERT")]


def test_replay(spark):
    assert [r[0] for r in rows_of(state.replay_state(small_events(spark), ["key"]).select("key"))] == ["a", "d", "e", "f"]
    earlier = state.state_as_of(small_events(spark), ["key"], F.col("position.ts_key") <= 1)
    assert [r[0] for r in rows_of(earlier.select("key"))] == ["a", "b", "c", "e", "f"]


def test_row_versions(spark):
    """Two versions of the rows from one pass, and their differences, are what two passes and a join give."""
    events = small_events(spark).withColumn("v", F.col("position.ts_key") + F.ascii("key"))
    bound = F.col("position.ts_key") <= 1
    both = state.row_versions(events, ["key"], ["v"], {"now": F.lit(True), "then": bound})
    now, then = (df.select("key", "v") for df in (state.replay_state(events, ["key"]), state.state_as_of(events, ["key"], bound)))
    assert rows_of(both.where("now is not null").select("key", "now.v")) == rows_of(now)
    assert rows_of(both.where("then is not null").select("key", "then.v")) == rows_of(then)
    assert rows_of(diff.version_diff(both, ["key"], "now", "then")) == rows_of(diff.snapshot_diff(now, then, ["key"]))
    assert both.where("now is null and then is null").count() == 0


def test_replay_equals_final_state(spark, sf_dir):
    """Replay of the feed without damage is the last event of each user."""
    feed = plan_feed.pack(plan_feed.row_changes(spark, sf_dir, width=64), damaged=False)
    accepted = envelope.accepted(envelope.to_canonical(feed))
    keyed = accepted.withColumn("id", F.coalesce(envelope.get_field(F.col("after"), "id", "bigint"), envelope.get_field(F.col("before"), "id", "bigint")))
    got = rows_of(state.replay_state(keyed, ["id"]).select("id", envelope.get_field(F.col("after"), "status", "string")))
    last = {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        last[r.user_id] = r.event_type
    assert got == sorted(((k, v) for k, v in last.items() if v != "error"), key=repr)


# --- metrics -----------------------------------------------------------------------------------------------

def test_violations(spark):
    bad = spark.createDataFrame([(1, 2, -1, 3.0, 2.0, 4.0, 5, 4)], "captured int, published int, failed int, p50_ms double, p95_ms double, p99_ms double, period_start int, period_end int")
    found = metrics.violations(metrics.check_metrics(bad, metrics.capture_checks(), F.lit("x")))
    assert {r.check for r in found.collect()} == set(metrics.capture_checks())


@pytest.mark.parametrize(
    "states, overall",
    [(["UP"] * 3, "UP"), (["UP", "DOWN", "DEGRADED"], "DOWN"), (["UP", "DEGRADED", "UNKNOWN"], "DEGRADED"), (["UP", "UNKNOWN", "UP"], "UNKNOWN")],
)
def test_health(spark, states, overall):
    df = spark.createDataFrame([(1, s) for s in states], "check_id int, state string")
    row = metrics.health_rollup(df).first()
    assert (row.overall_state, row.healthy) == (overall, overall == "UP")


def test_run_states(spark):
    states = ["RUNNING", "STOPPED", "FAILED", "STARTING", "STOPPING", "OTHER"]
    df = spark.createDataFrame([(s,) for s in states], "s string").select(metrics.run_state_health(F.col("s")))
    assert [r[0] for r in df.collect()] == ["UP", "DOWN", "DOWN", "DEGRADED", "DEGRADED", "UNKNOWN"]


def test_empty_feed(spark):
    empty = envelope.to_canonical(spark.createDataFrame([], "value string, source_partition string, source_offset string"))
    row = metrics.capture_metrics(empty).first()
    assert (row.captured, row.published, row.failed, row.p50_ms, row.period_start) == (0, 0, 0, None, None)
    with pytest.raises(ValueError):
        metrics.look_back(F.current_timestamp(), 1441)


# --- drift -------------------------------------------------------------------------------------------------

def test_schema_changes(spark):
    rows = [("t", 1, "a", "int"), ("t", 1, "b", "text"), ("t", 5, "a", "int"), ("t", 5, "c", "text"),  # b renamed to c
            ("t", 6, "a", "text"), ("t", 6, "c", "text"), ("t", 6, "d", "int"), ("t", 6, "e", "int"),  # a typed, d and e added
            ("t", 7, "a", "text"), ("t", 7, "f", "date"), ("u", 3, "x", "int")]
    schemas = spark.createDataFrame(rows, "fqn string, version bigint, column string, type string")
    assert rows_of(drift.schema_changes(schemas)) == sorted([
        ("t", 5, "COLUMN_RENAMED", "b", "c", None, None),
        ("t", 6, "TYPE_CHANGED", "a", None, "int", "text"),
        ("t", 6, "COLUMN_ADDED", "d", None, None, "int"),
        ("t", 6, "COLUMN_ADDED", "e", None, None, "int"),
        ("t", 7, "COLUMN_REMOVED", "c", None, "text", None),
        ("t", 7, "COLUMN_REMOVED", "d", None, "int", None),
        ("t", 7, "COLUMN_REMOVED", "e", None, "int", None),
        ("t", 7, "COLUMN_ADDED", "f", None, None, "date"),
    ], key=repr)
