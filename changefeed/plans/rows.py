"""Queries on positions, order, table state and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.operators import diff, envelope, positions, state
from changefeed.plans.capture import events, field, lsn, row_fields
from changefeed.plans.feed import FEED_SQL, change_feed
from changefeed.plans.registry import query
from changefeed.session import work_dir
from changefeed.sources import sinks

KEY = ["fqn", "key_id"]

# The moment at which the feed is cut for saved positions and older states: within its days at every scale.
CUT = "2024-01-16T00:00:00Z"
CUT_MS = 1705363200000


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    row_id = field("after", "id", "bigint"), field("before", "id", "bigint")
    return events(spark, sf_dir).withColumn("key_id", F.coalesce(*row_id))


def before_cut():
    return F.col("timestamp") < F.timestamp_millis(F.lit(CUT_MS))


POSITION_SQL = "ts_ms AS ts_key, lsn AS seq_key, lsn"


@query("position_order", FEED_SQL + f"SELECT source_partition, {POSITION_SQL} FROM f")
def position_order(spark, sf_dir):
    return positions.in_position_order(events(spark, sf_dir)).select(
        "position.source_partition", "position.ts_key", "position.seq_key", lsn()
    )


def saved_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as a run that stopped at the cut has stored them."""
    out = work_dir(spark, "positions")
    sinks.save_positions(events(spark, sf_dir).where(before_cut()), out)
    return sinks.load_positions(spark, out)


SAVED_SQL = f"""p AS (SELECT source_partition, max(ROW(ts_ms, lsn)) AS saved FROM f WHERE ts_ms < {CUT_MS} GROUP BY source_partition)"""


@query("position_compare", FEED_SQL + f""", {SAVED_SQL} SELECT lsn, CASE WHEN ROW(ts_ms, lsn) < saved THEN -1 WHEN ROW(ts_ms, lsn) > saved THEN 1
    ELSE 0 END AS sign, ROW(ts_ms, lsn) > saved AS is_after, ROW(ts_ms, lsn) < saved AS is_before FROM f JOIN p USING (source_partition)""")
def position_compare(spark, sf_dir):
    joined = positions.with_saved_position(events(spark, sf_dir), saved_at_cut(spark, sf_dir))
    at, saved = F.col("position"), F.col("saved")
    return joined.select(
        lsn(), positions.compare(at, saved).alias("sign"), positions.is_after(at, saved).alias("is_after"),
        positions.is_before(at, saved).alias("is_before"),
    )


@query("positions_latest", FEED_SQL + """SELECT source_partition, max(ts_ms) AS ts_key, max(ROW(ts_ms, lsn))[2] AS lsn
    FROM f GROUP BY source_partition""")
def positions_latest(spark, sf_dir):
    """Saved in two batches, then loaded: the later batch replaces the earlier."""
    out = work_dir(spark, "positions")
    feed = events(spark, sf_dir)
    sinks.save_positions(feed.where(before_cut()), out)
    sinks.save_positions(feed.where(~before_cut()), out)
    return sinks.load_positions(spark, out).select("source_partition", F.col("position.ts_key").alias("ts_key"), lsn())


@query("resume_after", FEED_SQL + f""", {SAVED_SQL} SELECT lsn, operation FROM f JOIN p USING (source_partition)
    WHERE ROW(ts_ms, lsn) > saved""")
def resume_after(spark, sf_dir):
    return positions.resume_after(events(spark, sf_dir), saved_at_cut(spark, sf_dir)).select(lsn(), "operation")


@query("ordered_per_table", FEED_SQL + """SELECT fqn, lsn, row_number() OVER (PARTITION BY fqn ORDER BY ts_ms, lsn) AS delivery_no
    FROM f""")
def ordered_per_table(spark, sf_dir):
    """Numbered in one exchange of the events, by ranges of table and position."""
    return positions.with_delivery_number(events(spark, sf_dir).select("fqn", "position")).select("fqn", lsn(), "delivery_no")


LOG_FILE = 512  # events of a log file


def log_place_events(spark, sf_dir):
    """The events of the feed with offsets that tell a file with a numbered suffix and a place in it, and no time."""
    feed = change_feed(spark, sf_dir)
    number = F.try_variant_get(F.try_parse_json("source_offset"), "$.lsn", "bigint")
    place = F.struct(F.concat(F.lit("log."), F.expr(f"_lsn div {LOG_FILE}").cast("string")).alias("file"), (F.col("_lsn") % LOG_FILE).alias("pos"))
    placed = feed.withColumn("_lsn", number).withColumn("source_offset", F.when(F.col("_lsn").isNotNull(), F.to_json(place)).otherwise(F.col("source_offset")))
    return envelope.accepted(envelope.to_canonical(placed.drop("_lsn")))


def lsn_of_place():
    return (F.substring_index("position.log_file", ".", -1).cast("bigint") * LOG_FILE + F.col("position.log_key")).alias("lsn")


@query("resume_by_log_place", FEED_SQL + f""", p AS (SELECT source_partition, max(lsn) AS saved FROM f WHERE ts_ms < {CUT_MS} GROUP BY source_partition)
    SELECT lsn, operation FROM f JOIN p USING (source_partition) WHERE lsn > saved""")
def resume_by_log_place(spark, sf_dir):
    """Resume where positions have no time: by file, then by place in it. log.9 comes before log.10."""
    placed, out = log_place_events(spark, sf_dir), work_dir(spark, "positions")
    sinks.save_positions(placed.where(before_cut()), out)
    return positions.resume_after(placed, sinks.load_positions(spark, out)).select(lsn_of_place(), "operation")


@query("ordered_by_log_place", FEED_SQL + "SELECT fqn, lsn, row_number() OVER (PARTITION BY fqn ORDER BY lsn) AS delivery_no FROM f")
def ordered_by_log_place(spark, sf_dir):
    return positions.with_delivery_number(log_place_events(spark, sf_dir).select("fqn", "position")).select("fqn", lsn_of_place(), "delivery_no")


FIRST_LAST_SQL = """g AS (SELECT fqn, key_id, arg_min(ROW(op, before_status, before_amount), ROW(ts_ms, lsn)) AS fst,
    arg_max(ROW(op, after_status, after_amount), ROW(ts_ms, lsn)) AS lst FROM f GROUP BY fqn, key_id)"""


@query("net_changes", FEED_SQL + f""", {FIRST_LAST_SQL},
    n AS (SELECT fqn, key_id, fst[1] IN ('c', 'r') AS born, lst[1] = 'd' AS gone, fst[2] AS before_status,
      fst[3] AS before_amount, lst[2] AS after_status, lst[3] AS after_amount FROM g)
    SELECT fqn, key_id, CASE WHEN born THEN 'INSERT' WHEN gone THEN 'DELETE' ELSE 'UPDATE' END AS operation,
      before_status, before_amount, after_status, after_amount FROM n WHERE NOT (born AND gone)""")
def net_changes(spark, sf_dir):
    return state.net_changes(keyed_events(spark, sf_dir), KEY).select(
        *KEY, "operation", *row_fields("before"), *row_fields("after")
    )


def _state_sql(condition: str) -> str:
    return f"""(SELECT fqn, key_id, after_status AS status, after_amount AS amount, lsn, op FROM (
      SELECT *, row_number() OVER (PARTITION BY fqn, key_id ORDER BY ts_ms DESC, lsn DESC) AS rn FROM f WHERE {condition})
      WHERE rn = 1 AND op <> 'd')"""


NOW_SQL = _state_sql("true")
THEN_SQL = _state_sql(f"ts_ms < {CUT_MS}")


def rows_now(spark, sf_dir):
    return state.replay_state(keyed_events(spark, sf_dir), KEY).select(*KEY, *row_fields("after", "row"), lsn())


def rows_then(spark, sf_dir):
    return state.state_as_of(keyed_events(spark, sf_dir), KEY, before_cut()).select(
        *KEY, *row_fields("after", "row"), lsn()
    )


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"row_status": "status", "row_amount": "amount"})


@query("replay_state", FEED_SQL + f"SELECT fqn, key_id, status, amount, lsn FROM {NOW_SQL}")
def replay_state(spark, sf_dir):
    return _renamed(rows_now(spark, sf_dir))


@query("state_as_of", FEED_SQL + f"SELECT fqn, key_id, status, amount, lsn FROM {THEN_SQL}")
def state_as_of(spark, sf_dir):
    return _renamed(rows_then(spark, sf_dir))


def differences(spark, sf_dir):
    """What changed in the feed's tables since the cut: ``KEY``, operation, before, after. The feed is decoded once for both versions."""
    rows = keyed_events(spark, sf_dir).select("*", *row_fields("after", "row"))
    named = rows.withColumnsRenamed({"row_status": "status", "row_amount": "amount"})
    both = state.row_versions(named, KEY, ["status", "amount"], {"now": F.lit(True), "then": before_cut()})
    return diff.version_diff(both, KEY, "now", "then")


@query("rows_added", FEED_SQL + f"""SELECT c.fqn, c.key_id, c.status, c.amount FROM {NOW_SQL} c
    ANTI JOIN {THEN_SQL} p ON c.fqn = p.fqn AND c.key_id = p.key_id""")
def rows_added(spark, sf_dir):
    return differences(spark, sf_dir).where("operation = 'INSERT'").select(*KEY, "after.*")


@query("rows_removed", FEED_SQL + f"""SELECT p.fqn, p.key_id, p.status, p.amount FROM {THEN_SQL} p
    ANTI JOIN {NOW_SQL} c ON c.fqn = p.fqn AND c.key_id = p.key_id""")
def rows_removed(spark, sf_dir):
    return differences(spark, sf_dir).where("operation = 'DELETE'").select(*KEY, "before.*")


@query("rows_changed", FEED_SQL + f"""SELECT c.fqn, c.key_id, p.status AS old_status, p.amount AS old_amount,
    c.status AS new_status, c.amount AS new_amount FROM {NOW_SQL} c JOIN {THEN_SQL} p ON c.fqn = p.fqn AND c.key_id = p.key_id
    WHERE c.status <> p.status OR c.amount <> p.amount""")
def rows_changed(spark, sf_dir):
    changed = differences(spark, sf_dir).where("operation = 'UPDATE'")
    return changed.select(*KEY, *[F.col(f"{side}.{c}").alias(f"{age}_{c}") for age, side in (("old", "before"), ("new", "after")) for c in ("status", "amount")])


@query("snapshot_diff", FEED_SQL + f"""SELECT * FROM (SELECT coalesce(c.fqn, p.fqn) AS fqn, coalesce(c.key_id, p.key_id) AS key_id,
    CASE WHEN p.fqn IS NULL THEN 'INSERT' WHEN c.fqn IS NULL THEN 'DELETE'
      WHEN c.status <> p.status OR c.amount <> p.amount THEN 'UPDATE' END AS operation,
    p.status AS old_status, p.amount AS old_amount, c.status AS new_status, c.amount AS new_amount
    FROM {NOW_SQL} c FULL JOIN {THEN_SQL} p ON c.fqn = p.fqn AND c.key_id = p.key_id) WHERE operation IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    return differences(spark, sf_dir).select(
        *KEY, "operation", F.col("before.status").alias("old_status"), F.col("before.amount").alias("old_amount"),
        F.col("after.status").alias("new_status"), F.col("after.amount").alias("new_amount"),
    )


@query("duplicate_keys", FEED_SQL + f"""SELECT fqn, status, count(*) AS n FROM {NOW_SQL} GROUP BY fqn, status
    HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    """Status taken as the key of live rows: not unique, so it would be a bad key."""
    return state.duplicate_keys(_renamed(rows_now(spark, sf_dir)), ["fqn", "status"])


@query("transaction_groups", FEED_SQL + """SELECT source_partition, tx_id, count(*) AS n_events,
    min(ROW(ts_ms, lsn))[2] AS first_lsn, max(ROW(ts_ms, lsn))[2] AS last_lsn FROM f GROUP BY source_partition, tx_id""")
def transaction_groups(spark, sf_dir):
    groups = state.transaction_groups(events(spark, sf_dir))
    return groups.select(
        "source_partition", "tx_id", "n_events",
        F.try_variant_get("first_position.offset", "$.lsn", "bigint").alias("first_lsn"),
        F.try_variant_get("last_position.offset", "$.lsn", "bigint").alias("last_lsn"),
    )


@query("dedupe_events", FEED_SQL + "SELECT lsn, operation, after_status, after_amount FROM f")
def dedupe_events(spark, sf_dir):
    """The whole feed delivered twice."""
    feed = change_feed(spark, sf_dir)
    twice = envelope.accepted(envelope.to_canonical(feed.unionByName(feed)))
    return state.dedupe(twice).select(lsn(), "operation", *row_fields("after"))
