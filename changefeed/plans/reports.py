"""Queries on metrics, health and schema drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from changefeed.functions.instants import iso_instant
from changefeed.operators import drift, metrics
from changefeed.plans.capture import canonical, events, raw_lsn
from changefeed.plans.feed import FEED_SQL, iso_ms_sql, table
from changefeed.plans.registry import query
from changefeed.plans.rows import CUT, CUT_MS

_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (operation = '{op}') AS {op.lower()}_count" for op in ("INSERT", "UPDATE", "DELETE")
)
_PERCENTILES_SQL = ", ".join(
    f"round((SELECT quantile_cont(CAST(ts_ms - source_ts_ms AS DOUBLE), {p}) FROM f), 6) AS {name}"
    for name, p in metrics.LATENCY_POINTS.items()
)
_CAPTURE_SQL = f"""count(*) AS captured, count(*) FILTER (reason IS NULL) AS published,
    count(*) FILTER (reason IS NOT NULL) AS failed, {_PERCENTILES_SQL}"""


CAPTURE_SQL = FEED_SQL + f"""SELECT captured, published, failed, p50_ms, p95_ms, p99_ms, {iso_ms_sql('lo')} AS period_start,
    {iso_ms_sql('hi')} AS period_end FROM (SELECT {_CAPTURE_SQL}, min(ts_ms) FILTER (reason IS NULL) AS lo,
    max(ts_ms) FILTER (reason IS NULL) AS hi FROM a WHERE reason IS DISTINCT FROM 'TOMBSTONE')"""


def show_capture(row):
    return row.select(
        "captured", "published", "failed", *[F.round(p, 6).alias(p) for p in metrics.LATENCY_POINTS],
        iso_instant(F.col("period_start")).alias("period_start"), iso_instant(F.col("period_end")).alias("period_end"),
    )


@query("capture_metrics", CAPTURE_SQL)
def capture_metrics(spark, sf_dir):
    return show_capture(metrics.capture_metrics(canonical(spark, sf_dir)))


@query("table_metrics", FEED_SQL + f"""SELECT fqn, {_COUNTS_SQL}, {iso_ms_sql('max(ts_ms)')} AS last_event,
    max(ROW(ts_ms, lsn))[2] AS last_lsn FROM f GROUP BY fqn""")
def table_metrics(spark, sf_dir):
    rows = metrics.table_metrics(events(spark, sf_dir))
    return rows.select(
        "fqn", "insert_count", "update_count", "delete_count", iso_instant(F.col("last_event")).alias("last_event"),
        F.try_variant_get("last_position.offset", "$.lsn", "bigint").alias("last_lsn"),
    )


@query("metrics_since", FEED_SQL + f"SELECT fqn, {_COUNTS_SQL} FROM f WHERE ts_ms >= {CUT_MS} - 1440 * 60000 GROUP BY fqn")
def metrics_since(spark, sf_dir):
    start = metrics.look_back(F.lit(CUT).cast("timestamp"), 1440)
    return metrics.metrics_since(events(spark, sf_dir), start)


@query("metrics_by_period", FEED_SQL + f"""SELECT {iso_ms_sql('ts_ms // 3600000 * 3600000')} AS period_start, fqn, {_COUNTS_SQL} FROM f
    GROUP BY ts_ms // 3600000, fqn""")
def metrics_by_period(spark, sf_dir):
    rows = metrics.metrics_by_period(events(spark, sf_dir))
    return rows.withColumn("period_start", iso_instant(F.col("period_start"))).drop("period_end")


@query("metrics_invariants", FEED_SQL + """SELECT 'capture' AS scope, unnest(['counts_not_negative', 'published_within_captured',
    'percentiles_ascend', 'period_ascends']) AS "check", true AS ok
    UNION ALL SELECT fqn, unnest(['counts_not_negative', 'has_table']), true FROM (SELECT DISTINCT fqn FROM f)""")
def metrics_invariants(spark, sf_dir):
    capture = metrics.check_metrics(
        metrics.capture_metrics(canonical(spark, sf_dir)), metrics.capture_checks(), F.lit("capture")
    )
    tables = metrics.check_metrics(
        metrics.table_metrics(events(spark, sf_dir)), metrics.table_checks(), F.col("fqn")
    )
    return capture.unionByName(tables)


@query("batch_result", FEED_SQL + """SELECT lsn // 1000 AS batch_id, count(*) FILTER (reason IS NULL) AS success_count,
    count(*) FILTER (reason IS NOT NULL) AS failure_count, count(*) AS total,
    round(count(*) FILTER (reason IS NULL) / count(*), 6) AS success_rate,
    round(coalesce(avg(ts_ms - source_ts_ms) FILTER (reason IS NULL), 0), 6) AS mean_ms
    FROM a WHERE reason IS DISTINCT FROM 'TOMBSTONE' GROUP BY lsn // 1000""")
def batch_result(spark, sf_dir):
    number = raw_lsn()
    rows = metrics.batch_result(
        canonical(spark, sf_dir).withColumn("_lsn", number), F.call_function("div", F.col("_lsn"), F.lit(1000))
    )
    return rows.select(
        "batch_id", "success_count", "failure_count", "total", F.round("success_rate", 6).alias("success_rate"),
        F.round("mean_ms", 6).alias("mean_ms"),
    )


@query("health_rollup", """SELECT check_id, CASE WHEN bool_or(event_type = 'error') THEN 'DOWN' WHEN bool_or(event_type = 'click') THEN 'DEGRADED'
    WHEN bool_or(event_type = 'view') THEN 'UNKNOWN' ELSE 'UP' END AS overall_state,
    bool_and(event_type NOT IN ('error', 'click', 'view')) AS healthy FROM (SELECT event_id // 3 AS check_id, event_type FROM events) GROUP BY check_id""")
def health_rollup(spark, sf_dir):
    """Status log from ``events``: database and kafka report a state, the engine reports its run state."""
    event = F.col("event_type")
    run_state = (
        F.when(event == "error", "FAILED").when(event == "click", "STARTING")
        .when(event == "view", "PAUSED").otherwise("RUNNING")
    )
    reported = (
        F.when(event == "error", "DOWN").when(event == "click", "DEGRADED")
        .when(event == "view", "UNKNOWN").otherwise("UP")
    )
    is_engine = F.col("event_id") % 3 == 2
    log = table(spark, sf_dir, "events").select(
        F.expr("event_id div 3").alias("check_id"),
        F.when(is_engine, metrics.run_state_health(run_state)).otherwise(reported).alias("state"),
    )
    return metrics.health_rollup(log)


def schema_history(spark, sf_dir):
    """Per user and day the event types seen, each typed by its largest value."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").cast("string").alias("fqn"),
            F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("version"),
            F.col("event_type").alias("column"),
        )
        .agg(F.when(F.max("value") >= 100, "double").otherwise("int").alias("type"))
    )


_HISTORY_SQL = """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS fqn, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS version, event_type AS col,
    CASE WHEN max(value) >= 100 THEN 'double' ELSE 'int' END AS type FROM events GROUP BY ALL)"""


@query("schema_latest", _HISTORY_SQL + """ SELECT fqn, version, col AS "column", type FROM h
    JOIN (SELECT fqn, max(version) AS version FROM h GROUP BY fqn) USING (fqn, version)""")
def schema_latest(spark, sf_dir):
    return drift.latest_schemas(schema_history(spark, sf_dir)).select("fqn", "version", "column", "type")


@query("schema_changes", _HISTORY_SQL + """, v AS (SELECT fqn, version, lag(version) OVER (PARTITION BY fqn ORDER BY version) AS prev
      FROM (SELECT DISTINCT fqn, version FROM h)),
    o AS (SELECT v.fqn, v.version, h.col, h.type FROM v JOIN h ON h.fqn = v.fqn AND h.version = v.prev),
    n AS (SELECT v.fqn, v.version, h.col, h.type FROM v JOIN h ON h.fqn = v.fqn AND h.version = v.version WHERE prev IS NOT NULL),
    d AS (SELECT coalesce(o.fqn, n.fqn) AS fqn, coalesce(o.version, n.version) AS version, coalesce(o.col, n.col) AS col,
      o.type AS old_type, n.type AS new_type FROM o FULL JOIN n ON o.fqn = n.fqn AND o.version = n.version AND o.col = n.col
      WHERE o.type IS DISTINCT FROM n.type),
    e AS (SELECT fqn, version FROM d GROUP BY fqn, version HAVING count(*) FILTER (old_type IS NULL) = 1
      AND count(*) FILTER (new_type IS NULL) = 1 AND max(new_type) FILTER (old_type IS NULL) = max(old_type) FILTER (new_type IS NULL))
    SELECT fqn, version, CASE WHEN old_type IS NULL THEN 'COLUMN_ADDED' WHEN new_type IS NULL THEN 'COLUMN_REMOVED' ELSE 'TYPE_CHANGED' END AS change,
      col AS "column", CAST(NULL AS VARCHAR) AS new_name, old_type, new_type
      FROM d LEFT JOIN e USING (fqn, version) WHERE e.fqn IS NULL OR (old_type IS NOT NULL AND new_type IS NOT NULL)
    UNION ALL SELECT fqn, version, 'COLUMN_RENAMED', max(col) FILTER (new_type IS NULL), max(col) FILTER (old_type IS NULL), NULL, NULL
      FROM d JOIN e USING (fqn, version) GROUP BY fqn, version""")
def schema_changes(spark, sf_dir):
    return drift.schema_changes(schema_history(spark, sf_dir))
