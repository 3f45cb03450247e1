"""The change feed that the registered queries read, derived from the whole ``events`` table.

One row per user; an ``error`` event deletes it; the before image is the user's previous event. Some
records are damaged on purpose, chosen by their number, so that every reject reason occurs. No event is
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.operators.skew import RANGE_WIDTH, previous_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_changes(spark: SparkSession, sf_dir: str, width: int = RANGE_WIDTH) -> DataFrame:
    """Changes before packing and damage, one per event."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    paired = previous_row(events, ["user_id"], "event_id", ["event_type", "value"], width=width)
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("user_id") % 3
    live_before = F.col("p_event_type").isNotNull() & (F.col("p_event_type") != "error")
    live_after = F.col("event_type") != "error"
    return paired.select(
        F.col("event_id").alias("lsn"),
        F.expr("event_id div 4").alias("tx_id"),
        F.col("user_id").alias("key_id"),
        F.when(kind == 0, "orders").when(kind == 1, "customers").otherwise("audit_log").alias("table_name"),
        F.when(kind != 2, "public").alias("schema_name"),
        F.concat(F.lit("{server=src"), (F.col("user_id") % 2).cast("string"), F.lit("}")).alias("source_partition"),
        F.when(~live_after, "d")
        .when(F.col("p_event_type").isNull() & (F.col("event_type") == "signup"), "r")
        .when(~live_before, "c")
        .otherwise("u")
        .alias("op"),
        millis.alias("source_ts_ms"),
        (millis + F.floor("value")).alias("ts_ms"),
        F.when(live_before, F.col("p_event_type")).alias("before_status"),
        F.when(live_before, F.col("p_value")).alias("before_amount"),
        F.when(live_after, F.col("event_type")).alias("after_status"),
        F.when(live_after, F.col("value")).alias("after_amount"),
    )


def _image(side: str):
    status = F.col(f"{side}_status")
    return F.when(
        status.isNotNull(),
        F.struct(
            F.col("key_id").alias("id"),
            status.alias("status"),
            F.col(f"{side}_amount").alias("amount"),
            F.lit(None).cast("string").alias("note"),
        ),
    )


def pack(changes: DataFrame, damaged: bool = True) -> DataFrame:
    """Row changes as a feed: value, source_partition, source_offset."""
    lsn, op = F.col("lsn"), F.col("op")
    fault = F.lit(None).cast("string")
    if damaged:
        fault = (
            F.when(lsn % 103 == 0, "value")
            .when(lsn % 101 == 0, "op")
            .when(lsn % 109 == 0, "table")
            .when(lsn % 107 == 0, "offset")
            .when((op == "u") & (lsn % 113 == 0), "before")
            .otherwise("none")
        )
    rows = changes.withColumn("_fault", F.coalesce(fault, F.lit("none")))
    source = F.struct(
        F.lit("2.3.0").alias("version"),
        F.lit("postgresql").alias("connector"),
        F.col("source_ts_ms").alias("ts_ms"),
        F.lit("cdcdb").alias("db"),
        F.col("schema_name").alias("schema"),
        F.when(F.col("_fault") == "table", " ").otherwise(F.col("table_name")).alias("table"),
        F.col("lsn"),
    )
    envelope = F.struct(
        F.when(F.col("_fault") != "before", _image("before")).alias("before"),
        _image("after").alias("after"),
        source.alias("source"),
        F.when(F.col("_fault") == "op", "t").otherwise(op).alias("op"),
        F.col("ts_ms"),
    )
    offset = F.struct(
        F.col("lsn"),
        F.col("tx_id").alias("txId"),
        F.col("lsn").alias("sequence"),
        F.col("ts_ms").alias("timestamp"),
        F.lit(None).cast("string").alias("snapshot"),
    )
    with_nulls = {"ignoreNullFields": "false"}
    return rows.select(
        F.when(F.col("_fault") != "value", F.to_json(envelope, with_nulls)).alias("value"),
        "source_partition",
        F.when(F.col("_fault") == "offset", "{}").otherwise(F.to_json(offset, with_nulls)).alias("source_offset"),
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(row_changes(spark, sf_dir))


# The same feed in SQL: ``f`` has one row per record with what a reader must find in it.
FEED_SQL = """
WITH s AS (
  SELECT *, lag(event_type) OVER w AS p_type, lag(value) OVER w AS p_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (
  SELECT event_id AS lsn, event_id // 4 AS tx_id, user_id AS key_id,
    CASE user_id % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'customers' ELSE 'audit_log' END AS table_name,
    CASE WHEN user_id % 3 = 2 THEN NULL ELSE 'public' END AS schema_name,
    '{server=src' || CAST(user_id % 2 AS VARCHAR) || '}' AS source_partition,
    CASE WHEN event_type = 'error' THEN 'd'
         WHEN p_type IS NULL AND event_type = 'signup' THEN 'r'
         WHEN p_type IS NULL OR p_type = 'error' THEN 'c' ELSE 'u' END AS op,
    epoch_us(ts) // 1000 AS source_ts_ms, epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) AS ts_ms,
    CASE WHEN p_type IS NOT NULL AND p_type <> 'error' THEN p_type END AS before_status,
    CASE WHEN p_type IS NOT NULL AND p_type <> 'error' THEN p_value END AS before_amount,
    CASE WHEN event_type <> 'error' THEN event_type END AS after_status,
    CASE WHEN event_type <> 'error' THEN value END AS after_amount
  FROM s),
a AS (
  SELECT *, CASE WHEN lsn % 103 = 0 THEN 'TOMBSTONE' WHEN lsn % 101 = 0 THEN 'UNKNOWN_OP'
      WHEN lsn % 109 = 0 THEN 'BLANK_TABLE' WHEN lsn % 107 = 0 THEN 'EMPTY_OFFSET'
      WHEN op = 'u' AND lsn % 113 = 0 THEN 'UPDATE_WITHOUT_BEFORE'
      WHEN op = 'd' AND before_status IS NULL THEN 'DELETE_WITHOUT_BEFORE' END AS reason,
    CASE op WHEN 'u' THEN 'UPDATE' WHEN 'd' THEN 'DELETE' ELSE 'INSERT' END AS operation,
    'cdcdb.' || CASE WHEN schema_name IS NULL THEN '' ELSE schema_name || '.' END || table_name AS fqn
  FROM r),
f AS (SELECT * FROM a WHERE reason IS NULL)
"""


def iso_ms_sql(millis: str) -> str:
    """SQL for epoch milliseconds as ISO text."""
    return (
        f"strftime(make_timestamp(({millis}) * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({millis}) % 1000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST(({millis}) % 1000 AS VARCHAR), 3, '0') END || 'Z'"
    )


def iso_us_sql(timestamp: str) -> str:
    """SQL for a timestamp with microseconds as ISO text."""
    micros = f"(epoch_us({timestamp}) % 1000000)"
    return (
        f"strftime({timestamp}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN '' "
        f"WHEN {micros} % 1000 = 0 THEN '.' || lpad(CAST({micros} // 1000 AS VARCHAR), 3, '0') "
        f"ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END || 'Z'"
    )
