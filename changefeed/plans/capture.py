"""Queries over the feed: sources, decoding, checks, rules, routing, wire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.functions.instants import iso_instant
from changefeed.operators import envelope, positions, routing, rules, state, validate, wire
from changefeed.plans import pipeline
from changefeed.plans.feed import FEED_SQL, change_feed, iso_ms_sql, iso_us_sql, pack, row_changes, table
from changefeed.plans.registry import query
from changefeed.session import work_dir
from changefeed.sources import changelog, sinks

# Rules of the feed's tables, two versions.
RULES_V1 = [
    ("cdcdb.public.orders", "INCLUDE_ALL", [], ["id"], "cdc.{database}.{table}"),
    ("cdcdb.public.customers", "EXCLUDE_SPECIFIED", ["amount"], ["id"], "cdc.{database}.{schema}.{table}"),
]
RULES_V2 = [
    ("cdcdb.public.orders", "EXCLUDE_SPECIFIED", ["note"], ["id"], "cdc.{database}.{table}"),
    ("cdcdb.audit_log", "INCLUDE_ALL", [], ["id", "status"], "{database}-changes-{table}"),
]


def rule_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, rules.RULES_SCHEMA)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.to_canonical(change_feed(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.accepted(canonical(spark, sf_dir))


def lsn(position: str = "position"):
    return F.try_variant_get(f"{position}.offset", "$.lsn", "bigint").alias("lsn")


def raw_lsn(value: str = "value"):
    """Log number of a record as it came, from its source block."""
    return F.try_variant_get(F.try_parse_json(value), "$.source.lsn", "bigint").alias("lsn")


def field(side: str, name: str, data_type: str):
    return envelope.get_field(F.col(side), name, data_type)


def row_fields(side: str, prefix: str | None = None):
    prefix = side if prefix is None else prefix
    return [field(side, "status", "string").alias(f"{prefix}_status"), field(side, "amount", "double").alias(f"{prefix}_amount")]


@query(
    "envelope_scan",
    FEED_SQL + """SELECT lsn, 'cdcdb' AS db, CASE WHEN reason = 'BLANK_TABLE' THEN ' ' ELSE table_name END AS table_name,
    CASE WHEN reason = 'UNKNOWN_OP' THEN 't' ELSE op END AS op, ts_ms, source_ts_ms
    FROM a WHERE reason IS DISTINCT FROM 'TOMBSTONE'""",
)
def envelope_scan(spark, sf_dir):
    parsed = envelope.parse_envelopes(envelope.drop_tombstones(change_feed(spark, sf_dir)))
    e = F.col("envelope")
    return parsed.select(
        envelope.log_number(e["source"]["lsn"]).alias("lsn"), e["source"]["db"].alias("db"), e["source"]["table"].alias("table_name"),
        e["op"].alias("op"), e["ts_ms"].alias("ts_ms"), e["source"]["ts_ms"].alias("source_ts_ms"),
    )


@query(
    "snapshot_orders",
    f"""SELECT o_orderkey AS order_key, 'tpch.public.orders' AS fqn, 'INSERT' AS operation,
    o_orderstatus AS status, o_totalprice AS total, {iso_us_sql('o_orderdate')} AS order_date,
    {iso_us_sql('o_orderdate')} AS event_time FROM orders""",
)
def snapshot_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return changelog.snapshot_changes(orders, "tpch", "orders", ["o_orderkey"], at).select(
        field("after", "o_orderkey", "bigint").alias("order_key"), "fqn", "operation",
        field("after", "o_orderstatus", "string").alias("status"),
        field("after", "o_totalprice", "double").alias("total"),
        field("after", "o_orderdate", "string").alias("order_date"),
        iso_instant(F.col("timestamp")).alias("event_time"),
    )


@query(
    "include_tables",
    FEED_SQL + "SELECT lsn, fqn, operation FROM f WHERE fqn IN ('cdcdb.public.orders', 'cdcdb.public.customers')",
)
def include_tables(spark, sf_dir):
    kept = rules.include_tables(events(spark, sf_dir), rule_table(spark, RULES_V1))
    return kept.select(lsn(), "fqn", "operation")


@query(
    "multi_source_union",
    FEED_SQL + """SELECT 'app' AS source_system, fqn, operation, count(*) AS n FROM f GROUP BY fqn, operation
    UNION ALL SELECT 'tpch', 'tpch.public.orders', 'INSERT', count(*) FROM orders""",
)
def multi_source_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    union = changelog.union_sources(
        {
            "app": events(spark, sf_dir),
            "tpch": changelog.snapshot_changes(orders, "tpch", "orders", ["o_orderkey"], at),
        }
    )
    return union.groupBy("source_system", "fqn", "operation").agg(F.count("*").alias("n"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(canonical(spark, sf_dir)).messages


WIRE_TEXT = "`table` STRUCT<database: STRING, `schema`: STRING, `table`: STRING>, operation STRING, `timestamp` STRING, " \
    "position STRUCT<sourcePartition: STRING, offset: VARIANT>, before VARIANT, after VARIANT, " \
    "metadata STRUCT<source: STRING, version: STRING, connector: STRING, schemaVersion: BIGINT>"


@query(
    "kafka_rows",
    FEED_SQL + """SELECT 'cdc.cdcdb.' || table_name AS topic, fqn AS key, lsn, operation,
    before_status, before_amount, after_status, after_amount FROM f""",
)
def kafka_rows(spark, sf_dir):
    rows = messages(spark, sf_dir).select("topic", "key", F.explode(F.array(F.from_json("value", WIRE_TEXT))).alias("w"))
    return rows.select("topic", "key", "w.*").select(
        "topic", "key", lsn(), "operation", *row_fields("before"), *row_fields("after")
    )


@query(
    "topic_fanout_counts",
    FEED_SQL + "SELECT 'cdc.cdcdb.' || table_name AS topic, count(*) AS n FROM f GROUP BY table_name",
)
def topic_fanout_counts(spark, sf_dir):
    out = work_dir(spark, "topics")
    sinks.write_by_topic(messages(spark, sf_dir), out)
    return spark.read.parquet(out).groupBy("topic").agg(F.count("*").alias("n"))


@query("rejected_rows", FEED_SQL + "SELECT lsn, reason, op AS op FROM "
       "(SELECT lsn, reason, CASE WHEN reason = 'UNKNOWN_OP' THEN 't' ELSE op END AS op FROM a "
       "WHERE reason IS NOT NULL AND reason <> 'TOMBSTONE')")
def rejected_rows(spark, sf_dir):
    dead = envelope.rejected(canonical(spark, sf_dir))
    return dead.select(
        raw_lsn(), F.col("reject_reason").alias("reason"),
        F.try_variant_get(F.try_parse_json("value"), "$.op", "string").alias("op"),
    )


@query("op_decode", FEED_SQL + """SELECT lsn, CASE WHEN reason = 'UNKNOWN_OP' THEN NULL ELSE operation END AS operation
    FROM a WHERE reason IS DISTINCT FROM 'TOMBSTONE'""")
def op_decode(spark, sf_dir):
    parsed = envelope.parse_envelopes(envelope.drop_tombstones(change_feed(spark, sf_dir)))
    return parsed.select(
        envelope.log_number(F.col("envelope.source.lsn")).alias("lsn"), envelope.decode_operation(F.col("envelope.op")).alias("operation")
    )


@query("event_time", FEED_SQL + f"SELECT lsn, {iso_ms_sql('ts_ms')} AS event_time, "
       f"{iso_ms_sql('source_ts_ms')} AS source_time FROM f")
def event_time(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), iso_instant(F.col("timestamp")).alias("event_time"), iso_instant(F.col("source_ts")).alias("source_time")
    )


@query("fqn", FEED_SQL + "SELECT lsn, 'cdcdb' AS database_name, schema_name, table_name, fqn FROM f")
def fqn(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), F.col("table.database").alias("database_name"), F.col("table.schema").alias("schema_name"),
        F.col("table.table").alias("table_name"), "fqn",
    )


@query("row_images", FEED_SQL + """SELECT lsn, before_status IS NOT NULL AS has_before, after_status IS NOT NULL AS has_after,
    before_status, before_amount, after_status, after_amount FROM f""")
def row_images(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"),
        *row_fields("before"), *row_fields("after"),
    )


@query("position_project", FEED_SQL + """SELECT lsn, source_partition, CAST(4 AS BIGINT) AS n_entries,
    false AS has_snapshot, tx_id, ts_ms AS ts_key, lsn AS seq_key FROM f""")
def position_project(spark, sf_dir):
    offset = F.col("position.offset")
    return events(spark, sf_dir).select(
        lsn(), F.col("position.source_partition").alias("source_partition"),
        envelope.field_count(offset).cast("bigint").alias("n_entries"),
        envelope.has_field(offset, "snapshot").alias("has_snapshot"),
        F.try_variant_get(offset, "$.txId", "bigint").alias("tx_id"),
        F.col("position.ts_key").alias("ts_key"), F.col("position.seq_key").alias("seq_key"),
    )


@query("metadata_enrich", FEED_SQL + """SELECT lsn, 'changefeed' AS source, '1.0.0' AS version, 'postgresql' AS connector,
    CAST(1 AS BIGINT) AS schema_version FROM f""")
def metadata_enrich(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), "metadata.source", "metadata.version", "metadata.connector",
        F.col("metadata.schemaVersion").cast("bigint").alias("schema_version"),
    )


@query("tombstone_filter", FEED_SQL + "SELECT lsn FROM a WHERE reason IS DISTINCT FROM 'TOMBSTONE'")
def tombstone_filter(spark, sf_dir):
    return envelope.drop_tombstones(change_feed(spark, sf_dir)).select(raw_lsn())


@query("canonical_events", FEED_SQL + f"""SELECT lsn, fqn, operation, {iso_ms_sql('ts_ms')} AS event_time, source_partition,
    before_status, before_amount, after_status, after_amount, 'postgresql' AS connector FROM f""")
def canonical_events(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), "fqn", "operation", iso_instant(F.col("timestamp")).alias("event_time"),
        F.col("position.source_partition").alias("source_partition"),
        *row_fields("before"), *row_fields("after"), F.col("metadata.connector").alias("connector"),
    )


@query("op_predicates", FEED_SQL + """SELECT lsn, operation = 'INSERT' AS is_insert, operation = 'UPDATE' AS is_update,
    operation = 'DELETE' AS is_delete FROM f""")
def op_predicates(spark, sf_dir):
    return envelope.with_predicates(events(spark, sf_dir)).select(lsn(), "is_insert", "is_update", "is_delete")


@query("row_field_access", FEED_SQL + """SELECT lsn, key_id AS id, coalesce(after_status, before_status) AS status,
    coalesce(after_amount, before_amount) AS amount, true AS has_note, false AS has_other, CAST(4 AS BIGINT) AS n_fields,
    false AS is_empty, after_status IS NULL AS after_is_empty FROM f""")
def row_field_access(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("row", F.coalesce("after", "before"))
    return rows.select(
        lsn(), field("row", "id", "bigint").alias("id"), field("row", "status", "string").alias("status"),
        field("row", "amount", "double").alias("amount"),
        envelope.has_field(F.col("row"), "note").alias("has_note"),
        envelope.has_field(F.col("row"), "other").alias("has_other"),
        envelope.field_count(F.col("row")).cast("bigint").alias("n_fields"),
        envelope.is_empty_row(F.col("row")).alias("is_empty"),
        envelope.is_empty_row(F.col("after")).alias("after_is_empty"),
    )


@query("integrity_accepted", FEED_SQL + "SELECT lsn, operation, before_status IS NULL AS no_before, "
       "after_status IS NULL AS no_after FROM f")
def integrity_accepted(spark, sf_dir):
    return events(spark, sf_dir).select(
        lsn(), "operation", F.col("before").isNull().alias("no_before"), F.col("after").isNull().alias("no_after")
    )


@query("integrity_rejected", FEED_SQL + "SELECT lsn, reason FROM a "
       "WHERE reason IN ('UPDATE_WITHOUT_BEFORE', 'DELETE_WITHOUT_BEFORE')")
def integrity_rejected(spark, sf_dir):
    dead = envelope.rejected(canonical(spark, sf_dir))
    return dead.where(F.col("reject_reason").isin(*validate.INTEGRITY_REASONS)).select(
        raw_lsn(), F.col("reject_reason").alias("reason")
    )


@query("required_rejects", FEED_SQL + "SELECT lsn, reason FROM a "
       "WHERE reason IN ('UNKNOWN_OP', 'BLANK_TABLE', 'EMPTY_OFFSET')")
def required_rejects(spark, sf_dir):
    dead = envelope.rejected(canonical(spark, sf_dir))
    return dead.where(F.col("reject_reason").isin(*validate.REQUIRED_REASONS)).select(
        raw_lsn(), F.col("reject_reason").alias("reason")
    )


@query("column_exclusion", FEED_SQL + """SELECT lsn, CASE WHEN table_name = 'customers' THEN 3 ELSE 4 END::BIGINT AS n_fields,
    table_name <> 'customers' AS has_amount,
    CASE WHEN table_name <> 'customers' THEN before_amount END AS before_amount, before_status,
    CASE WHEN table_name <> 'customers' THEN after_amount END AS after_amount, after_status
    FROM f WHERE table_name <> 'audit_log'""")
def column_exclusion(spark, sf_dir):
    joined = rules.join_rules(events(spark, sf_dir), rule_table(spark, RULES_V1))
    kept = rules.exclude_columns(joined).withColumn("row", F.coalesce("after", "before"))
    return kept.select(
        lsn(), envelope.field_count(F.col("row")).cast("bigint").alias("n_fields"),
        envelope.has_field(F.col("row"), "amount").alias("has_amount"), *row_fields("before"), *row_fields("after"),
    )


@query("message_key", FEED_SQL + "SELECT lsn, fqn AS key FROM f")
def message_key(spark, sf_dir):
    return events(spark, sf_dir).select(lsn(), routing.message_key(F.col("table")).alias("key"))


@query("composite_key", FEED_SQL + """SELECT lsn, CASE WHEN table_name = 'orders' THEN '[' || key_id || ']'
    ELSE '[' || key_id || ',"' || coalesce(after_status, before_status) || '"]' END AS row_key
    FROM f WHERE table_name <> 'customers'""")
def composite_key(spark, sf_dir):
    keyed = rules.join_rules(events(spark, sf_dir), rule_table(spark, RULES_V2))
    return keyed.where(rules.valid_key_columns(F.col("key_columns"))).select(
        lsn(), rules.row_key(F.col("key_columns")).alias("row_key")
    )


@query("topic_names", """SELECT c_custkey AS cust_key,
    'cdc.' || c_mktsegment || '.' || replace(c_name, '#', '_') AS default_topic,
    c_mktsegment || '-' || CASE WHEN n_regionkey % 2 = 0 THEN replace(n_name, ' ', '_') ELSE 'public' END || '-'
      || replace(c_name, '#', '_') AS custom_topic
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def topic_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.withColumn("table", F.struct(
        F.col("c_mktsegment").alias("database"),
        F.when(F.col("n_regionkey") % 2 == 0, F.col("n_name")).alias("schema"),
        F.col("c_name").alias("table"),
    ))
    custom = F.lit("{database}-{schema}-{table}")
    return named.select(
        F.col("c_custkey").alias("cust_key"), routing.topic_name(F.col("table"), F.lit(" ")).alias("default_topic"),
        routing.topic_name(F.col("table"), custom).alias("custom_topic"),
    )


SANITIZED_SQL = r"""CASE WHEN regexp_full_match(text, '\s*') THEN 'unknown' ELSE coalesce(nullif(
    regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9._-]', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g'),
    ''), 'unknown') END"""


@query("topic_sanitize", f"SELECT conv_id, turn, {SANITIZED_SQL} AS part FROM conversations")
def topic_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", routing.sanitize_topic_part(F.col("text")).alias("part")
    )


@query("topic_validation", r"""SELECT doc_id, CASE WHEN text IS NULL OR regexp_full_match(text, '\s*') THEN 'EMPTY'
    WHEN text IN ('.', '..') THEN 'DOTS' WHEN length(text) > 249 THEN 'TOO_LONG'
    WHEN NOT regexp_full_match(text, '[a-zA-Z0-9._-]+') THEN 'BAD_CHARACTERS' END AS text_problem,
    CASE WHEN NOT regexp_full_match(source || '.' || lang, '[a-zA-Z0-9._-]+') THEN 'BAD_CHARACTERS' END AS name_problem
    FROM documents""")
def topic_validation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", routing.topic_problem(F.col("text")).alias("text_problem"),
        routing.topic_problem(F.concat_ws(".", "source", "lang")).alias("name_problem"),
    )


@query("regex_route", FEED_SQL + """SELECT lsn, CASE WHEN schema_name IS NULL THEN 'src.' || table_name
    ELSE 'cdc.src.' || table_name END AS topic FROM f""")
def regex_route(spark, sf_dir):
    raw = F.concat_ws(".", F.lit("src"), F.col("table.schema"), F.col("table.table"))
    return events(spark, sf_dir).select(
        lsn(), routing.regex_route(raw, r"([^.]+)\.([^.]+)\.([^.]+)", "cdc.$1.$3").alias("topic")
    )


@query("unwrap_state", FEED_SQL + """SELECT lsn, CASE WHEN reason IS NULL THEN key_id END AS id,
    CASE WHEN reason IS NULL THEN coalesce(after_status, before_status) END AS status,
    CASE WHEN reason IS NULL THEN coalesce(after_amount, before_amount) END AS amount,
    CASE WHEN reason IS NULL THEN CASE WHEN op = 'd' THEN 'true' ELSE 'false' END END AS deleted
    FROM a WHERE reason IS NULL OR reason = 'TOMBSTONE'""")
def unwrap_state(spark, sf_dir):
    return envelope.unwrap(canonical(spark, sf_dir)).select(
        lsn(), field("row", "id", "bigint").alias("id"), field("row", "status", "string").alias("status"),
        field("row", "amount", "double").alias("amount"), field("row", "__deleted", "string").alias("deleted"),
    )


@query("extract_after", FEED_SQL + """SELECT lsn, after_status, after_amount FROM a
    WHERE reason IS DISTINCT FROM 'TOMBSTONE'""")
def extract_after(spark, sf_dir):
    records = envelope.drop_tombstones(change_feed(spark, sf_dir)).withColumn("lsn", raw_lsn())
    return envelope.extract_field(records, "after").select("lsn", *row_fields("after"))


@query("wire_json", FEED_SQL + f"""SELECT lsn, 'cdcdb' AS database_name, schema_name, table_name, operation,
    {iso_ms_sql('ts_ms')} AS event_time, source_partition, tx_id, before_status, before_amount, after_status, after_amount,
    schema_name IS NOT NULL AS has_schema, before_status IS NOT NULL AS has_before, after_status IS NOT NULL AS has_after,
    true AS has_null_note, 'changefeed' AS source, '1.0.0' AS version FROM f""")
def wire_json(spark, sf_dir):
    text = messages(spark, sf_dir).select("value", F.explode(F.array(F.from_json("value", WIRE_TEXT))).alias("w"))
    return text.select("value", "w.*").select(
        lsn(), F.col("table.database").alias("database_name"), F.col("table.schema").alias("schema_name"),
        F.col("table.table").alias("table_name"), "operation", F.col("timestamp").alias("event_time"),
        F.col("position.sourcePartition").alias("source_partition"),
        F.try_variant_get("position.offset", "$.txId", "bigint").alias("tx_id"),
        *row_fields("before"), *row_fields("after"),
        F.col("value").contains('"schema":').alias("has_schema"),
        F.col("value").contains('"before":').alias("has_before"),
        F.col("value").contains('"after":').alias("has_after"),
        F.col("value").contains('"note":null').alias("has_null_note"),
        F.col("metadata.source").alias("source"), F.col("metadata.version").alias("version"),
    )


@query("wire_contract_check", FEED_SQL + """SELECT rule, CASE WHEN rule = 'connector_enum' THEN (SELECT count(*) FROM f)
    ELSE 0 END AS violations FROM (SELECT unnest(['not_json', 'required', 'table', 'operation_enum', 'timestamp_format',
    'position', 'metadata_required', 'version_pattern', 'connector_enum', 'schema_version', 'images']) AS rule)""")
def wire_contract_check(spark, sf_dir):
    return wire.validate_wire(messages(spark, sf_dir))


@query("changed_columns", FEED_SQL + """SELECT lsn, 'status' AS "column", '"' || before_status || '"' AS old_value,
    '"' || after_status || '"' AS new_value, CAST(NULL AS DOUBLE) AS old_number, CAST(NULL AS DOUBLE) AS new_number
    FROM f WHERE operation = 'UPDATE' AND before_status <> after_status
    UNION ALL SELECT lsn, 'amount', NULL, NULL, before_amount, after_amount
    FROM f WHERE operation = 'UPDATE' AND before_amount <> after_amount""")
def changed_columns(spark, sf_dir):
    changed = state.changed_columns(events(spark, sf_dir))
    numeric = F.col("column") == "amount"
    return changed.select(
        lsn(), "column",
        F.when(~numeric, F.col("old_value")).alias("old_value"), F.when(~numeric, F.col("new_value")).alias("new_value"),
        F.when(numeric, F.col("old_value").try_cast("double")).alias("old_number"),
        F.when(numeric, F.col("new_value").try_cast("double")).alias("new_number"),
    )


@query("split_qualified_name", FEED_SQL + """SELECT lsn, CASE lsn % 4 WHEN 0 THEN table_name WHEN 1 THEN 'sales.' || table_name
    WHEN 2 THEN fqn || '.x.y' ELSE table_name END AS name,
    CASE WHEN lsn % 4 = 2 THEN NULL WHEN lsn % 4 = 1 AND key_id % 2 = 0 THEN 'sales' ELSE 'cdcdb' END AS database_name,
    CASE WHEN lsn % 4 = 2 OR key_id % 2 = 0 THEN NULL WHEN lsn % 4 = 1 THEN 'sales' ELSE 'public' END AS schema_name,
    CASE WHEN lsn % 4 = 2 THEN NULL ELSE table_name END AS table_name FROM f""")
def split_qualified_name(spark, sf_dir):
    e = events(spark, sf_dir).select(lsn(), "fqn", F.col("table.table").alias("t"),
                                     field("after", "id", "bigint").alias("a"), field("before", "id", "bigint").alias("b"))
    kind = F.col("lsn") % 4
    named = e.select(
        "lsn",
        F.when(kind == 1, F.concat(F.lit("sales."), "t")).when(kind == 2, F.concat("fqn", F.lit(".x.y")))
        .otherwise(F.col("t")).alias("name"),
        F.when(F.coalesce("a", "b") % 2 == 0, "MYSQL").otherwise("POSTGRESQL").alias("database_type"),
    )
    split = rules.split_qualified_name(F.col("name"), F.col("database_type"), F.lit("cdcdb"))
    return named.select("lsn", "name", split.alias("s")).select(
        "lsn", "name", F.col("s.database").alias("database_name"), F.col("s.schema").alias("schema_name"),
        F.col("s.table").alias("table_name"),
    )


@query("valid_identifier", r"""SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS name,
    regexp_full_match(regexp_extract(url, '://([^/]*)', 1), '[a-zA-Z0-9_]+(\.[a-zA-Z0-9_]+){0,2}') AS host_valid,
    regexp_full_match(url, '[a-zA-Z0-9_]+(\.[a-zA-Z0-9_]+){0,2}') AS url_valid FROM pages""")
def valid_identifier(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/]*)", 1)
    database = F.substring_index(host, ".", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", host.alias("name"), validate.valid_identifier(host, database).alias("host_valid"),
        validate.valid_identifier(F.col("url"), F.col("url")).alias("url_valid"),
    )


@query("rules_join", FEED_SQL + """SELECT lsn, fqn, CASE WHEN table_name = 'orders' THEN 'EXCLUDE_SPECIFIED'
    ELSE 'INCLUDE_ALL' END AS include_mode, CASE WHEN table_name = 'orders' THEN 'cdc.cdcdb.orders'
    ELSE 'cdcdb-changes-audit_log' END AS topic FROM f WHERE table_name <> 'customers'""")
def rules_join(spark, sf_dir):
    joined = rules.join_rules(events(spark, sf_dir), rule_table(spark, RULES_V2))
    return routing.route(joined).select(lsn(), "fqn", "include_mode", "topic")


@query("kafka_feed_identity", FEED_SQL + """SELECT lsn, operation, '{topic=changes.' || table_name || ', partition=' || (key_id % 4) || '}' AS source_partition,
    lsn AS place, '{"id":' || key_id || '}' AS record_key, lsn > max(lsn) FILTER (lsn % 10 < 7) OVER (PARTITION BY table_name, key_id % 4) AS is_later
    FROM a WHERE reason IS NULL OR reason = 'EMPTY_OFFSET'""")
def kafka_feed_identity(spark, sf_dir):
    """The feed as rows of the Kafka source: topic, partition and offset are identity and position, the key is kept; later are events after those of seven
    in ten that were read before. A record without a place of its own has one in Kafka."""
    changes = row_changes(spark, sf_dir)
    packed = pack(changes.select("*")).withColumn("lsn", raw_lsn())
    keyed = changes.select("lsn", F.to_json(F.struct(F.col("key_id").alias("id"))).cast("binary").alias("key"), "table_name", (F.col("key_id") % 4).cast("int").alias("partition"))
    rows = packed.join(keyed, "lsn").select(
        "key", F.col("value").cast("binary").alias("value"), F.concat(F.lit("changes."), "table_name").alias("topic"), "partition", F.col("lsn").alias("offset"),
        F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    decoded = envelope.to_canonical(changelog.from_kafka(rows)).where(F.col("reject_reason").isNull())
    read = positions.latest_positions(decoded.where("position.log_key % 10 < 7"))
    later = positions.is_after(F.col("position"), F.col("saved"))
    return positions.with_saved_position(decoded, read).select(
        F.col("position.log_key").alias("lsn"), "operation", "position.source_partition", F.try_variant_get("position.offset", "$.offset", "bigint").alias("place"),
        "record_key", later.alias("is_later"),
    )
