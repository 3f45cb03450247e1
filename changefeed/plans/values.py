"""Queries on value normalization, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from changefeed.functions import instants, normalize, numbers, text
from changefeed.functions.normalize import normalize_frame
from changefeed.plans.feed import iso_ms_sql, iso_us_sql, table
from changefeed.plans.registry import query


@query("iso_timestamps", f"""SELECT 'orders' AS source, o_orderkey AS k1, CAST(0 AS BIGINT) AS k2, {iso_us_sql('o_orderdate')} AS iso,
    strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS iso_day FROM orders
    UNION ALL SELECT 'lineitem', l_orderkey, CAST(l_linenumber AS BIGINT), {iso_us_sql('l_shipdate')},
    strftime(l_shipdate, '%Y-%m-%dT00:00:00Z') FROM lineitem
    UNION ALL SELECT 'events', event_id, 0, {iso_us_sql('ts')}, strftime(ts, '%Y-%m-%dT00:00:00Z') FROM events""")
def iso_timestamps(spark, sf_dir):
    def rows(source, k1, k2, at):
        return table(spark, sf_dir, source).select(
            F.lit(source).alias("source"), F.col(k1).alias("k1"), k2.cast("bigint").alias("k2"),
            instants.iso_instant(F.col(at)).alias("iso"),
            instants.iso_instant(F.col(at).cast("date")).alias("iso_day"),
        )

    return (
        rows("orders", "o_orderkey", F.lit(0), "o_orderdate")
        .unionByName(rows("lineitem", "l_orderkey", F.col("l_linenumber"), "l_shipdate"))
        .unionByName(rows("events", "event_id", F.lit(0), "ts"))
    )


@query("epoch_to_iso", f"""SELECT event_id, {iso_ms_sql('epoch_us(ts) // 1000')} AS from_ms, {iso_us_sql('ts')} AS from_us,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS from_s, strftime(ts, '%Y-%m-%dT00:00:00Z') AS from_days,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || '007Z' AS from_ns FROM events""")
def epoch_to_iso(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    micros = F.unix_micros(at)
    return table(spark, sf_dir, "events").select(
        "event_id",
        instants.epoch_to_iso(F.unix_millis(at), "ms").alias("from_ms"),
        instants.epoch_to_iso(micros, "us").alias("from_us"),
        instants.epoch_to_iso(F.unix_seconds(at), "s").alias("from_s"),
        instants.epoch_to_iso(F.unix_date(F.col("ts").cast("date")), "days").alias("from_days"),
        instants.epoch_to_iso(micros * 1000 + 7, "ns").alias("from_ns"),
    )


# Eight ways to write the time of an event, by event number; one is no time at all.
_WAYS_SQL = """CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S+02:00')
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%Y-%m-%d') WHEN 5 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
    WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') || 'Z'
    ELSE event_type END"""
_PARSED_SQL = f"""CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z') WHEN 5 THEN {iso_ms_sql('epoch_us(ts) // 1000')}
    WHEN 6 THEN {iso_us_sql('ts')} END"""


def _written():
    """The event's time in its way of writing."""
    at = F.col("ts").cast("timestamp")

    def fmt(pattern, when=at):
        return F.date_format(when, pattern)

    way = F.col("event_id") % 8
    return (
        F.when(way == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(way == 1, fmt("yyyy-MM-dd'T'HH:mm:ss'+02:00'", at + F.expr("INTERVAL 2 HOURS")))
        .when(way == 2, fmt("yyyy-MM-dd'T'HH:mm"))
        .when(way == 3, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(way == 4, fmt("yyyy-MM-dd"))
        .when(way == 5, F.unix_millis(at).cast("string"))
        .when(way == 6, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .otherwise(F.col("event_type"))
    )


@query("parse_time_strings", f"""SELECT event_id, {_WAYS_SQL} AS written, coalesce({_PARSED_SQL}, {_WAYS_SQL}) AS older,
    CASE event_id % 8 WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE coalesce({_PARSED_SQL}, {_WAYS_SQL}) END AS typed FROM events""")
def parse_time_strings(spark, sf_dir):
    written = F.col("written")
    return table(spark, sf_dir, "events").withColumn("written", _written()).select(
        "event_id", "written",
        F.coalesce(instants.parse_time_string(written), written).alias("older"),
        F.coalesce(instants.parse_time_string(written, spaced=True, any_integer=False), written).alias("typed"),
    )


@query("looks_like_time", r"""SELECT 'documents' AS source, doc_id AS k1, CAST(0 AS BIGINT) AS k2, contains(text, 'T') OR (contains(text, '-') AND contains(text, ':'))
      OR regexp_full_match(text, '\d{10,13}') AS flag FROM documents
    UNION ALL SELECT 'conversations', conv_id, turn, contains(text, 'T') OR (contains(text, '-') AND contains(text, ':'))
      OR regexp_full_match(text, '\d{10,13}') FROM conversations
    UNION ALL SELECT 'events', event_id, 0, contains(props, 'T') OR (contains(props, '-') AND contains(props, ':'))
      OR regexp_full_match(props, '\d{10,13}') FROM events""")
def looks_like_time(spark, sf_dir):
    def rows(source, k1, k2, column):
        return table(spark, sf_dir, source).select(
            F.lit(source).alias("source"), F.col(k1).alias("k1"), k2.cast("bigint").alias("k2"),
            instants.looks_like_time(F.col(column)).alias("flag"),
        )

    return (
        rows("documents", "doc_id", F.lit(0), "text")
        .unionByName(rows("conversations", "conv_id", F.col("turn"), "text"))
        .unionByName(rows("events", "event_id", F.lit(0), "props"))
    )


@query("time_name_flags", r"""SELECT event_id, name, regexp_matches(lower(name), 'time|date|timestamp|_at$|_on$|^(created|updated|modified)$') AS flag
    FROM (SELECT event_id, CASE user_id % 7 WHEN 0 THEN event_type || '_at' WHEN 1 THEN upper(event_type) || '_ON' WHEN 2 THEN event_type || '_count'
      WHEN 3 THEN 'update_' || event_type WHEN 4 THEN 'lifetime' WHEN 5 THEN 'created' ELSE event_type END AS name FROM events)""")
def time_name_flags(spark, sf_dir):
    kind, event = F.col("user_id") % 7, F.col("event_type")
    name = (
        F.when(kind == 0, F.concat(event, F.lit("_at")))
        .when(kind == 1, F.concat(F.upper(event), F.lit("_ON")))
        .when(kind == 2, F.concat(event, F.lit("_count")))
        .when(kind == 3, F.concat(F.lit("update_"), event))
        .when(kind == 4, F.lit("lifetime"))
        .when(kind == 5, F.lit("created"))
        .otherwise(event)
    )
    return table(spark, sf_dir, "events").select(
        "event_id", name.alias("name"), instants.is_time_name(name).alias("flag")
    )


def _kind_columns(kind, value, prefix):
    """The four columns a mixed value shows: its kind and its value in the column of that kind."""
    return [
        kind.alias(f"{prefix}_kind"),
        F.when(kind == "long", F.try_variant_get(value, "$", "bigint")).alias(f"{prefix}_long"),
        F.when(kind == "double", F.try_variant_get(value, "$", "double")).alias(f"{prefix}_double"),
        F.when(kind == "string", F.try_variant_get(value, "$", "string")).alias(f"{prefix}_text"),
    ]


def _kind_sql(value: str, scale: int, prefix: str) -> str:
    kind = f"""CASE WHEN {value} % 1 = 0 AND abs({value}) <= 9007199254740991 THEN 'long'
      WHEN TRY_CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,{scale})) = {value} THEN 'double' ELSE 'string' END"""
    return f"""{kind} AS {prefix}_kind, CASE WHEN {kind} = 'long' THEN TRY_CAST({value} AS BIGINT) END AS {prefix}_long,
      CASE WHEN {kind} = 'double' THEN CAST({value} AS DOUBLE) END AS {prefix}_double,
      CASE WHEN {kind} = 'string' THEN CAST({value} AS VARCHAR) END AS {prefix}_text"""


@query("normalize_decimals", f"""SELECT order_key, {_kind_sql('total', 2, 'total')}, {_kind_sql('whole', 2, 'whole')}, {_kind_sql('exact', 18, 'exact')}
    FROM (SELECT o_orderkey AS order_key, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(floor(o_totalprice) AS DECIMAL(18,2)) AS whole,
      CAST(CAST(o_orderkey AS VARCHAR) || '.123456789012345678' AS DECIMAL(38,18)) AS exact FROM orders)""")
def normalize_decimals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.floor("o_totalprice").cast("decimal(18,2)").alias("whole"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".123456789012345678")).cast("decimal(38,18)").alias("exact"),
    )
    scales = {"total": 2, "whole": 2, "exact": 18}
    # the shown columns use each result several times: compute it once, in a generator
    results = F.struct(
        *[numbers.decimal_kind(F.col(name), scale).alias(f"{name}_k") for name, scale in scales.items()],
        *[numbers.normalize_decimal(F.col(name), scale).alias(name) for name, scale in scales.items()],
    )
    done = rows.select("order_key", F.explode(F.array(results)).alias("r"))
    return done.select(
        "order_key", *[c for n in scales for c in _kind_columns(F.col(f"r.{n}_k"), F.col(f"r.{n}"), n)]
    )


@query("normalize_bigints", """SELECT order_key, CASE WHEN abs(big) <= 9007199254740991 THEN 'long' ELSE 'string' END AS big_kind,
    CASE WHEN abs(big) <= 9007199254740991 THEN CAST(big AS BIGINT) END AS big_long, CAST(NULL AS DOUBLE) AS big_double,
    CASE WHEN abs(big) > 9007199254740991 THEN CAST(big AS VARCHAR) END AS big_text
    FROM (SELECT o_orderkey AS order_key, CAST(o_orderkey AS HUGEINT) * CASE WHEN o_orderkey % 2 = 0 THEN 9007199254740993 ELSE -3 END AS big FROM orders)""")
def normalize_bigints(spark, sf_dir):
    factor = F.when(F.col("o_orderkey") % 2 == 0, F.lit(9007199254740993)).otherwise(F.lit(-3)).cast("decimal(16,0)")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), (F.col("o_orderkey").cast("decimal(20,0)") * factor).alias("big")
    )
    big = F.col("big")
    return rows.select("order_key", *_kind_columns(numbers.biginteger_kind(big), numbers.normalize_biginteger(big), "big"))


_RATIO_SQL = """CASE event_type WHEN 'error' THEN 'NaN'::DOUBLE WHEN 'signup' THEN 'Infinity'::DOUBLE
    WHEN 'view' THEN '-Infinity'::DOUBLE ELSE value END"""


def _ratio():
    event = F.col("event_type")
    return (
        F.when(event == "error", float("nan")).when(event == "signup", float("inf"))
        .when(event == "view", float("-inf")).otherwise(F.col("value"))
    )


@query("normalize_floats", """SELECT event_id, event_type IN ('error', 'signup', 'view') AS is_special,
    CASE event_type WHEN 'error' THEN 'NaN' WHEN 'signup' THEN 'Infinity' WHEN 'view' THEN '-Infinity' END AS ratio_text,
    CASE WHEN event_type NOT IN ('error', 'signup', 'view') THEN value END AS ratio_double FROM events""")
def normalize_floats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", _ratio().alias("ratio"))
    special, value = numbers.is_special_float(F.col("ratio")), numbers.normalize_float(F.col("ratio"))
    return rows.select(
        "event_id", special.alias("is_special"),
        F.when(special, F.try_variant_get(value, "$", "string")).alias("ratio_text"),
        F.when(~special, F.try_variant_get(value, "$", "double")).alias("ratio_double"),
    )


_NUMBER_SQL = r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,10})?'"


@query("looks_like_number", f"""SELECT event_id, regexp_full_match(CAST(value AS VARCHAR), {_NUMBER_SQL}) AS value_flag,
    regexp_full_match(props, {_NUMBER_SQL}) AS props_flag, regexp_full_match(event_type, {_NUMBER_SQL}) AS type_flag,
    regexp_full_match('-.' || event_id || 'E+' || user_id, {_NUMBER_SQL}) AS made_flag,
    regexp_full_match(event_id || '.', {_NUMBER_SQL}) AS dot_flag, regexp_full_match(' ' || event_id, {_NUMBER_SQL}) AS space_flag
    FROM events""")
def looks_like_number(spark, sf_dir):
    event_id = F.col("event_id").cast("string")
    made = F.concat(F.lit("-."), event_id, F.lit("E+"), F.col("user_id").cast("string"))
    inputs = {
        "value": F.col("value").cast("string"), "props": F.col("props"), "type": F.col("event_type"), "made": made,
        "dot": F.concat(event_id, F.lit(".")), "space": F.concat(F.lit(" "), event_id),
    }
    return table(spark, sf_dir, "events").select(
        "event_id", *[numbers.looks_like_number(c).alias(f"{name}_flag") for name, c in inputs.items()]
    )


@query("valid_utf8", """SELECT 'documents' AS source, doc_id AS k1, CAST(0 AS BIGINT) AS k2, md5(text) AS digest, length(text) AS n_chars FROM documents
    UNION ALL SELECT 'conversations', conv_id, turn, md5(text), length(text) FROM conversations""")
def valid_utf8(spark, sf_dir):
    def rows(source, k1, k2):
        valid = text.valid_utf8(F.col("text"))
        return table(spark, sf_dir, source).select(
            F.lit(source).alias("source"), F.col(k1).alias("k1"), k2.cast("bigint").alias("k2"),
            F.md5(valid.cast("binary")).alias("digest"), F.length(valid).cast("bigint").alias("n_chars"),
        )

    return rows("documents", "doc_id", F.lit(0)).unionByName(rows("conversations", "conv_id", F.col("turn")))


@query("decode_bytes", """SELECT doc_id, md5(text) AS digest, md5('a' || chr(65533) || text || chr(65533) || 'b' || chr(65533)) AS mended FROM documents""")
def decode_bytes(spark, sf_dir):
    """Each text as bytes, as it is and with bytes around it that are not UTF-8."""
    raw = F.col("text").cast("binary")
    broken = F.concat(F.unhex(F.lit("61FF")), raw, F.unhex(F.lit("FE62E282")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.decode_bytes(raw).cast("binary")).alias("digest"),
        F.md5(text.decode_bytes(broken).cast("binary")).alias("mended"),
    )


def _typed_row(spark, sf_dir):
    """A row with a column of each type, from ``events``."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").withColumn("written", _written()).select(
        "event_id",
        F.col("ts").alias("seen"),
        at.cast("date").alias("day"),
        F.unix_millis(at).alias("changed_ms"),
        (F.col("user_id") % 100).cast("int").alias("update_count"),
        F.col("user_id").cast("int").alias("small"),
        F.col("value").cast("decimal(18,2)").alias("total"),
        F.col("value").cast("decimal(18,2)").alias("total_time"),
        _ratio().alias("ratio"),
        (F.col("user_id") % 2 == 0).alias("active"),
        (F.col("user_id") % 2 == 0).alias("is_updated"),
        F.col("written").alias("created_at"),
        F.col("written").alias("phone"),
        F.col("event_type").cast("binary").alias("raw"),
    )


def _flat(rows):
    """Mixed columns in columns of one type each."""
    return rows.withColumns(
        {
            "total": F.try_variant_get("total", "$", "double"),
            "ratio_text": F.when(F.schema_of_variant("ratio") == "STRING", F.try_variant_get("ratio", "$", "string")),
            "ratio": F.when(F.schema_of_variant("ratio") != "STRING", F.try_variant_get("ratio", "$", "double")),
        }
    )


_ROW_SQL = f"""SELECT event_id, {iso_us_sql('ts')} AS seen, strftime(ts, '%Y-%m-%dT00:00:00Z') AS day, CAST(user_id AS INTEGER) AS small,
    CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS total, user_id % 2 = 0 AS active, event_type AS raw,
    CASE WHEN event_type IN ('error', 'signup', 'view') THEN NULL ELSE value END AS ratio,
    CASE event_type WHEN 'error' THEN 'NaN' WHEN 'signup' THEN 'Infinity' WHEN 'view' THEN '-Infinity' END AS ratio_text, """


@query("normalize_row_typed", _ROW_SQL + f"""{iso_ms_sql('epoch_us(ts) // 1000')} AS changed_ms, CAST(user_id % 100 AS INTEGER) AS update_count,
    CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS total_time, user_id % 2 = 0 AS is_updated,
    CASE event_id % 8 WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE coalesce({_PARSED_SQL}, {_WAYS_SQL}) END AS created_at,
    {_WAYS_SQL} AS phone FROM events""")
def normalize_row_typed(spark, sf_dir):
    rows = normalize_frame(_typed_row(spark, sf_dir), "typed", {"changed_ms": "ms"}, keep=("event_id",))
    return _flat(rows).withColumn("total_time", F.try_variant_get("total_time", "$", "double"))


@query("normalize_row_compat", _ROW_SQL + f"""{iso_ms_sql('epoch_us(ts) // 1000')} AS changed_ms, CAST(user_id % 100 AS VARCHAR) AS update_count,
    CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS total_time, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_updated,
    coalesce({_PARSED_SQL}, {_WAYS_SQL}) AS created_at, coalesce({_PARSED_SQL}, {_WAYS_SQL}) AS phone FROM events""")
def normalize_row_compat(spark, sf_dir):
    return _flat(normalize_frame(_typed_row(spark, sf_dir), "compat", keep=("event_id",)))


def _image_columns(image):
    """The fields of a normalized image of ``_typed_row`` as columns."""
    kinds = {
        "seen": "string", "day": "string", "changed_ms": "string", "update_count": "string", "small": "int", "total": "double", "total_time": "string",
        "active": "boolean", "is_updated": "string", "created_at": "string", "phone": "string", "raw": "string",
    }
    special = F.schema_of_variant(F.try_variant_get(image, "$.ratio", "variant")) == "STRING"
    return [F.try_variant_get(image, f"$.{name}", kind).alias(name) for name, kind in kinds.items()] + [
        F.when(special, F.try_variant_get(image, "$.ratio", "string")).alias("ratio_text"),
        F.when(~special, F.try_variant_get(image, "$.ratio", "double")).alias("ratio"),
    ]


def _normalized_images(spark, sf_dir, *args, **options):
    rows = _typed_row(spark, sf_dir)
    packed = rows.select("event_id", F.to_variant_object(F.struct(*[c for c in rows.columns if c != "event_id"])).alias("image"))
    done = packed.select("event_id", F.explode(F.array(normalize.normalize_image(F.col("image"), *args, **options))).alias("image"))
    return done.select("event_id", *_image_columns(F.col("image")))


# the text of an image's decimal has no zeros at its end
_TRIMMED_SQL = "regexp_replace(regexp_replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '[.]$', '')"


@query("normalize_image_typed", _ROW_SQL + f"""{iso_ms_sql('epoch_us(ts) // 1000')} AS changed_ms, CAST(user_id % 100 AS VARCHAR) AS update_count,
    CASE WHEN CAST(value AS DECIMAL(18,2)) = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
      ELSE {_TRIMMED_SQL} END AS total_time, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_updated,
    CASE event_id % 8 WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE coalesce({_PARSED_SQL}, {_WAYS_SQL}) END AS created_at,
    {_WAYS_SQL} AS phone FROM events""")
def normalize_image_typed(spark, sf_dir):
    """The rows of ``normalize_row_typed`` as VARIANT images; every value goes by its own kind."""
    return _normalized_images(spark, sf_dir, {"changed_ms": "ms"})


@query("normalize_image_compat", _ROW_SQL + f"""{iso_ms_sql('epoch_us(ts) // 1000')} AS changed_ms, CAST(user_id % 100 AS VARCHAR) AS update_count,
    {_TRIMMED_SQL} AS total_time, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_updated,
    coalesce({_PARSED_SQL}, {_WAYS_SQL}) AS created_at, coalesce({_PARSED_SQL}, {_WAYS_SQL}) AS phone FROM events""")
def normalize_image_compat(spark, sf_dir):
    """The same under the older guesses: whole numbers are times unless they are declared narrower, time-like names make text."""
    return _normalized_images(spark, sf_dir, mode="compat", types={"small": "int", "update_count": "int"})
