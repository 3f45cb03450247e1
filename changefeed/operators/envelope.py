"""Change-log envelopes to canonical change events.

Input: ``value`` (envelope as JSON text, NULL for a tombstone) and, where the source has them,
``source_partition`` (text) and ``source_offset`` (JSON object text). Without the latter two they are
taken from the envelope's ``source`` block.

The envelope is parsed once, inside a generator: Catalyst copies a plain parsing expression into
every filter it pushes down, but does not push filters through a generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.operators import validate

SOURCE_SCHEMA = (
    # places in the log are numbers for some sources and text for others: none makes a record malformed
    "STRUCT<version: STRING, connector: STRING, name: STRING, ts_ms: BIGINT, db: STRING, `schema`: STRING, "
    "`table`: STRING, lsn: STRING, txId: STRING, sequence: STRING, file: STRING, pos: STRING, `row`: STRING, "
    "server_id: STRING, gtid: STRING, scn: STRING, commit_scn: STRING, change_lsn: STRING, commit_lsn: STRING, "
    "event_serial_no: STRING>"
)
ENVELOPE_SCHEMA = (
    f"before VARIANT, after VARIANT, source {SOURCE_SCHEMA}, op STRING, ts_ms BIGINT, _malformed STRING"
)

CANONICAL_COLUMNS = (
    "event_id", "table", "fqn", "operation", "timestamp", "position", "before", "after", "metadata", "source_ts",
)

# Envelope operation codes.
OPERATIONS = {"c": "INSERT", "r": "INSERT", "u": "UPDATE", "d": "DELETE"}

OBJECT = "struct<_:variant>"


def _envelope(value: str) -> Column:
    return F.from_json(value, ENVELOPE_SCHEMA, {"columnNameOfCorruptRecord": "_malformed"})


def parse_envelopes(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``envelope``; NULL for a tombstone, ``envelope._malformed`` set where the text does not fit."""
    return df.select("*", F.explode(F.array(_envelope(value))).alias("envelope"))


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull())


def decode_operation(op: Column) -> Column:
    """Operation name of a code; NULL for an unknown code."""
    decoded = F.lit(None).cast("string")
    for code, name in OPERATIONS.items():
        decoded = F.when(op == code, F.lit(name)).otherwise(decoded)
    return decoded


def event_time(ts_ms: Column, source_ts_ms: Column | None = None) -> Column:
    """Envelope time, else source time, else now. Pass no source time for the older behaviour."""
    millis = ts_ms if source_ts_ms is None else F.coalesce(ts_ms, source_ts_ms)
    return F.coalesce(instant(millis), F.current_timestamp())


def in_range(millis: Column) -> Column:
    """Whether a time in milliseconds can be a timestamp; a NULL can."""
    return F.coalesce(millis.between(-9223372036854775, 9223372036854775), F.lit(True))


def instant(millis: Column) -> Column:
    """Timestamp of a time in milliseconds; NULL beyond the range of timestamps."""
    return F.timestamp_millis(F.when(in_range(millis), millis))


# entries of the source block that tell where in the log a change is: numbers where they are whole numbers, else text
PLACE_NUMBERS = ("lsn", "txId", "pos", "row", "server_id", "scn", "commit_scn", "event_serial_no", "ts_ms")
PLACE_TEXTS = ("sequence", "file", "gtid", "change_lsn", "commit_lsn")


def log_number(text: Column) -> Column:
    """A log place as a number: decimal digits, or two hexadecimal halves as in 0/16B3748."""
    halves = F.split(text, "/")
    joined = F.lpad(F.get(halves, F.lit(0)), 8, "0"), F.lpad(F.get(halves, F.lit(1)), 8, "0")
    hexadecimal = F.when(text.rlike(r"\A[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\z"), F.conv(F.concat(*joined), 16, 10))
    return F.coalesce(text.try_cast("bigint"), hexadecimal.try_cast("bigint"))


def source_place(source: Column) -> Column:
    """Offset, as JSON text, of an envelope that comes without one: all that its source block says about the place."""
    numbers = [log_number(source[n].cast("string")).alias(n) for n in PLACE_NUMBERS]
    return F.to_json(F.struct(*numbers, *[source[n].alias(n) for n in PLACE_TEXTS]))


def qualified_name(database: Column, schema: Column, table: Column) -> Column:
    """``database.schema.table``, or ``database.table`` for a NULL or blank schema."""
    return F.concat_ws(".", database, F.when(F.trim(schema) != "", schema), table)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT).isNotNull()


def row_image(value: Column) -> Column:
    """The image if it is a JSON object, else SQL NULL (also for JSON null)."""
    return F.when(is_object(value), value)


def image_fields(image: Column) -> Column:
    return image.try_cast("map<string,variant>")


# Entries of an offset that order positions. JSON text is not taken for a time or a sequence here; a place in the log may be written as text.
KEY_SCHEMA = (
    "`timestamp` BIGINT, ts_ms BIGINT, sequence BIGINT, event BIGINT, file STRING, lsn STRING, pos STRING, scn STRING, "
    "change_lsn STRING, commit_lsn STRING, event_serial_no BIGINT, `offset` BIGINT"
)


def offset_entries(offset: Column) -> Column:
    """Entries of an offset given as JSON text, without null ones; no entries when it is not an object."""
    entries = F.coalesce(F.from_json(offset, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.map_filter(entries, lambda _, v: v.isNotNull() & ~F.is_variant_null(v))


def offset_keys(offset: Column) -> Column:
    return F.from_json(offset, KEY_SCHEMA)


def position_struct(partition: Column, entries: Column, keys: Column) -> Column:
    """Position with the keys that order it (see ``positions.sort_key``)."""
    places = [keys[k] for k in ("lsn", "pos", "scn")]
    # a place that is no number, or too large a one, orders as text
    texts = [F.when(p.try_cast("bigint").isNull(), p) for p in places]
    return F.struct(
        F.coalesce(partition, F.lit("unknown")).alias("source_partition"),
        F.to_variant_object(entries).alias("offset"),
        F.coalesce(keys["timestamp"], keys["ts_ms"]).alias("ts_key"),
        F.coalesce(keys["sequence"], keys["event"]).alias("seq_key"),
        F.coalesce(keys["file"], F.nullif(F.concat_ws("/", keys["commit_lsn"], keys["change_lsn"]), F.lit("")), *texts).alias("log_file"),
        F.coalesce(*(p.try_cast("bigint") for p in places), keys["event_serial_no"], keys["offset"]).alias("log_key"),
    )


def metadata_struct(connector: Column, app_name: str, version: str, schema_version: int = 1) -> Column:
    return F.struct(
        F.lit(app_name).alias("source"),
        F.lit(version).alias("version"),
        F.coalesce(connector, F.lit("unknown")).alias("connector"),
        F.lit(schema_version).alias("schemaVersion"),
    )


def _parsed(df: DataFrame) -> DataFrame:
    """Add ``envelope``, ``_partition``, ``_offset`` (JSON text), ``_entries`` and ``_keys``, each computed once."""
    if "source_offset" in df.columns:
        parsed, offset = parse_envelopes(df), F.col("source_offset")
    else:
        parsed = parse_envelopes(df)
        offset = source_place(F.col("envelope.source"))
    if "source_partition" in df.columns:
        partition = F.col("source_partition")
    else:
        partition = F.concat(F.lit("{server="), F.col("envelope.source.name"), F.lit("}"))
    parts = F.struct(
        partition.alias("partition"),
        offset.alias("offset"),
        offset_entries(offset).alias("entries"),
        offset_keys(offset).alias("keys"),
    )
    return parsed.select("*", F.explode(F.array(parts)).alias("_at"))


def to_canonical(
    df: DataFrame,
    app_name: str = "changefeed",
    version: str = "1.0.0",
    mode: str = "typed",
    check_identifiers: bool = False,
) -> DataFrame:
    """Every record as a canonical event plus ``reject_reason`` (NULL when the event is sound).

    One projection over one parse, no shuffle. The input columns are kept, so a rejected record can be
    stored as it came. See ``accepted`` and ``rejected``.
    """
    if mode not in ("typed", "compat"):
        raise ValueError(f"mode is typed or compat, not {mode!r}")
    parsed = _parsed(df)
    envelope, source = F.col("envelope"), F.col("envelope.source")
    at = F.col("_at")
    staged = parsed.select(
        *df.columns,
        "envelope",
        F.struct(
            source["db"].alias("database"), source["schema"].alias("schema"), source["table"].alias("table")
        ).alias("table"),
        qualified_name(source["db"], source["schema"], source["table"]).alias("fqn"),
        decode_operation(envelope["op"]).alias("operation"),
        # a record that is no envelope, or that has an impossible time, has no time of its own
        F.when(
            envelope.isNotNull() & envelope["_malformed"].isNull() & in_range(envelope["ts_ms"]) & in_range(source["ts_ms"]),
            event_time(envelope["ts_ms"], source["ts_ms"] if mode == "typed" else None),
        ).alias("timestamp"),
        position_struct(at["partition"], at["entries"], at["keys"]).alias("position"),
        at["offset"].alias("_offset"),
        F.size(at["entries"]).alias("_offset_size"),
        row_image(envelope["before"]).alias("before"),
        row_image(envelope["after"]).alias("after"),
        metadata_struct(source["connector"], app_name, version).alias("metadata"),
        instant(source["ts_ms"]).alias("source_ts"),
    )
    judged = staged.withColumn("reject_reason", validate.reject_reason(check_identifiers))
    # a rejected record may lack a position or a name: its own text then tells it from others
    # so does an event whose place is taken from its source block, which need not be unique
    raw = F.col("value")
    if "source_offset" in df.columns:
        raw = F.when(F.col("reject_reason").isNotNull(), raw)
    event_id = F.sha2(
        F.concat_ws(
            "|",
            F.col("position.source_partition"),
            F.col("_offset"),
            F.col("fqn"),
            F.col("operation"),
            raw,
        ),
        256,
    )
    return judged.select(*df.columns, event_id.alias("event_id"), *CANONICAL_COLUMNS[1:], "reject_reason")


def accepted(canonical: DataFrame) -> DataFrame:
    return canonical.where(F.col("reject_reason").isNull()).select(*CANONICAL_COLUMNS)


def rejected(canonical: DataFrame) -> DataFrame:
    """Dead letters: the record as it came and why. A tombstone is skipped, not rejected."""
    kept = [c for c in canonical.columns if c not in CANONICAL_COLUMNS]
    return canonical.where(F.col("reject_reason") != validate.TOMBSTONE).select(*kept)


def extract_field(df: DataFrame, field: str, value: str = "value") -> DataFrame:
    """Keep one field of each envelope, as VARIANT, next to the other input columns."""
    others = [c for c in df.columns if c != value]
    return df.select(*others, F.try_variant_get(F.try_parse_json(value), f"$.{field}", "variant").alias(field))


def with_predicates(events: DataFrame) -> DataFrame:
    """Add is_insert, is_update, is_delete."""
    return events.withColumns(
        {f"is_{name.lower()}": F.col("operation") == name for name in ("INSERT", "UPDATE", "DELETE")}
    )


def get_field(image: Column, name: str, data_type: str = "variant") -> Column:
    """A field of a row image, NULL when absent or of another type."""
    return F.try_variant_get(image, f"$['{name}']", data_type)


def has_field(image: Column, name: str) -> Column:
    """True also for a field that is there with a null value."""
    return F.coalesce(F.map_contains_key(image_fields(image), name), F.lit(False))


def field_count(image: Column) -> Column:
    return F.coalesce(F.size(F.map_keys(image_fields(image))), F.lit(0))


def is_empty_row(image: Column) -> Column:
    return field_count(image) == 0


def unwrap(canonical: DataFrame) -> DataFrame:
    """Flat new-row state: the after image, or for a delete the old row with ``__deleted`` 'true'.

    Tombstones stay, with a NULL row.
    """
    kept = canonical.where(F.col("reject_reason").isNull() | (F.col("reject_reason") == validate.TOMBSTONE))
    is_event = F.col("reject_reason").isNull()
    deleted = F.when(F.col("operation") == "DELETE", F.lit("true")).otherwise(F.lit("false"))
    marked = F.map_concat(
        image_fields(F.coalesce("after", "before")), F.create_map(F.lit("__deleted"), deleted.cast("variant"))
    )
    return kept.select(
        "fqn", "position", F.when(is_event, F.to_variant_object(marked)).alias("row")
    )
