"""Integrity of change events. A record that fails gets a reason and never stops a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOMBSTONE = "TOMBSTONE"

# name parts of letters, digits and underscores, one to three of them
IDENTIFIER_PATTERN = r"\A[a-zA-Z0-9_]+(\.[a-zA-Z0-9_]+){0,2}\z"

INTEGRITY_REASONS = (
    "INSERT_WITH_BEFORE",
    "INSERT_WITHOUT_AFTER",
    "UPDATE_WITHOUT_BEFORE",
    "UPDATE_WITHOUT_AFTER",
    "DELETE_WITHOUT_BEFORE",
    "DELETE_WITH_AFTER",
)
REQUIRED_REASONS = (
    "MALFORMED",
    "MISSING_SOURCE",
    "TIME_OUT_OF_RANGE",
    "BLANK_DATABASE",
    "BLANK_TABLE",
    "INVALID_IDENTIFIER",
    "UNKNOWN_OP",
    "BLANK_PARTITION",
    "EMPTY_OFFSET",
)


def valid_identifier(name: Column, database: Column) -> Column:
    """A fully qualified name of one to three plain parts, its database free of ``;`` and ``'``."""
    return name.rlike(IDENTIFIER_PATTERN) & ~database.contains(";") & ~database.contains("'")


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def integrity_reason(operation: Column, before: Column, after: Column) -> Column:
    """INSERT has only an after image, UPDATE both, DELETE only a before image."""
    return (
        F.when((operation == "INSERT") & before.isNotNull(), F.lit("INSERT_WITH_BEFORE"))
        .when((operation == "INSERT") & after.isNull(), F.lit("INSERT_WITHOUT_AFTER"))
        .when((operation == "UPDATE") & before.isNull(), F.lit("UPDATE_WITHOUT_BEFORE"))
        .when((operation == "UPDATE") & after.isNull(), F.lit("UPDATE_WITHOUT_AFTER"))
        .when((operation == "DELETE") & before.isNull(), F.lit("DELETE_WITHOUT_BEFORE"))
        .when((operation == "DELETE") & after.isNotNull(), F.lit("DELETE_WITH_AFTER"))
    )


def _not_an_object(raw: Column, image: Column) -> Column:
    """An image that is there but is neither an object nor JSON null."""
    return raw.isNotNull() & ~F.is_variant_null(raw) & image.isNull()


def reject_reason(check_identifiers: bool = False) -> Column:
    """First failure of a staged event (``envelope`` plus canonical columns), NULL when sound."""
    envelope = F.col("envelope")
    malformed = (
        envelope["_malformed"].isNotNull()
        | _not_an_object(envelope["before"], F.col("before"))
        | _not_an_object(envelope["after"], F.col("after"))
    )
    bad_name = F.lit(check_identifiers) & ~valid_identifier(F.col("fqn"), F.col("table.database"))
    return (
        F.when(envelope.isNull(), F.lit(TOMBSTONE))
        .when(malformed, F.lit("MALFORMED"))
        .when(envelope["source"].isNull(), F.lit("MISSING_SOURCE"))
        # the only envelopes without a time
        .when(F.col("timestamp").isNull(), F.lit("TIME_OUT_OF_RANGE"))
        .when(_blank(F.col("table.database")), F.lit("BLANK_DATABASE"))
        .when(_blank(F.col("table.table")), F.lit("BLANK_TABLE"))
        .when(bad_name, F.lit("INVALID_IDENTIFIER"))
        .when(F.col("operation").isNull(), F.lit("UNKNOWN_OP"))
        .when(_blank(F.col("position.source_partition")), F.lit("BLANK_PARTITION"))
        .when(F.col("_offset_size") == 0, F.lit("EMPTY_OFFSET"))
        .otherwise(integrity_reason(F.col("operation"), F.col("before"), F.col("after")))
    )
