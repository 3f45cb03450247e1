"""Topics and message keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topic naming rules.
DEFAULT_PATTERN = "cdc.{database}.{table}"
MAX_TOPIC_LENGTH = 249
TOPIC_PATTERN = r"\A[a-zA-Z0-9._-]+\z"


# a part that sanitizing leaves as it is
_CLEAN_PART = r"\A(?!_)(?!.*__)[a-zA-Z0-9._-]+(?<!_)\z"


def sanitize_topic_part(part: Column) -> Column:
    """Invalid characters become ``_``; then edge underscores go, and runs of them shrink to one."""
    replaced = F.regexp_replace(part, r"[^a-zA-Z0-9._-]", "_")
    trimmed = F.regexp_replace(replaced, r"\A_+|_+\z", "")
    collapsed = F.regexp_replace(trimmed, r"_+", "_")
    return F.when(part.rlike(_CLEAN_PART), part).otherwise(F.coalesce(F.nullif(collapsed, F.lit("")), F.lit("unknown")))


def topic_name(table: Column, pattern: Column | None = None, default: str = DEFAULT_PATTERN) -> Column:
    """Topic of a STRUCT<database, schema, table>. A NULL schema reads ``public``; a NULL or blank pattern
    falls back to ``default``."""
    chosen = F.lit(default)
    if pattern is not None:
        chosen = F.when(F.trim(pattern) != "", pattern).otherwise(F.lit(default))
    parts = {
        "{database}": table["database"],
        "{schema}": F.coalesce(table["schema"], F.lit("public")),
        "{table}": table["table"],
    }
    for placeholder, part in parts.items():
        chosen = F.replace(chosen, F.lit(placeholder), sanitize_topic_part(part))
    return chosen


def topic_problem(topic: Column) -> Column:
    """Why a topic name is not valid, NULL if it is."""
    return (
        F.when(topic.isNull() | topic.rlike(r"\A\s*\z"), F.lit("EMPTY"))
        .when(topic.isin(".", ".."), F.lit("DOTS"))
        .when(F.length(topic) > MAX_TOPIC_LENGTH, F.lit("TOO_LONG"))
        .when(~topic.rlike(TOPIC_PATTERN), F.lit("BAD_CHARACTERS"))
    )


def regex_route(topic: Column, pattern: str, replacement: str) -> Column:
    """Rewrite a topic that matches ``pattern`` as a whole (``$1`` names a group); leave others."""
    whole = rf"\A(?:{pattern})\z"
    return F.when(topic.rlike(whole), F.regexp_replace(topic, whole, replacement)).otherwise(topic)


def message_key(table: Column) -> Column:
    """``database.schema.table``, without the schema when it is NULL."""
    return F.concat_ws(".", table["database"], table["schema"], table["table"])


def route(events: DataFrame, default: str = DEFAULT_PATTERN) -> DataFrame:
    """Add ``topic``, ``topic_problem`` and ``key``; uses ``topic_pattern`` where rules were joined.

    The topic comes out of a generator, so that a filter on it does not compute it again.
    """
    pattern = F.col("topic_pattern") if "topic_pattern" in events.columns else None
    topics = F.array(topic_name(F.col("table"), pattern, default))
    return events.select("*", F.explode(topics).alias("topic")).withColumns(
        {"topic_problem": topic_problem(F.col("topic")), "key": message_key(F.col("table"))}
    )
