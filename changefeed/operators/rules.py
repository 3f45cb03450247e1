"""Per-table rules: which tables, which columns, which key.

A rule table has ``fqn`` and, as needed, ``include_mode`` (INCLUDE_ALL or EXCLUDE_SPECIFIED),
``column_filter`` (array), ``key_columns`` (array) and ``topic_pattern``. One row per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.operators.envelope import image_fields, qualified_name
from changefeed.operators.skew import broadcast_if_small

RULES_SCHEMA = (
    "fqn STRING, include_mode STRING, column_filter ARRAY<STRING>, key_columns ARRAY<STRING>, topic_pattern STRING"
)

EXCLUDE = "EXCLUDE_SPECIFIED"


def split_qualified_name(name: Column, database_type: Column, default_database: Column) -> Column:
    """``table`` or ``x.table`` as STRUCT<database, schema, table>; NULL for another shape.

    For MySQL ``x`` is a database and there is no schema; elsewhere ``x`` is a schema, by default public.
    Empty parts at the end do not count.
    """
    parts = F.split(F.regexp_replace(name, r"\.+\z", ""), r"\.")
    first, second, size = parts.getItem(0), F.try_element_at(parts, F.lit(2)), F.size(parts)
    is_mysql = F.upper(database_type) == "MYSQL"

    def named(database: Column, schema: Column, table: Column) -> Column:
        return F.struct(database.alias("database"), schema.alias("schema"), table.alias("table"))

    no_schema = F.lit(None).cast("string")
    return (
        F.when(is_mysql & (size == 1), named(default_database, no_schema, first))
        .when(is_mysql & (size == 2), named(first, no_schema, second))
        .when(~is_mysql & (size == 2), named(default_database, first, second))
        .when(~is_mysql & (size == 1), named(default_database, F.lit("public"), first))
    )


def resolve_rule_names(rules: DataFrame, database: str, database_type: str, name: str = "table") -> DataFrame:
    """Add ``fqn`` to rules that carry short table names; rules with an unreadable name are dropped here
    and can be listed with ``split_qualified_name(...).isNull()``."""
    split = split_qualified_name(F.col(name), F.lit(database_type), F.lit(database))
    return (
        rules.withColumn("_t", split)
        .where(F.col("_t").isNotNull())
        .withColumn("fqn", qualified_name(F.col("_t.database"), F.col("_t.schema"), F.col("_t.table")))
        .drop("_t")
    )


def valid_key_columns(columns: Column) -> Column:
    """A row key has at least one column and names none twice."""
    return F.coalesce((F.size(columns) > 0) & (F.size(F.array_distinct(columns)) == F.size(columns)), F.lit(False))


def include_tables(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events of the listed tables."""
    return events.join(broadcast_if_small(rules.select("fqn").distinct()), "fqn", "left_semi")


def join_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events of the listed tables with their rule's columns. Of several rules for one table one is taken, the same in every run."""
    columns = [c for c in rules.columns if c != "fqn"]
    single = rules.groupBy("fqn").agg(F.min(F.struct(*columns)).alias("_rule")).select("fqn", *[F.col(f"_rule.{c}") for c in columns]) if columns else rules.distinct()
    return events.join(broadcast_if_small(single), "fqn", "inner")


def _without(image: Column, mode: Column, column_filter: Column) -> Column:
    kept = F.map_filter(
        image_fields(image),
        lambda name, _: ~F.coalesce((mode == EXCLUDE) & F.array_contains(column_filter, name), F.lit(False)),
    )
    filtered = (mode == EXCLUDE) & (F.size(column_filter) > 0)
    return F.when(filtered, F.to_variant_object(kept)).otherwise(image)


def exclude_columns(events_with_rules: DataFrame) -> DataFrame:
    """Drop the listed columns from both images. Images of tables without a filter are not rebuilt."""
    mode, columns = F.col("include_mode"), F.col("column_filter")
    return events_with_rules.withColumns(
        {"before": _without(F.col("before"), mode, columns), "after": _without(F.col("after"), mode, columns)}
    )


def exclude_table_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """The same for a typed table: the columns are not even scanned."""
    return table.drop(*columns)


def row_key(key_columns: Column) -> Column:
    """JSON array text of the key columns of a row, from its after image or, for a delete, its before image."""
    fields = image_fields(F.coalesce(F.col("after"), F.col("before")))
    return F.to_json(F.transform(key_columns, lambda c: F.try_element_at(fields, c)))
