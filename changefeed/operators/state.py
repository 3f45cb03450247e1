"""Table state from a change feed: net changes, replay, drift of rows, duplicates, transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.operators.envelope import image_fields
from changefeed.operators.positions import sort_key


def net_changes(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """One net change per row key. Adds to ``key``: operation, before (first), after (last).

    A row that was inserted and then deleted within the feed leaves no change. First and last are partial
    aggregates, so a hot key is reduced before the shuffle.
    """
    at = sort_key()
    folded = events.groupBy(*key).agg(
        F.min_by(F.struct("operation", "before"), at).alias("first"),
        F.max_by(F.struct("operation", "after"), at).alias("last"),
    )
    born = F.col("first.operation") == "INSERT"
    gone = F.col("last.operation") == "DELETE"
    operation = (
        F.when(born & ~gone, F.lit("INSERT")).when(~born & gone, F.lit("DELETE")).when(~born & ~gone, F.lit("UPDATE"))
    )
    return folded.select(
        *key, operation.alias("operation"), F.col("first.before").alias("before"), F.col("last.after").alias("after")
    ).where(F.col("operation").isNotNull())


def replay_state(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current rows: the newest event per key unless it deleted the row.

    Spark limits each key to one row per input partition before the shuffle (window group limit).
    """
    newest = Window.partitionBy(*key).orderBy(sort_key().desc())
    last = events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")
    return last.where(F.col("operation") != "DELETE")


def state_as_of(events: DataFrame, key: Sequence[str], bound: Column) -> DataFrame:
    """``replay_state`` of the events for which ``bound`` holds (a time or position condition)."""
    return replay_state(events.where(bound), key)


def row_versions(events: DataFrame, key: Sequence[str], columns: Sequence[str], bounds: dict[str, Column]) -> DataFrame:
    """``key`` and, for each name in ``bounds``, the row (a struct of ``columns``) as it was left by the events for which the bound holds; NULL where there was
    none or it was deleted.

    The events are read once for all versions. Each is a partial aggregate, so a hot key is reduced before the shuffle.
    """
    at, row = sort_key(), F.struct((F.col("operation") == "DELETE").alias("gone"), F.struct(*columns).alias("row"))
    last = events.groupBy(*key).agg(*(F.max_by(row, F.when(bound, at)).alias(name) for name, bound in bounds.items()))
    rows = last.select(*key, *(F.when(~F.col(f"{name}.gone"), F.col(f"{name}.row")).alias(name) for name in bounds))
    return rows.where(F.coalesce(*bounds).isNotNull())


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that identify more than one row, with their number of rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dedupe(events: DataFrame) -> DataFrame:
    """One copy per ``event_id``; copies collapse before the shuffle."""
    return events.dropDuplicates(["event_id"])


def transaction_groups(events: DataFrame, tx_field: str = "txId", *more: Column) -> DataFrame:
    """Events of one transaction: number, first and last position, and further aggregates. See ``streaming.transactions`` for a stream."""
    at = sort_key()
    return (
        events.withColumn("tx_id", F.try_variant_get("position.offset", f"$.{tx_field}", "bigint"))
        .where(F.col("tx_id").isNotNull())
        .groupBy(F.col("position.source_partition").alias("source_partition"), "tx_id")
        .agg(
            F.count("*").alias("n_events"),
            F.min_by("position", at).alias("first_position"),
            F.max_by("position", at).alias("last_position"),
            *more,
        )
    )


def changed_columns(events: DataFrame) -> DataFrame:
    """One row per UPDATE and column that differs: the event's columns plus column, old, new (JSON text)."""

    def as_text(value: Column) -> Column:
        return F.when(~F.is_variant_null(value), F.to_json(value))

    pairs = F.map_zip_with(
        image_fields(F.col("before")),
        image_fields(F.col("after")),
        lambda _, old, new: F.struct(as_text(old).alias("old_value"), as_text(new).alias("new_value")),
    )
    differing = F.map_filter(pairs, lambda _, pair: ~pair["old_value"].eqNullSafe(pair["new_value"]))
    updates = events.where(F.col("operation") == "UPDATE")
    return updates.select("*", F.explode(differing).alias("column", "_pair")).select(
        *events.columns, "column", "_pair.old_value", "_pair.new_value"
    )
