"""Log positions: order, comparison, newest per source, resume and ordered delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.operators.skew import broadcast_if_small
from changefeed.session import discard, written


def key_parts(position: Column) -> dict[str, Column]:
    """The parts of a position's key, the most telling first: time, sequence, then the log's own place (text, then number)."""
    return {"ts": position["ts_key"], "seq": position["seq_key"], "file": place_text(position["log_file"]), "log": position["log_key"]}


def sort_key(position: Column | None = None) -> Column:
    """Orderable key inside one source partition. A part that is missing comes before any that is there.

    Everything about order comes from this key: sorting, comparison, the newest position, resume and numbering.
    """
    return F.struct(*(part.alias(name) for name, part in key_parts(F.col("position") if position is None else position).items()))


def place_text(text: Column) -> Column:
    """Text that orders as the log places do that ``text`` stands for: numbers in it by value, however they are written.

    ``bin.999`` comes before ``bin.1000``. Groups of hexadecimal digits (``0/16B3748``, ``0000002A:00000758:0005``) are numbers of base 16.
    """
    groups = F.transform(F.split(F.lower(text), "[:/]"), _by_value)
    tokens = F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda t: F.when(t.rlike("^[0-9]"), _by_value(t)).otherwise(t))
    return F.when(text.rlike(r"\A[0-9A-Fa-f]+([:/][0-9A-Fa-f]+)+\z"), F.array_join(groups, ":")).otherwise(F.array_join(tokens, ""))


def _by_value(digits: Column) -> Column:
    """Digits of any number, led by how many there are."""
    plain = F.regexp_replace(digits, "^0+", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def order_parts(position: str = "position") -> list[Column]:
    at = F.col(position)
    return [at["source_partition"], *key_parts(at).values()]


def order_columns(position: str = "position") -> list[Column]:
    return [part.asc_nulls_first() for part in order_parts(position)]


def with_order(rows: DataFrame, parts: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with what they are to be ordered by as columns, and the order on these.

    Spark computes an expression that it sorts by anew at each comparison, a column once a row: a log place that is text takes several regular expressions.
    """
    names = [f"_order_{i}" for i in range(len(parts))]
    return rows.select("*", *(part.alias(name) for part, name in zip(parts, names))), [F.col(name).asc_nulls_first() for name in names]


def in_position_order(events: DataFrame) -> DataFrame:
    keyed, keys = with_order(events, order_parts())
    return keyed.orderBy(*keys).select(*events.columns)


def compare(left: Column, right: Column, mode: str = "typed") -> Column:
    """-1, 0 or 1, first by source partition.

    ``typed``: by ``sort_key``. ``compat``: by time alone if both have one, else by sequence. NULL if a position is.
    """
    if mode not in ("typed", "compat"):
        raise ValueError(f"mode is typed or compat, not {mode!r}")

    def three_way(a: Column, b: Column) -> Column:
        return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))

    def both(key: str) -> Column:
        return left[key].isNotNull() & right[key].isNotNull()

    sources = left["source_partition"], right["source_partition"]
    if mode == "typed":
        order = three_way(*(F.struct(at["source_partition"].alias("source"), sort_key(at).alias("key")) for at in (left, right)))
    else:
        order = (
            F.when(sources[0] != sources[1], three_way(*sources))
            .when(both("ts_key"), three_way(left["ts_key"], right["ts_key"]))
            .when(both("seq_key"), three_way(left["seq_key"], right["seq_key"]))
            .otherwise(F.lit(0))
        )
    return F.when(left.isNotNull() & right.isNotNull(), order)


def is_after(left: Column, right: Column) -> Column:
    return compare(left, right) > 0


def is_before(left: Column, right: Column) -> Column:
    return compare(left, right) < 0


def latest_positions(events: DataFrame) -> DataFrame:
    """Newest position per source partition. A NULL or blank partition has no saved position."""
    return (
        events.where(F.trim("position.source_partition") != "")
        .groupBy(F.col("position.source_partition").alias("source_partition"))
        .agg(F.max_by("position", sort_key()).alias("position"))
    )


def with_saved_position(events: DataFrame, saved: DataFrame) -> DataFrame:
    """Add ``saved`` (position struct, NULL for a source that has none) to each event."""
    side = broadcast_if_small(saved.select(F.col("source_partition").alias("_saved_for"), F.col("position").alias("saved")))
    return events.join(side, F.col("position.source_partition") == F.col("_saved_for"), "left").drop("_saved_for")


def resume_after(events: DataFrame, saved: DataFrame) -> DataFrame:
    """Events after the saved position of their source; all events of a source without one."""
    joined = with_saved_position(events, saved)
    later = is_after(F.col("position"), F.col("saved"))
    return joined.where(F.col("saved").isNull() | later).drop("saved")


def in_delivery_order(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sort by table, then position, spread by ranges: a hot table fills several partitions.

    Partition n holds nothing that belongs before partition n - 1, so files written from the result
    are in log order per table when read in file order.
    """
    keyed, keys = with_order(events, [F.col("fqn"), *order_parts()])
    ranged = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).select(*events.columns)


def with_delivery_number(events: DataFrame, name: str = "delivery_no", partitions: int | None = None) -> DataFrame:
    """Add each event's place (from 1) in the log order of its table; sources that share a table are ordered by their keys, then by name.

    The events are written with what orders them, then exchanged once, by ranges of table and position, so a hot table, or a hot moment of it, fills many tasks. They are
    written again with their place within the range. One row for each range and one for each table then say where a range and a table begin.
    """
    at = F.col("position")
    keyed, keys = with_order(events, [F.col("fqn"), *key_parts(at).values(), at["source_partition"]])
    stored = written(keyed, "events")  # making the ranges reads the rows twice
    ranged = stored.repartitionByRange(partitions, *keys) if partitions else stored.repartitionByRange(*keys)
    in_order = ranged.sortWithinPartitions(*keys).select(*events.columns)
    ordered = written(in_order.withColumn("_at", F.monotonically_increasing_id()), "delivery")
    discard(stored)
    # the place is the number of the task and, in the lower 33 bits, the row's number in it
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = ordered.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    begins = tasks.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    tables = (
        ordered.groupBy("fqn").agg(F.min("_at").alias("_at")).withColumn("_task", task)
        .join(begins, "_task").select(F.col("fqn").alias("_fqn"), (F.col("_begin") + row).alias("_first"))
    )
    placed = ordered.withColumn("_task", task).join(broadcast_if_small(begins), "_task")
    numbered = placed.join(broadcast_if_small(tables), F.col("fqn").eqNullSafe(F.col("_fqn")))
    return numbered.select(*events.columns, (F.col("_begin") + row - F.col("_first") + 1).alias(name))
