"""Helpers that keep one hot key, source or table from landing in one task.

Lag, numbering and exact percentiles are done in two levels: inside ranges of ``width`` consecutive
values of an integer order column, then over one row per range. A range holds at most ``width``
distinct order values whatever the key, so no task holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_WIDTH = 1 << 20
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` is shown to have at most ``max_rows`` rows.

    A larger side gets no hint: the join is planned by statistics and AQE splits its skewed keys.
    The check reads at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _range_of(order: str, width: int) -> Column:
    order_column = F.col(order).cast("bigint")
    return F.call_function("div", order_column - F.pmod(order_column, F.lit(width)), F.lit(width))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], right_suffix: str) -> Column:
    """Null-safe equality of ``keys``, so rows with a NULL key keep their neighbours."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key + right_suffix])
    return condition


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    prefix: str = "p_",
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Add ``lag(column)`` per ``keys`` in ``order`` for each of ``columns``.

    ``order`` is an integer column, unique within a key.
    """
    keys = list(keys)
    payload = F.struct(*columns)
    ranged = df.withColumn("_range", _range_of(order, width))
    in_range = Window.partitionBy(*keys, "_range").orderBy(order)
    inner = ranged.withColumn("_prev", F.lag(payload).over(in_range)).withColumn(
        "_first", F.row_number().over(in_range) == 1
    )
    last = ranged.groupBy(*keys, "_range").agg(F.max_by(payload, order).alias("_last"))
    carried = (
        last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
        .where(F.col("_carry").isNotNull())
        .select(*[F.col(k).alias(k + "_c") for k in keys], F.col("_range").alias("_range_c"), "_carry")
    )
    condition = _match(inner, carried, keys, "_c") & (inner["_range"] == carried["_range_c"]) & inner["_first"]
    joined = inner.join(carried, condition, "left")
    before = F.coalesce("_prev", "_carry")
    return joined.select(*df.columns, *[before[c].alias(prefix + c) for c in columns])


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Add the 1-based position of each row among the rows of its ``keys``.

    ``order[0]`` is an integer column; the further ones break ties.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", _range_of(order[0], width))
    totals = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *[F.col(k).alias(k + "_o") for k in keys], F.col("_range").alias("_range_o"), "_offset"
    )
    inner = ranged.withColumn("_number", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    # null-safe: rows without an order value are a range of their own, the first
    condition = _match(inner, offsets, keys, "_o") & inner["_range"].eqNullSafe(offsets["_range_o"])
    return inner.join(offsets, condition).select(
        *df.columns, (F.col("_number") + F.col("_offset")).cast("bigint").alias(name)
    )


def exact_percentiles(
    counts: DataFrame, value: str, n: str, points: Sequence[float], names: Sequence[str], width: int = 1 << 16
) -> DataFrame:
    """One row with the exact, linearly interpolated percentiles of an integer column.

    ``counts`` has one row per distinct value and how often it occurs. Ranges of values are numbered, so no
    task sees all values (``percentile`` keeps every distinct value in one task).
    """
    counts = counts.where(F.col(value).isNotNull()).select(
        F.col(value).cast("bigint").alias("_value"), F.col(n).alias("_n"), _range_of(value, width).alias("_range")
    )
    totals = counts.groupBy("_range").agg(F.sum("_n").alias("_total"))
    # one row per range: at most (max - min) / width rows
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_range_o"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_total").over(Window.partitionBy()).alias("_rows"),
    )
    upto = Window.partitionBy("_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.withColumn("_cum", F.sum("_n").over(upto))
        .join(offsets, F.col("_range") == F.col("_range_o"))
        .withColumn("_hi", F.col("_cum") + F.col("_offset") - 1)
        .withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("_lo"), F.col("_hi")), F.col("_value")))

    aggregates = []
    for point, name in zip(points, names):
        position = F.lit(point) * (F.col("_rows") - 1)
        low, high, share = at(F.floor(position)), at(F.ceil(position)), F.max(position - F.floor(position))
        aggregates.append((low + (high - low) * share).alias(name))
    return ranked.agg(*aggregates)
