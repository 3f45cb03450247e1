"""Keyed difference of two versions of a table (of rows, or of the rule table).

Keys are unique within a version (check with ``state.duplicate_keys``) and not NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_added(current: DataFrame, previous: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Rows whose key is new; all rows when there is no previous version."""
    return current if previous is None else current.join(previous.select(*key), list(key), "left_anti")


def rows_removed(current: DataFrame, previous: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Previous rows whose key is gone; none when there is no previous version."""
    if previous is None:
        return current.where(F.lit(False))
    return previous.join(current.select(*key), list(key), "left_anti")


def _compared(df: DataFrame, key: Sequence[str], ignore: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in key and c not in ignore]


def _differs(columns: Sequence[str]) -> Column:
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    return differs


def _paired(
    current: DataFrame, previous: DataFrame, key: Sequence[str], columns: Sequence[str], how: str
) -> DataFrame:
    new = current.select(*key, F.struct(*columns).alias("_new"))
    old = previous.select(*key, F.struct(*columns).alias("_old"))
    return new.join(old, list(key), how)


def rows_changed(
    current: DataFrame, previous: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()
) -> DataFrame:
    """Keys in both versions whose other columns differ, with old_ and new_ values."""
    columns = _compared(current, key, ignore)
    return (
        _paired(current, previous, key, columns, "inner")
        .where(_differs(columns))
        .select(
            *key,
            *[F.col(f"_old.{c}").alias(f"old_{c}") for c in columns],
            *[F.col(f"_new.{c}").alias(f"new_{c}") for c in columns],
        )
    )


def snapshot_diff(
    current: DataFrame, previous: DataFrame | None, key: Sequence[str], ignore: Sequence[str] = ()
) -> DataFrame:
    """All differences as change rows: ``key``, operation, before and after (structs), in one join."""
    columns = _compared(current, key, ignore)
    if previous is None:
        previous = current.where(F.lit(False))
    return version_diff(_paired(current, previous, key, columns, "full_outer"), key, "_new", "_old", columns)


def version_diff(versions: DataFrame, key: Sequence[str], new: str, old: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``snapshot_diff`` of two versions that stand side by side (structs ``new`` and ``old``, NULL for no row): no join. See ``state.row_versions``."""
    paired = versions.select(*key, F.col(new).alias("_new"), F.col(old).alias("_old"))
    columns = versions.schema[new].dataType.fieldNames() if columns is None else columns
    operation = (
        F.when(F.col("_old").isNull() & F.col("_new").isNotNull(), F.lit("INSERT"))
        .when(F.col("_new").isNull() & F.col("_old").isNotNull(), F.lit("DELETE"))
        .when(_differs(columns), F.lit("UPDATE"))
    )
    return paired.select(*key, operation.alias("operation"), F.col("_old").alias("before"), F.col("_new").alias("after")).where(
        F.col("operation").isNotNull()
    )


def has_changed(
    current: DataFrame, previous: DataFrame | None, key: Sequence[str], ignore: Sequence[str] = ()
) -> DataFrame:
    """One row: ``changed``. True against no previous version."""
    if previous is None:
        return current.agg(F.lit(True).alias("changed"))
    return snapshot_diff(current, previous, key, ignore).agg((F.count("*") > 0).alias("changed"))
