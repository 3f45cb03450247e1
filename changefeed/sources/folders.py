"""Folders of a store that Spark reads: what is complete, versions of a small table, and runs of batches that are merged as they pile up.

A folder is complete once its writer has committed it (the marker ``_SUCCESS``), so a reader sees a write wholly or not at all, on any file system that Spark can
list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 16  # runs that are merged into one of the next level
VERSIONS_KEPT = 2  # the current version of a table and the one before it, for readers that have begun
ATTEMPTS = 8


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str, name: str) -> list[tuple[int, ...]]:
    """Numbers in the names of the complete folders under ``path``; ``name`` has a group (a number) for each, as in ``level=(\\d+)/from=(\\d+)``."""
    pattern = re.sub(r"\(\\d\+\)", "*", name)
    found = _file_system(spark, path).globStatus(_path(spark, f"{path}/{pattern}/_SUCCESS")) or []
    matches = (re.search(f"{name}/_SUCCESS$", status.getPath().toString()) for status in found)
    return sorted(tuple(map(int, m.groups())) for m in matches if m)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is not there is no error."""
    _file_system(spark, path).delete(_path(spark, path), True)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- versions -------------------------------------------------------------------------------------------------

VERSION = r"version=(\d+)"


def version_path(path: str, number: int) -> str:
    return f"{path}/version={number:012d}"


def current_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The newest complete version, below ``before`` if that is given."""
    return max((v for (v,) in complete(spark, path, VERSION) if before is None or v < before), default=None)


def read_version(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of the current version; none before the first one is written."""
    number = current_version(spark, path, before)
    return empty(spark, schema) if number is None else spark.read.schema(schema).parquet(version_path(path, number))


def write_version(rows: DataFrame, path: str, number: int) -> None:
    """Write a version, in place of one of the same number, and drop those before the last VERSIONS_KEPT.

    ``rows`` may be made from an earlier version.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(version_path(path, number))
    for (old,) in complete(spark, path, VERSION)[:-VERSIONS_KEPT]:
        delete(spark, version_path(path, old))


def replace_version(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Make the next version by ``change`` of the current one. Who comes second with a number takes the version of the first and tries the next number."""
    for _ in range(ATTEMPTS):
        number = current_version(spark, path)
        following = 0 if number is None else number + 1
        rows = change(read_version(spark, path, schema))
        try:
            rows.write.mode("errorifexists").parquet(version_path(path, following))
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if current_version(spark, path) == number:  # an attempt that died left it incomplete
                delete(spark, version_path(path, following))
            continue
        for (old,) in complete(spark, path, VERSION)[:-VERSIONS_KEPT]:
            delete(spark, version_path(path, old))
        return following
    raise RuntimeError(f"{path}: no version could be written in {ATTEMPTS} attempts")


# --- runs of batches ------------------------------------------------------------------------------------------

RUN = r"level=(\d+)/from=(\d+)"


def run_path(path: str, level: int, first: int) -> str:
    return f"{path}/level={level}/from={first}"


def covering(runs: Sequence[tuple[int, int]], before: int | None = None) -> list[tuple[int, int]]:
    """The fewest of the complete runs (level, first batch) that hold every batch, up to ``before`` if that is given, once.

    Runs of a level are aligned, so of two that overlap one holds the other.
    """
    chosen: list[tuple[int, int]] = []
    for level, first in sorted(runs, key=lambda r: (-r[0], r[1])):
        end = first + FAN**level
        if (before is None or end <= before) and not any(f <= first < f + FAN**at for at, f in chosen):
            chosen.append((level, first))
    return sorted(chosen, key=lambda r: r[1])


def read_runs(spark: SparkSession, path: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before a batch. At most FAN - 1 runs of each level are read, so their number grows with the logarithm of the
    number of batches."""
    paths = [run_path(path, *r) for r in covering(complete(spark, path, RUN), before)]
    return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)


def write_run(rows: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Store the rows of a batch; a batch that runs again replaces its own."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(run_path(path, 0, batch_id))


def merge_runs(
    spark: SparkSession, path: str, schema: str | StructType, batch_id: int, merge: Callable[[DataFrame], DataFrame], partition_by: Sequence[str] = ()
) -> None:
    """Before batch ``batch_id`` is stored: merge the FAN runs of a level that it closes into one of the next, level by level.

    All earlier batches are complete by then. A merge that failed is made again when the batch is; until then its parts are read. Parts are deleted
    one merge later, so what reads them now can end. Rows are read and written once for each level.
    """
    level = 1
    while batch_id >= FAN**level and batch_id % FAN**level == 0:
        size, part = FAN**level, FAN ** (level - 1)
        first = batch_id - size
        runs = complete(spark, path, RUN)
        if (level, first) not in runs:
            parts = [r for r in covering(runs, batch_id) if r[1] >= first]
            if parts:
                read = spark.read.schema(schema)
                paths = [run_path(path, *r) for r in parts]
                # folders of columns are found below one root at a time
                rows = reduce(DataFrame.union, [read.parquet(p) for p in paths]) if partition_by else read.parquet(*paths)
                merge(rows).write.mode("overwrite").partitionBy(*partition_by).parquet(run_path(path, level, first))
        for old in range(max(0, first - size), first, part):
            if (level - 1, old) in runs:
                delete(spark, run_path(path, level - 1, old))
        level += 1
