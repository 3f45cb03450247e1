"""Schema drift on a stream: each batch against the registered schemas.

The registry is one table of the newest schema of each table. Each batch writes it anew as a version of its own (``sources.folders``): readers see the last version that
is whole, and a batch that runs again starts from the version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.operators import drift
from changefeed.session import written
from changefeed.sources import folders


def registered_schemas(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """(fqn, version, column, type): the newest registered schema of each table, as it stood before a batch if that is given."""
    return folders.read_version(spark, path, drift.SCHEMA_COLUMNS, before_batch)


def detect_and_register(events: DataFrame, batch_id: int, registry: str, changes: str) -> None:
    """Store the schema changes of a batch, then register its schemas.

    Only the version of the batch before is read, so a batch that runs again gives the same.
    """
    earlier = registered_schemas(events.sparkSession, registry, batch_id)
    observed = written(drift.observed_schema(events, batch_id), "observed")
    drift.detect_changes(observed, earlier).write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")
    newer = drift.schemas_to_register(observed, earlier)
    kept = earlier.join(observed.select("fqn").distinct(), "fqn", "left_anti").select(*newer.columns)
    folders.write_version(kept.union(newer), registry, batch_id)


def schema_changes(spark: SparkSession, changes: str) -> DataFrame:
    """The changes of all batches, with the batch that had them."""
    return spark.read.option("basePath", changes).parquet(f"{changes}/batch_id=*").withColumn("batch_id", F.col("batch_id").cast("bigint"))
