"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans count on.

    Instants are rendered and parsed in the session zone, so it is UTC. The JVM does not compile methods
    above 8000 bytes of code; the decoding projections are above that as one generated method, and two to
    three times faster as a chain of small ones.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own master, memory and partition settings."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("changefeed")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CHANGEFEED_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only where that setting is absent in local mode, as in tests, a temporary folder of this machine is used; on a cluster
    executors would not share it, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="changefeed-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the work folder and read back: what builds on it does not compute it again,
    and a lost executor costs only a read.

    The shuffle files of the write are removed when it is done, not when the driver happens to collect its garbage, so they do not pile up over the steps
    of a long job. ``discard`` removes the table itself.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.work_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
