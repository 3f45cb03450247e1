"""Ids of what a stream has published, kept so that a batch reads few files to tell which of its events were published before.

Each batch stores its ids as one run; runs are merged sixteen at a time (``sources.folders``), so their number grows with the logarithm of the number of batches.
A merged run is dealt out into BUCKETS folders by the id's hash, and has a filter: for each bucket, bitmaps in which two places of each id are marked. A batch looks
its ids up in the filters first, which are a sixteenth of the ids' size, and then reads only the buckets of ids that are marked there. A filter never misses an
id; one in a few hundred new ids is looked up in vain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.operators.skew import broadcast_if_small
from changefeed.sources import folders

BUCKETS = 64
BITS_PER_ID = 32
BITMAP = 32768  # bits of one bitmap of Spark's bitmap functions

IDS = "event_id STRING, bucket INT"
FILTERS = "bucket INT, chunks INT, chunk INT, bits BINARY"


def _bucketed(ids: DataFrame) -> DataFrame:
    return ids.select("event_id", F.expr(f"cast(pmod(xxhash64(event_id), {BUCKETS}) as int)").alias("bucket"))


def _places(chunks: Column) -> Column:
    """The two bits of an id among those of ``chunks`` bitmaps."""
    seeds = (F.lit(1), F.lit(2))
    return F.array(*(F.pmod(F.xxhash64(s, "event_id"), chunks.cast("bigint") * BITMAP) for s in seeds))


def _filter_path(path: str, level: int, first: int) -> str:
    return folders.run_path(f"{path}-filters", level, first)


def store(ids: DataFrame, path: str, batch_id: int) -> None:
    """Store the ids (column event_id) of a batch, after merging the runs that it closes. A batch that runs again replaces its own."""
    spark = ids.sparkSession

    def merge(rows: DataFrame) -> DataFrame:
        # a merged run has one file for each bucket
        return rows.dropDuplicates(["event_id", "bucket"]).repartition(BUCKETS, "bucket")

    before = set(folders.complete(spark, path, folders.RUN))
    folders.merge_runs(spark, path, IDS, batch_id, merge, ["bucket"])
    for level, first in set(folders.complete(spark, path, folders.RUN)) - before:
        _write_filter(spark, path, level, first)
    for level, first in before - set(folders.complete(spark, path, folders.RUN)):
        folders.delete(spark, _filter_path(path, level, first))
    folders.write_run(_bucketed(ids), path, batch_id)


def _write_filter(spark: SparkSession, path: str, level: int, first: int) -> None:
    run = spark.read.schema(IDS).parquet(folders.run_path(path, level, first))
    count = run.count()
    # as many bitmaps as the run's ids need, the next power of two
    chunks = 1 << max(0, math.ceil(math.log2(max(1, count * BITS_PER_ID / BUCKETS / BITMAP))))
    marked = run.select("bucket", F.explode(_places(F.lit(chunks))).alias("place")).select(
        "bucket", F.expr(f"cast(place div {BITMAP} as int)").alias("chunk"), (F.col("place") % BITMAP).alias("bit")
    )
    filters = marked.groupBy("bucket", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.select("bucket", F.lit(chunks).alias("chunks"), "chunk", "bits").write.mode("overwrite").parquet(_filter_path(path, level, first))


def _maybe_stored(ids: DataFrame, filters: DataFrame, chunks: int) -> DataFrame:
    """The ids both of whose bits are set in a run's filter."""
    marks = F.transform(_places(F.lit(chunks)), lambda p: F.struct(F.call_function("div", p, F.lit(BITMAP)).cast("int").alias("chunk"), (p % BITMAP).alias("bit")))
    wanted = ids.select("event_id", "bucket", F.explode(marks).alias("mark")).select("event_id", "bucket", "mark.*").distinct()
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bit div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(1) == 1
    found = wanted.join(filters.select("bucket", "chunk", "bits"), ["bucket", "chunk"], "left")
    return found.groupBy("event_id", "bucket").agg(F.min(F.coalesce(is_set, F.lit(False))).alias("marked")).where("marked").select("event_id", "bucket")


def stored(ids: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Those of ``ids`` (column event_id) that were stored before batch ``batch_id``."""
    spark = ids.sparkSession
    runs = folders.covering(folders.complete(spark, path, folders.RUN), batch_id)
    own = _bucketed(ids).distinct()
    found = own.where(F.lit(False)).select("event_id")
    small = [folders.run_path(path, *r) for r in runs if r[0] == 0]
    if small:
        found = found.union(spark.read.schema(IDS).parquet(*small).join(broadcast_if_small(own.select("event_id")), "event_id", "left_semi").select("event_id"))
    filtered = set(folders.complete(spark, f"{path}-filters", folders.RUN))
    for run in runs:
        if run[0] == 0:
            continue
        maybe = own
        if run in filtered:
            filters = spark.read.schema(FILTERS).parquet(_filter_path(path, *run))
            first = filters.select("chunks").first()
            maybe = _maybe_stored(own, filters, first.chunks) if first else own.where(F.lit(False))
        buckets = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if buckets:
            kept = spark.read.schema(IDS).parquet(folders.run_path(path, *run)).where(F.col("bucket").isin(buckets))
            found = found.union(kept.join(broadcast_if_small(maybe.select("event_id")), "event_id", "left_semi").select("event_id"))
    return found.distinct()
