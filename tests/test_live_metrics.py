"""Folders of runs and versions, and metrics of streams against the batch, whatever the order of the events."""

import os
import random

import pytest
from pyspark.sql import functions as F

from changefeed.operators import envelope, metrics
from changefeed.sources import changelog, folders
from changefeed.streaming import live_metrics
from tests.test_envelope import feed, record

ROWS = "k INT, n BIGINT"


def summed(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def folders_in(path):
    return sum(len([d for d in os.listdir(os.path.join(path, level)) if not d.startswith(".")]) for level in os.listdir(path)) if os.path.isdir(path) else 0


def test_covering():
    runs = [(0, i) for i in range(40)] + [(1, 0), (1, 16)]
    assert folders.covering(runs) == [(1, 0), (1, 16), *((0, i) for i in range(32, 40))]
    assert folders.covering(runs, 20) == [(1, 0), *((0, i) for i in range(16, 20))]
    assert folders.covering([(2, 0), (1, 0), (0, 3), (1, 256)]) == [(2, 0), (1, 256)]
    assert folders.covering([], 5) == []


def test_runs_are_merged_and_read_once(spark, tmp_path, monkeypatch):
    """Three levels with a fan of 3: every reader sees each batch once, and few folders are left."""
    monkeypatch.setattr(folders, "FAN", 3)
    path = str(tmp_path / "runs")
    assert folders.read_runs(spark, path, ROWS).count() == 0
    for batch in range(30):
        for _ in range(2 if batch in (3, 9, 27) else 1):  # a batch that runs again
            folders.merge_runs(spark, path, ROWS, batch, summed)
            folders.write_run(spark.createDataFrame([(1, batch), (batch % 2, 1000)], ROWS).coalesce(1), path, batch)
        if batch in (2, 3, 8, 9, 26, 27, 29):
            got = dict(summed(folders.read_runs(spark, path, ROWS)).collect())
            want = {1: sum(range(batch + 1)) + 1000 * ((batch + 1) // 2), 0: 1000 * (batch // 2 + 1)}
            assert got == want
            earlier = folders.read_runs(spark, path, ROWS, before=batch)
            assert summed(earlier).where("k = 1").first().n == sum(range(batch)) + 1000 * (batch // 2)
    assert len(folders.covering(folders.complete(spark, path, folders.RUN))) <= 2 * 4
    assert folders_in(path) <= 4 * 3 * 2


def test_a_merge_that_failed_is_made_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "FAN", 3)
    path = str(tmp_path / "runs")
    for batch in range(3):
        folders.write_run(spark.createDataFrame([(1, batch)], ROWS), path, batch)

    def fail(_):
        raise OSError("executor lost")

    with pytest.raises(OSError):
        folders.merge_runs(spark, path, ROWS, 3, fail)
    assert summed(folders.read_runs(spark, path, ROWS)).first().n == 3
    os.makedirs(folders.run_path(path, 1, 0))  # what a writer that died leaves: no marker
    assert summed(folders.read_runs(spark, path, ROWS)).first().n == 3
    folders.merge_runs(spark, path, ROWS, 3, summed)
    assert folders.covering(folders.complete(spark, path, folders.RUN)) == [(1, 0)]
    assert summed(folders.read_runs(spark, path, ROWS)).first().n == 3


def test_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    assert folders.read_version(spark, path, ROWS).count() == 0 and folders.current_version(spark, path) is None
    for n in range(5):
        number = folders.replace_version(spark, path, ROWS, lambda rows, n=n: rows.union(spark.createDataFrame([(n, n)], ROWS)))
        assert number == n
    assert [r.k for r in folders.read_version(spark, path, ROWS).orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert [v for (v,) in folders.complete(spark, path, folders.VERSION)] == [3, 4]
    os.makedirs(folders.version_path(path, 5))  # a writer died before it was done
    assert folders.replace_version(spark, path, ROWS, lambda rows: rows.where("k > 2")) == 5
    assert [r.k for r in folders.read_version(spark, path, ROWS).orderBy("k").collect()] == [3, 4]

    def second(rows):
        """Another writer is faster, once."""
        if folders.current_version(spark, path) == 5:
            folders.replace_version(spark, path, ROWS, lambda r: r.where("k > 3"))
        return rows.withColumn("n", F.col("n") + 10)

    assert folders.replace_version(spark, path, ROWS, second) == 7
    assert [tuple(r) for r in folders.read_version(spark, path, ROWS).collect()] == [(4, 14)]


def given_feed(spark):
    """Events of five days, some rejected, some tombstones, each twice as late as the one before."""
    rng = random.Random(3)
    values, offsets = [], []
    for n in range(60):
        at = 1_700_000_000_000 + rng.randrange(5 * 86_400_000)
        values.append(None if n % 17 == 5 else record(op="?" if n % 13 == 7 else "c", ts_ms=at))
        offsets.append(f'{{"lsn": {n}, "timestamp": {at}}}')
    return values, offsets


@pytest.mark.parametrize("order", ["rising", "falling", "mixed"])
def test_stream_counts_what_the_batch_counts(spark, tmp_path, order, monkeypatch):
    monkeypatch.setattr(folders, "FAN", 3)
    values, offsets = given_feed(spark)
    rows = sorted(zip(values, offsets), key=lambda r: int(r[1].split(": ")[-1][:-1]), reverse=order == "falling")
    if order == "mixed":
        random.Random(1).shuffle(rows)
    for at in range(0, 60, 6):
        part = [(v, "{server=s}", o) for v, o in rows[at : at + 6]]
        spark.createDataFrame(part, changelog.FEED_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = changelog.stream_changes(spark, str(tmp_path / "feed"), per_trigger=1)
    out = str(tmp_path / "out")
    live_metrics.start(stream, out, f"{out}/checkpoint", available_now=True).awaitTermination()
    batch = envelope.to_canonical(changelog.read_changes(spark, str(tmp_path / "feed")))
    want = sorted(tuple(r) for r in metrics.metrics_by_period(envelope.accepted(batch)).collect())
    got = sorted(tuple(r) for r in live_metrics.period_metrics(spark, out).collect())
    assert got == want and sum(sum(r[3:]) for r in want) == sum(v is not None and '"?"' not in v for v in values)
    assert live_metrics.capture_metrics(spark, out).first().asDict() == metrics.capture_metrics(batch).first().asDict()


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    canonical = envelope.to_canonical(feed(spark, [record(), record()]))
    for _ in range(2):
        live_metrics.store_batch(canonical, 0, str(tmp_path))
    assert live_metrics.capture_metrics(spark, str(tmp_path)).first().captured == 2


def test_no_batch_yet(spark, tmp_path):
    assert live_metrics.period_metrics(spark, str(tmp_path)).count() == 0
    assert live_metrics.capture_metrics(spark, str(tmp_path)).first().captured == 0
