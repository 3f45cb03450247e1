"""Capture, table, batch and health metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.operators.positions import sort_key
from changefeed.operators.skew import exact_percentiles
from changefeed.operators.validate import TOMBSTONE
from changefeed.session import written

DEFAULT_PERIOD_MINUTES = 60
MAX_PERIOD_MINUTES = 1440
LATENCY_POINTS = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}

# Worst state first, and the state of an engine that is in a given run state.
HEALTH_STATES = ("DOWN", "DEGRADED", "UNKNOWN", "UP")
RUN_STATE_HEALTH = {
    "RUNNING": "UP", "STOPPED": "DOWN", "FAILED": "DOWN", "STARTING": "DEGRADED", "STOPPING": "DEGRADED",
}


def latency_ms(timestamp: Column | str = "timestamp", source_ts: Column | str = "source_ts") -> Column:
    return F.unix_millis(timestamp) - F.unix_millis(source_ts)


def latency_histogram(canonical: DataFrame) -> DataFrame:
    """(published, latency, n, first, last): how often a latency occurs, exactly, and when first and last. Rejected records have no latency.

    ``canonical`` is the output of ``to_canonical``; tombstones are not counted. Histograms of parts of a feed can be merged.
    """
    published = F.col("reject_reason").isNull()
    return (
        canonical.where(~F.col("reject_reason").eqNullSafe(TOMBSTONE))
        .withColumn("published", published)
        .groupBy("published", F.when(published, latency_ms()).alias("latency"))
        .agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    )


def merge_histograms(histograms: DataFrame) -> DataFrame:
    """Rows of several histograms as one."""
    return histograms.groupBy("published", "latency").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def metrics_of_histogram(histogram: DataFrame) -> DataFrame:
    """``capture_metrics`` of what a histogram has counted."""
    ok = F.col("published")
    counts = histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("captured"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("published"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("failed"),
        F.min(F.when(ok, F.col("first"))).alias("period_start"),
        F.max(F.when(ok, F.col("last"))).alias("period_end"),
    )
    latencies = histogram.where(ok)
    points = exact_percentiles(latencies, "latency", "n", tuple(LATENCY_POINTS.values()), tuple(LATENCY_POINTS))
    both = counts.unionByName(points, allowMissingColumns=True)  # one row each
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def capture_metrics(canonical: DataFrame) -> DataFrame:
    """One row: captured, published, failed, exact latency percentiles, period start and end.

    Runs the decoding at once and stores its histogram of latencies in the work folder, so the feed is decoded once.
    """
    return metrics_of_histogram(written(latency_histogram(canonical), "latencies"))


def _operation_counts() -> list[Column]:
    return [F.count_if(F.col("operation") == op).alias(f"{op.lower()}_count") for op in ("INSERT", "UPDATE", "DELETE")]


def table_metrics(events: DataFrame) -> DataFrame:
    """Per table: operation counts, last event time, last position."""
    return events.groupBy("fqn").agg(
        *_operation_counts(),
        F.max("timestamp").alias("last_event"),
        F.max_by("position", sort_key()).alias("last_position"),
    )


def metrics_since(events: DataFrame, start: Column, now: Column | None = None) -> DataFrame:
    """Per-table operation counts from ``start`` (included) on, up to ``now`` if given."""
    period = events.where(F.col("timestamp") >= start)
    if now is not None:
        period = period.where(F.col("timestamp") <= now)
    return period.groupBy("fqn").agg(*_operation_counts())


def look_back(now: Column, minutes: int = DEFAULT_PERIOD_MINUTES) -> Column:
    """Start of a look-back period of 1 to 1440 minutes."""
    if not 1 <= minutes <= MAX_PERIOD_MINUTES:
        raise ValueError(f"period must be 1 to {MAX_PERIOD_MINUTES} minutes: {minutes}")
    return now - F.make_interval(mins=F.lit(minutes))


PERIOD_COUNTS = "period_start TIMESTAMP, period_end TIMESTAMP, fqn STRING, insert_count BIGINT, update_count BIGINT, delete_count BIGINT"


def metrics_by_period(events: DataFrame, period: str = "60 minutes") -> DataFrame:
    """Operation counts per table and tumbling period (PERIOD_COUNTS). On a stream, see ``streaming.live_metrics``, which waits for no late event and loses none."""
    return (
        events.groupBy(F.window("timestamp", period).alias("period"), "fqn")
        .agg(*_operation_counts())
        .select(F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "fqn",
                *[f"{op}_count" for op in ("insert", "update", "delete")])
    )


def merge_periods(counts: DataFrame) -> DataFrame:
    """Counts of several parts of a feed as one."""
    return counts.groupBy("period_start", "period_end", "fqn").agg(
        *[F.sum(f"{op}_count").alias(f"{op}_count") for op in ("insert", "update", "delete")]
    )


def capture_checks() -> dict[str, Column]:
    """Rules that a ``capture_metrics`` row keeps; true where kept, or where a value is absent."""
    counts = [F.col(c) for c in ("captured", "published", "failed")]
    return {
        "counts_not_negative": F.least(*counts) >= 0,
        "published_within_captured": F.col("published") <= F.col("captured"),
        "percentiles_ascend": (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("p99_ms")),
        "period_ascends": F.col("period_start") <= F.col("period_end"),
    }


def table_checks() -> dict[str, Column]:
    """Rules that a ``table_metrics`` row keeps."""
    counts = [F.col(f"{op}_count") for op in ("insert", "update", "delete")]
    return {"counts_not_negative": F.least(*counts) >= 0, "has_table": F.trim("fqn") != ""}


def check_metrics(metrics: DataFrame, checks: dict[str, Column], scope: Column) -> DataFrame:
    """Rows (scope, check, ok), one per metrics row and rule."""
    results = [
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(True)).alias("ok")) for name, ok in checks.items()
    ]
    return metrics.select(scope.alias("scope"), F.inline(F.array(*results)))


def violations(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("ok"))


def batch_result(canonical: DataFrame, batch: Column) -> DataFrame:
    """Per batch: success, failure, total, success rate (0 when empty), mean latency of its events in ms."""
    ok = F.col("reject_reason").isNull()
    return (
        canonical.where(~F.col("reject_reason").eqNullSafe(TOMBSTONE))
        .groupBy(batch.alias("batch_id"))
        .agg(
            F.count_if(ok).alias("success_count"),
            F.count_if(~ok).alias("failure_count"),
            F.count("*").alias("total"),
            F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("success_rate"),
            F.coalesce(F.avg(F.when(ok, latency_ms())), F.lit(0.0)).alias("mean_ms"),
        )
    )


def run_state_health(run_state: Column) -> Column:
    """Health of an engine in a run state; UNKNOWN for a state not listed."""
    health = F.lit("UNKNOWN")
    for state, name in RUN_STATE_HEALTH.items():
        health = F.when(run_state == state, F.lit(name)).otherwise(health)
    return health


def health_rollup(components: DataFrame, check: str = "check_id", state: str = "state") -> DataFrame:
    """Worst component state per check, and whether it is healthy."""
    severity = F.lit(len(HEALTH_STATES) - HEALTH_STATES.index("UNKNOWN"))
    for i, name in enumerate(HEALTH_STATES):
        severity = F.when(F.col(state) == name, F.lit(len(HEALTH_STATES) - i)).otherwise(severity)
    names = F.array(*[F.lit(n) for n in reversed(HEALTH_STATES)])
    return (
        components.groupBy(check)
        .agg(F.max(severity).alias("_worst"))
        .select(check, F.element_at(names, F.col("_worst")).alias("overall_state"), (F.col("_worst") == 1).alias("healthy"))
    )
