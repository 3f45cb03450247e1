"""The capture pipeline as one lazy plan: decode, check, select, normalize, route, serialize."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.functions.normalize import normalize_image
from changefeed.operators import envelope, routing, rules, wire


class Outputs(NamedTuple):
    """``messages`` (topic, key, value), ``rejected``, the accepted ``events`` behind the messages, and ``publishable``, the messages with what orders them."""

    messages: DataFrame
    rejected: DataFrame
    events: DataFrame
    publishable: DataFrame


def normalize_events(events: DataFrame, epoch_units: Mapping[str, str] | None = None, mode: str = "typed", types: Mapping[str, str] | None = None) -> DataFrame:
    return events.withColumns(
        {side: normalize_image(F.col(side), epoch_units, mode, types) for side in ("before", "after")}
    )


def select_and_route(
    events: DataFrame,
    rule_table: DataFrame | None = None,
    normalize: bool = True,
    epoch_units: Mapping[str, str] | None = None,
    topic_pattern: str = routing.DEFAULT_PATTERN,
    mode: str = "typed",
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Accepted events with their topic, key and, under rules, only the wanted tables and columns. ``mode`` and ``types`` are those of ``normalize_image``."""
    if rule_table is not None:
        events = rules.exclude_columns(rules.join_rules(events, rule_table))
    if normalize:
        events = normalize_events(events, epoch_units, mode, types)
    return routing.route(events, topic_pattern)


def run(canonical: DataFrame, rule_table: DataFrame | None = None, **options) -> Outputs:
    """All outputs of a decoded feed. ``options`` are those of ``select_and_route``.

    An event whose topic name is not valid is rejected as ``INVALID_TOPIC``.
    """
    # the record as it came and its event as it was decoded go along: the one for the case that it cannot be routed, the other that it can
    given = [c for c in canonical.columns if c not in (*envelope.CANONICAL_COLUMNS, "reject_reason")]
    sound = canonical.where(F.col("reject_reason").isNull()).select(
        *envelope.CANONICAL_COLUMNS, F.struct(*given).alias("_given"), F.struct(*envelope.CANONICAL_COLUMNS).alias("_event")
    )
    routed = select_and_route(sound, rule_table, **options)
    published = routed.where(F.col("topic_problem").isNull())
    unroutable = routed.where(F.col("topic_problem").isNotNull()).select(
        "_given.*", F.lit("INVALID_TOPIC").alias("reject_reason")
    )
    rejected = envelope.rejected(canonical).unionByName(unroutable, allowMissingColumns=True)
    publishable = wire.to_messages(published)
    return Outputs(publishable.select("topic", "key", "value"), rejected, published.select("_event.*"), publishable)
