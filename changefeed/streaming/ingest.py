"""Continuous capture: micro-batches through the pipeline, resumed from a checkpoint."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changefeed.operators import envelope
from changefeed.operators.skew import BROADCAST_ROWS
from changefeed.plans import pipeline
from changefeed.session import discard, written
from changefeed.sources import sinks
from changefeed.sources.sinks import Sink
from changefeed.streaming import ids, schemas

log = logging.getLogger(__name__)

FLUSH_INTERVAL = "10 seconds"

RuleLoader = Callable[[], DataFrame | None]


class Held(NamedTuple):
    """What is left of a batch, and the tables of ids behind it (``session.written``), to be discarded when it is done."""

    rows: DataFrame
    ids: list[DataFrame]


def unseen(canonical: DataFrame, seen: str, batch_id: int) -> Held:
    """The batch without copies of accepted events, in it or from earlier batches, whose ids are stored under ``seen`` (see ``streaming.ids``).

    No event time is involved, so a late event is never lost. Rejected records and tombstones stay. The ids of the batch itself,
    from a run that failed, are not looked at: a batch that runs again gives the same rows.

    Ids are counted and looked up alone, and written, so that no plan grows by how they were made. Whole records are dealt out by id only where there are very many
    copies and very many others as well: most batches hold either events that are new or events that came before.
    """
    sound = F.col("reject_reason").isNull()
    accepted = canonical.where(sound)
    own = accepted.groupBy("event_id").agg(F.count("*").alias("times"))
    own = written(own, "batch-ids")
    known = written(ids.stored(own.select("event_id"), seen, batch_id), "known-ids") if batch_id > 0 else None
    counts = own.agg(F.count("*").alias("all"), F.count_if(F.col("times") > 1).alias("repeated")).first()
    earlier = known.count() if known is not None else 0
    if not earlier:
        once = accepted
    elif earlier <= BROADCAST_ROWS:
        once = accepted.join(F.broadcast(known), "event_id", "left_anti")
    elif counts["all"] - earlier <= BROADCAST_ROWS:
        once = accepted.join(F.broadcast(own.select("event_id").join(known, "event_id", "left_anti")), "event_id", "left_semi")
    else:
        once = accepted.join(known, "event_id", "left_anti")
    if counts["repeated"] > BROADCAST_ROWS:
        once = once.dropDuplicates(["event_id"])
    elif counts["repeated"]:
        twice = F.broadcast(own.where("times > 1").select("event_id"))
        once = once.join(twice, "event_id", "left_anti").unionByName(once.join(twice, "event_id", "left_semi").dropDuplicates(["event_id"]))
    return Held(once.select(*canonical.columns).unionByName(canonical.where(~sound)), [own, *([known] if known is not None else [])])


def capture_batch(
    canonical: DataFrame,
    batch_id: int,
    out: str,
    load_rules: RuleLoader | None = None,
    dedupe: bool = False,
    sink: Sink | None = None,
    track_schemas: bool = False,
    **options,
) -> None:
    """Publish through ``sink`` (files by topic under ``out``, if none is given), then store rejects and schema changes, then save positions.

    All that is stored lies under the batch's own folders or versions. With ``dedupe`` every event is published once. With
    ``track_schemas`` the batch's schemas are compared with the registered ones and registered. A batch that runs again after a failure
    replaces what it wrote before, and gives a sink the same messages in the same order.
    """
    source = canonical.persist()
    once = unseen(source, f"{out}/seen", batch_id) if dedupe else Held(source, [])
    held = once.rows.persist()
    try:
        rule_table = load_rules() if load_rules else None
        outputs = pipeline.run(held, rule_table, **options)
        publishable = outputs.publishable.persist()
        try:
            (sink or sinks.file_sink(f"{out}/messages"))(publishable, batch_id)
        finally:
            publishable.unpersist()
        sinks.write_rejected(outputs.rejected, f"{out}/rejected/batch_id={batch_id}")
        events = envelope.accepted(held)
        if track_schemas:
            schemas.detect_and_register(events, batch_id, f"{out}/schemas", f"{out}/schema_changes")
        if dedupe:
            ids.store(events.select("event_id"), f"{out}/seen", batch_id)
        try:
            sinks.save_positions(events, f"{out}/positions")
        except Exception:  # the events are out; the checkpoint still resumes the stream
            log.warning("positions of batch %s were not saved", batch_id, exc_info=True)
    finally:
        held.unpersist()
        discard(*once.ids)
        source.unpersist()


def start_capture(
    changes: DataFrame,
    out: str,
    checkpoint: str,
    load_rules: RuleLoader | None = None,
    dedupe: bool = False,
    available_now: bool = False,
    sink: Sink | None = None,
    track_schemas: bool = False,
    **options,
) -> StreamingQuery:
    """Start capture of a feed stream into ``sink``, or into files under ``out``.

    ``load_rules`` is called for every batch, so changed rules apply without a restart. With ``dedupe`` copies of an event
    are published once, however late they come. ``sink`` is a function of a batch's messages and number, such as ``sinks.kafka_sink(servers)``.
    With ``available_now`` the query ends when it has read what is there.
    """
    canonical = envelope.to_canonical(changes)
    writer = canonical.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: capture_batch(batch, batch_id, out, load_rules, dedupe, sink, track_schemas, **options)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return writer.trigger(**trigger).start()
