"""Responses arriving as files drive the claim feed and the subscriptions.

State is a log of heads, one row per job that moved in a batch, not per-key
state of a streaming operator: a job that sends a third of all responses would
pin one state partition, while a micro-batch compares its responses in parallel.
Each micro-batch writes folders named by the stream and its batch id, so a batch
that Spark repeats after a failure replaces its own output or, once committed,
changes nothing; plain syncs in between have names of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.consumers import Subscriptions
from ..plans.evidence import RESPONSES, ChangeFeed, Evidence
from ..plans.store import EvidenceStore


def response_stream(evidence: Evidence, source: str, files_per_batch: int | None = None) -> DataFrame:
    """Archived responses as they arrive: Parquet files in ``source``."""
    reader = evidence.spark.readStream.schema(RESPONSES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source)


def run_feed(evidence: Evidence, feed: ChangeFeed, responses: DataFrame, checkpoint: str,
             after_batch: Callable[[int], None] | None = None, stream: str = "stream", **trigger) -> StreamingQuery:
    """Archive each micro-batch, extract its claims and publish what changed; streams need names of their own."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream}-{batch_id}"
        evidence.archive(batch, name)
        feed.sync(name, archived=name)
        if after_batch:
            after_batch(batch_id)

    writer = responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_cycles(evidence: Evidence, feed: ChangeFeed, responses: DataFrame, checkpoint: str, store: EvidenceStore,
               subscriptions: Subscriptions, watched: Iterable[tuple[str, str]], **trigger) -> StreamingQuery:
    """The feed, then an evaluation of each watched (consumer, subscription) per micro-batch."""
    pairs = list(watched)

    def evaluate(_: int) -> None:
        for consumer, subscription in pairs:
            subscriptions.evaluate(consumer, subscription, store, evidence)

    return run_feed(evidence, feed, responses, checkpoint, evaluate, **trigger)
