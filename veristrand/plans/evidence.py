"""The archive of provider responses with its claims, and the feed over them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import feed as feeds
from ..operators.paging import after_cursor, page
from .tables import Tables

JOBS = ("job_id bigint, provider string, subject string, status string, attempts int, due double, "
        "lease double, error string")
LINKS = "profile_id string, provider string, subject string"
RESPONSES = ("response_id bigint, job_id bigint, observed double, url string, sha256 string, raw binary, "
             "parser_version string")
CLAIMS = "response_id bigint, subject string, predicate string, value string, pos bigint"
HEADS = "job_id bigint, response_id bigint, folder string"
COMMITS = "number bigint, batch string, folder string, last_sequence bigint, events bigint"
EVENTS = (
    "sequence bigint, job_id bigint, response_id bigint, predicate string, kind string, provider string, "
    "subject string, before array<string>, after array<string>, source string, observed_at double, "
    "previous_response_id bigint, sha256 string, meaning string, folder string"
)


class Evidence:
    """Jobs, links, responses and claims as Parquet tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.tables.read(table, schema=schema + ", batch string").drop("batch")

    def jobs(self) -> DataFrame:
        return self._read("jobs", JOBS)

    def links(self) -> DataFrame:
        return self._read("links", LINKS).distinct()

    def responses(self) -> DataFrame:
        return self._read("responses", RESPONSES)

    def claims(self) -> DataFrame:
        return self._read("claims", CLAIMS)

    def add(self, table: str, rows: DataFrame, batch: str | None = None) -> None:
        """Add rows as one batch folder; the same batch name again replaces it."""
        self.tables.write(rows, table, f"batch={batch or uuid.uuid4().hex}", mode="overwrite")

    def archive(self, responses: DataFrame, batch: str | None = None) -> None:
        """Keep responses as received, then the claims of those that can be read."""
        batch = batch or uuid.uuid4().hex
        self.add("responses", responses, batch)
        kept = self.spark.read.schema(RESPONSES).parquet(self.tables.path("responses", f"batch={batch}"))
        self.add("claims", C.extract_claims(C.parse_responses(kept, self.jobs())), batch)

    def search(self, query: str = "", limit: int = 50, offset: int = 0) -> dict:
        found = C.search_claims(self.responses(), self.claims(), query)
        return {"total": found.count(),
                "claims": page(found, [F.desc("response_id"), F.col("pos")], limit, offset)}

    def transitions(self, institutions: list[str]) -> DataFrame:
        return C.movement_candidates(self.jobs(), self.responses(), self.claims(), institutions)

    def stats(self, now: float) -> dict:
        return C.job_stats(self.jobs(), self.responses(), self.claims(), now)

    def high_water(self) -> int:
        return self.responses().agg(F.coalesce(F.max("response_id"), F.lit(0))).first()[0]


class ChangeFeed:
    """Pull-based feed. A batch, named by its source, counts once its numbered commit is claimed.

    Commit *n* is a file that only one writer can create. Whoever finds it taken has compared with
    heads and numbers that are no longer the last: its folder is removed and it compares again. So
    numbers are given once and without gaps, whether plain calls, streams or both publish, and
    what a stopped writer left behind is seen by nobody.
    """

    def __init__(self, evidence: Evidence):
        self.evidence, self.tables = evidence, evidence.tables

    def commits(self) -> DataFrame:
        return self.tables.lines("feed_commits", schema=COMMITS)

    def _committed(self, table: str, schema: str) -> DataFrame:
        return self._published(table, schema).join(self.commits().select("folder"), "folder", "left_semi")

    def _published(self, table: str, schema: str) -> DataFrame:
        """The folders named by :meth:`sync`; whatever else lies beside them was never committed."""
        return self.tables.read(table, "folder=*", schema=schema, base=(table,))

    def heads(self) -> DataFrame:
        return self._committed("feed_heads", HEADS).groupBy("job_id").agg(F.max("response_id").alias("response_id"))

    def events(self) -> DataFrame:
        return self._committed("feed_events", EVENTS)

    def sync(self, batch: str | None = None, archived: str | None = None) -> int:
        """Publish changes of responses past the heads; returns how many.

        A ``batch`` name makes the call repeatable: once committed it only reports what it
        published. ``archived`` names the batch of responses whose jobs alone are compared.
        """
        batch = batch or f"sync-{uuid.uuid4().hex}"
        while True:
            done = self.commits().agg(
                F.coalesce(F.max("number"), F.lit(0)).alias("number"), F.coalesce(F.max("last_sequence"), F.lit(0)).alias("last"),
                F.max(F.when(F.col("batch") == batch, F.col("events"))).alias("own")).first()
            if done.own is not None:
                return done.own
            folder = f"{batch}-{uuid.uuid4().hex}"
            count = self._compare(folder, done.last, archived)
            if count is None:
                return 0
            commit = {"number": done.number + 1, "batch": batch, "folder": folder, "last_sequence": done.last + count, "events": count}
            if self.tables.claim(json.dumps(commit), "feed_commits", f"{done.number + 1:020d}.json"):
                return count
            for table in ("feed_events", "feed_heads"):
                self.tables.remove(table, f"folder={folder}")

    def _compare(self, folder: str, last: int, archived: str | None) -> int | None:
        """Write what changed since the heads into a folder nobody reads yet; how many events, or None if no head moved."""
        responses, claims = self.evidence.responses(), self.evidence.claims()
        if archived is not None:
            fresh = self.tables.read("responses", f"batch={archived}", schema=RESPONSES).select("job_id").distinct()
            responses = responses.join(fresh, "job_id", "left_semi")
        pending = feeds.pending_responses(responses, claims, self.heads()).persist()
        try:
            moved = feeds.new_heads(pending)
            if moved.isEmpty():
                return None
            changes = feeds.claim_changes(responses, claims, self.evidence.jobs(), pending)
            self.tables.write(feeds.sequenced(changes, last), "feed_events", f"folder={folder}")
            self.tables.write(moved, "feed_heads", f"folder={folder}")
        finally:
            pending.unpersist()
        return self._published("feed_events", EVENTS).filter(F.col("folder") == folder).count()

    def read(self, after: int = 0, limit: int = 100, sync: bool = True) -> dict:
        """Events past a cursor; without ``sync``, only what is published already, and nothing is written."""
        if sync and type(after) is int and after >= 0:
            self.sync()
        return after_cursor(self.events().drop("folder"), after, limit)
