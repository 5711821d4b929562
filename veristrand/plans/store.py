"""The evidence store: complete snapshots, their history, search and lookups.

Layout under the root, all Parquet:

    versions/snapshot_id=/kind=      every row of every snapshot, as read
    postings/snapshot_id=            (term, profile_id, tf), ranged by term
    lengths/snapshot_id=             tokens per profile
    changes/snapshot_id=             keys that differ from the snapshot before
    change_rows/snapshot_id=         the rows behind them
    snapshots/                       one row per published snapshot

A snapshot exists once its row is in ``snapshots``, which is written last. A
refresh that fails leaves folders no reader looks at.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.text import or_empty, query_words
from ..operators import diff, resolve, search
from ..operators.paging import check_page, page
from ..sources import exports
from .tables import Tables

ADAPTER = "jsonl-export-v1"
KINDS = tuple(exports.STREAMS)
SNAPSHOTS = (
    "sequence bigint, snapshot_id string, created_at string, adapter string, files map<string,string>, "
    "documents bigint, tokens bigint"
)
# The fields that make a record findable, in reading order.
PROFILE_TEXT = ("name", "organization", "role", "expertise", "regional_evidence", "geography_scope", "work_evidence")
RELATION_TEXT = ("relation", "object_name", "evidence")


class ImportRejected(ValueError):
    """An export broke its contract; nothing was published."""


def search_parts(profiles: DataFrame, relationships: DataFrame, credits: DataFrame | None = None) -> DataFrame:
    """(profile_id, text): one part per profile, one per resolved relationship and one per credit.

    A profile made from its credits has their lines as its expertise and as its evidence, so
    they count twice; parts add up, and no profile's credits ever meet in one row. ``credits`` are
    ``(profile_id, payload)`` as stored, or ``(profile_id, expertise, made)`` where they are not.
    """

    def text(names):
        doc = P.variant(F.col("payload"))
        return F.concat_ws(" ", *[or_empty(P.field(doc, n)) for n in names]).alias("text")

    parts = profiles.select("profile_id", text(PROFILE_TEXT)).unionByName(
        relationships.filter("profile_id IS NOT NULL").select("profile_id", text(RELATION_TEXT)))
    if credits is None:
        return parts
    if "payload" in credits.columns:
        read = F.from_json("payload", "expertise string, made boolean").alias("c")
        credits = credits.select("profile_id", read).select("profile_id", "c.expertise", "c.made")
    line = or_empty(F.col("expertise"))
    return parts.unionByName(credits.select(
        "profile_id", F.when(F.col("made"), F.concat_ws(" ", line, line)).otherwise(line).alias("text")))


class EvidenceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = Tables(spark, root)

    # --- publishing ---------------------------------------------------------

    def snapshots(self) -> DataFrame:
        return self.tables.read("snapshots", schema=SNAPSHOTS)

    def current(self):
        return self.snapshots().orderBy(F.desc("sequence")).first()

    def refresh(self, source: str) -> dict:
        """Publish a complete export. Rows missing from it are missing here only."""
        files = exports.content_hashes(self.spark, source)
        latest = self.current()
        if latest and latest.files == files:
            return {"status": "unchanged", "snapshot_id": latest.snapshot_id, "changes": {}}
        snapshot_id = uuid.uuid4().hex
        staged = self._stage(source, snapshot_id)
        self._check(staged)
        documents, tokens = self._publish_rows(staged, snapshot_id)
        counts = self._publish_changes(latest.snapshot_id if latest else None, snapshot_id)
        if exports.content_hashes(self.spark, source) != files:
            raise ImportRejected("Source files changed during import; retry with a stable export")
        self.tables.append_row(
            {"sequence": (latest.sequence if latest else 0) + 1, "snapshot_id": snapshot_id,
             "created_at": datetime.now(timezone.utc).isoformat(), "adapter": ADAPTER, "files": files,
             "documents": documents, "tokens": tokens}, SNAPSHOTS, "snapshots")
        self.tables.remove("staged", snapshot_id)
        return {"status": "refreshed", "snapshot_id": snapshot_id, "changes": counts}

    def _stage(self, source: str, snapshot_id: str) -> dict[str, DataFrame]:
        """Parse each stream once; later steps read the parsed columns."""
        staged = {}
        for kind, (file_name, _) in exports.STREAMS.items():
            rows = exports.read_stream(self.spark, f"{source}/{file_name}", kind)
            self.tables.write(rows, "staged", snapshot_id, kind)
            staged[kind] = self.tables.read("staged", snapshot_id, kind, schema=rows.schema)
        if exports.has_credits(self.spark, source):
            rows = exports.read_credits(self.spark, f"{source}/{exports.CREDITS}")
            self.tables.write(rows, "staged", snapshot_id, "credits")
            staged["credits"] = self.tables.read("staged", snapshot_id, "credits", schema=rows.schema)
        return staged

    def _check(self, staged: dict[str, DataFrame]) -> None:
        for kind, rows in staged.items():
            bad = rows.filter("reason IS NOT NULL").orderBy("pos").first()
            if bad:
                raise ImportRejected(f"{bad.file_name}: {bad.reason} in {bad.payload[:200]}")
        if staged["profiles"].isEmpty():
            raise ImportRejected("Snapshot must contain profiles")
        twice = resolve.duplicate_keys(staged["profiles"], "record_id").first()
        if twice:
            raise ImportRejected(f"Duplicate record ID {twice.record_id}")
        orphan = resolve.orphans(staged["observations"], staged["profiles"]).first()
        if orphan:
            raise ImportRejected(f"Evidence references unknown record {orphan.record_id}")
        if "credits" in staged:
            orphan = resolve.orphans(staged["credits"], staged["profiles"]).first()
            if orphan:
                raise ImportRejected(f"Credit references unknown record {orphan.record_id}")

    def _publish_rows(self, staged: dict[str, DataFrame], snapshot_id: str) -> tuple[int, int]:
        own = lambda frame: frame.withColumn("profile_id", F.col("record_id"))
        resolved = resolve.resolve(staged["relationships"], staged["profiles"], staged["observations"])
        frames = {"profiles": own(staged["profiles"]), "observations": own(staged["observations"]),
                  "relationships": resolved}
        for kind, frame in frames.items():
            doc = P.variant(F.col("payload"))
            extra = [F.col("unknown_subject")] if kind == "relationships" else []
            rows = frame.withColumn("fingerprint", P.comparable(F.col("profile_id"), doc)).select(
                "pos", "profile_id", "collector", "record_key", "fingerprint", "payload", *extra)
            # Ranged by profile, so that a lookup of one profile reads few row groups.
            rows = rows.repartitionByRange("profile_id", "pos").sortWithinPartitions("profile_id", "pos")
            self.tables.write(rows, "versions", f"snapshot_id={snapshot_id}", f"kind={kind}")
        if not self._kind("relationships", snapshot_id).filter("unknown_subject").isEmpty():
            raise ImportRejected("Relationship references unknown source record")
        if "credits" in staged:
            rows = own(staged["credits"]).select("pos", "profile_id", "payload")
            rows = rows.repartitionByRange("profile_id", "pos").sortWithinPartitions("profile_id", "pos")
            self.tables.write(rows, "credits", f"snapshot_id={snapshot_id}")
        parts = self._parts(snapshot_id)
        index = search.postings(parts).repartitionByRange("term", "profile_id").sortWithinPartitions("term")
        self.tables.write(index, "postings", f"snapshot_id={snapshot_id}")
        self.tables.write(search.lengths(parts), "lengths", f"snapshot_id={snapshot_id}")
        sizes = self._lengths(snapshot_id).agg(
            F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        return sizes.documents, sizes.tokens

    def _publish_changes(self, previous_id: str | None, snapshot_id: str) -> dict:
        current = self._version(snapshot_id)
        previous = self._version(previous_id) if previous_id else current.limit(0)
        self.tables.write(diff.diff_versions(previous, current), "changes", f"snapshot_id={snapshot_id}")
        changes = self._changes(snapshot_id)
        self.tables.write(
            diff.change_rows(changes, previous, current).select(
                "kind", "record_key", "side", "pos", "profile_id", "payload"),
            "change_rows", f"snapshot_id={snapshot_id}")
        return {
            row.kind: {"added": row.added, "changed": row.changed, "removed": row.removed}
            for row in diff.change_counts(changes, KINDS).collect()
        }

    # --- stored tables ------------------------------------------------------

    def _kind(self, kind: str, snapshot_id: str) -> DataFrame:
        columns = ("pos bigint, profile_id string, collector string, record_key string, fingerprint string, "
                   "payload string")
        extra = ", unknown_subject boolean" if kind == "relationships" else ""
        return self.tables.read("versions", f"snapshot_id={snapshot_id}", f"kind={kind}", schema=columns + extra)

    def _credits(self, snapshot_id: str) -> DataFrame:
        return self.tables.read("credits", f"snapshot_id={snapshot_id}", schema="pos bigint, profile_id string, payload string")

    def _parts(self, snapshot_id: str) -> DataFrame:
        return search_parts(
            self._kind("profiles", snapshot_id), self._kind("relationships", snapshot_id), self._credits(snapshot_id))

    def _version(self, snapshot_id: str) -> DataFrame:
        frames = [self._kind(k, snapshot_id).drop("unknown_subject").withColumn("kind", F.lit(k)) for k in KINDS]
        return frames[0].unionByName(frames[1]).unionByName(frames[2])

    def _changes(self, snapshot_id: str) -> DataFrame:
        return self.tables.read(
            "changes", f"snapshot_id={snapshot_id}",
            schema="kind string, record_key string, change_type string, before_rows bigint, after_rows bigint")

    def _lengths(self, snapshot_id: str) -> DataFrame:
        return self.tables.read("lengths", f"snapshot_id={snapshot_id}", schema="profile_id string, length bigint")

    def _published(self, snapshot_id: str | None = None):
        row = self.snapshots().filter(F.col("snapshot_id") == snapshot_id).first() if snapshot_id else self.current()
        if row is None:
            raise KeyError(snapshot_id or "no snapshot published")
        return row

    def table(self, kind: str, snapshot_id: str | None = None) -> DataFrame:
        """profiles, observations or relationships of the current or a named snapshot."""
        return self._kind(kind, self._published(snapshot_id).snapshot_id)

    def credits(self, snapshot_id: str | None = None) -> DataFrame:
        """(profile_id, pos, payload): the credits that the profiles of a snapshot were made or enriched from."""
        return self._credits(self._published(snapshot_id).snapshot_id)

    # --- queries ------------------------------------------------------------

    def stats(self) -> dict:
        latest = self._published()
        counted = resolve.kind_counts(self._version(latest.snapshot_id)).collect()
        found = {row.kind: row for row in counted}
        counts = {kind: found[kind].n if kind in found else 0 for kind in KINDS}
        unresolved = found["relationships"].unresolved if "relationships" in found else 0
        return {**counts, "unresolved_relationships": unresolved, "snapshot": {
            "imported_at": latest.created_at, "adapter": latest.adapter, "files": latest.files,
            "snapshot_id": latest.snapshot_id}}

    def collectors(self) -> DataFrame:
        return resolve.collector_counts(self.table("profiles")).orderBy("collector")

    def unresolved(self, limit: int = 20, offset: int = 0) -> DataFrame:
        rows = self.table("relationships").filter("profile_id IS NULL").select(
            F.col("pos").alias("relationship_id"), F.col("payload").alias("evidence"))
        return page(rows, [F.col("relationship_id")], limit, offset)

    def history(self, limit: int = 20) -> DataFrame:
        return page(self.snapshots().drop("documents", "tokens"), [F.desc("sequence")], limit)

    def changes(self, snapshot_id: str, limit: int = 20, offset: int = 0) -> DataFrame:
        check_page(limit, offset)
        self._published(snapshot_id)
        return page(self._changes(snapshot_id), [F.col("kind"), F.col("record_key")], limit, offset)

    def change_rows(self, snapshot_id: str) -> DataFrame:
        """Before and after rows of every change of a snapshot."""
        self._published(snapshot_id)
        return self.tables.read(
            "change_rows", f"snapshot_id={snapshot_id}",
            schema="kind string, record_key string, side string, pos bigint, profile_id string, payload string")

    def profile(self, record_id: str, snapshot_id: str | None = None) -> DataFrame:
        """(kind, pos, payload): the profile, then its observations, relationships and credits."""
        published = self._published(snapshot_id)
        rows = self._version(published.snapshot_id).filter(F.col("profile_id") == record_id)
        if rows.filter("kind = 'profiles'").isEmpty():
            raise KeyError(record_id if snapshot_id is None else (snapshot_id, record_id))
        own = self._credits(published.snapshot_id).filter(F.col("profile_id") == record_id)
        rows = rows.select("kind", "pos", "payload").unionByName(own.select(F.lit("credits").alias("kind"), "pos", "payload"))
        rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "credits")]), F.col("kind"))
        return rows.orderBy(rank, "pos").select("kind", "pos", "payload")

    def scores(self, query: str) -> DataFrame:
        """(profile_id, score) of profiles holding every word of the query."""
        latest = self._published()
        phrases = search.query_phrases(query)
        if all(len(p) == 1 for p in phrases):
            index = self.tables.read(
                "postings", f"snapshot_id={latest.snapshot_id}", schema="term string, profile_id string, tf bigint")
            return search.search_index(
                index, self._lengths(latest.snapshot_id), latest.documents, latest.tokens, query)
        parts = self._parts(latest.snapshot_id)
        return search.search_texts(parts, query, "profile_id", "text")

    def profiles(self, collector: str | None = None) -> DataFrame:
        rows = self.table("profiles").select("profile_id", "collector", "payload")
        return (rows if collector is None else rows.filter(F.col("collector") == collector)).drop("collector")

    def matches(self, query: str = "", collector: str | None = None) -> DataFrame:
        """(profile_id, payload, score) of every match; a blank query matches all."""
        profiles = self.profiles(collector)
        if query_words(query):
            return profiles.join(self.scores(query), "profile_id")
        everyone = profiles.withColumn("score", F.lit(0.0))
        return everyone.limit(0) if query.strip() else everyone

    def search(self, query: str, limit: int = 20, collector: str | None = None) -> DataFrame:
        check_page(limit)
        found = self.matches(query, collector)
        if not query_words(query):
            found = found.limit(0)
        return found.orderBy(F.desc("score"), "profile_id").limit(limit)

    def browse(self, query: str = "", collector: str | None = None, offset: int = 0, limit: int = 30) -> dict:
        """The total and one page; ``profiles`` is a DataFrame."""
        check_page(limit, offset)
        found = self.matches(query, collector)
        return {"total": found.count(), "profiles": page(found, [F.desc("score"), F.col("profile_id")], limit, offset)}
