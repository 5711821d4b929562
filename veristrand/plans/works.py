"""The archive of work batches and the merged export made from it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..operators import works as W
from ..operators.content import content_digest
from ..session import checkpointed
from ..sources import batches
from .store import EvidenceStore
from .tables import Tables

#: Up to so many new files their paths are sent to every task; beyond, contents are shuffled once.
TOLD_PATHS = 50_000
RUNS = "sequence bigint, run_id string, lane string, manifest string"
ARTIFACTS = "sha256 string, bytes binary"
RUN_ARTIFACTS = "run_id string, path string, sha256 string"
WORKS = "run_id string, id string, pos bigint, payload string"
CREDITS = "run_id string, work_id string, id string, pos bigint, payload string"


class Works:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)

    def runs(self) -> DataFrame:
        return self.tables.read("runs", schema=RUNS)

    def _of_runs(self, table: str, schema: str) -> DataFrame:
        """Rows of finished runs; the run row is written last."""
        return self.tables.read(table, schema=schema).join(self.runs().select("run_id"), "run_id", "left_semi")

    def works(self) -> DataFrame:
        return self._of_runs("works", WORKS)

    def contributions(self) -> DataFrame:
        return self._of_runs("contributions", CREDITS)

    def artifacts(self) -> DataFrame:
        return self.tables.read("artifacts", schema=ARTIFACTS)

    def run_artifacts(self) -> DataFrame:
        return self._of_runs("run_artifacts", RUN_ARTIFACTS)

    def ingest(self, directory: str) -> dict:
        """Archive a batch whole or not at all; the same batch twice changes nothing."""
        manifest = batches.read_manifest(self.spark, directory)
        works = batches.read_rows(self.spark, directory, "works")
        credits = batches.read_rows(self.spark, directory, "contributions")
        W.check_manifest(manifest, works.count(), credits.count())
        files = batches.read_artifacts(self.spark, directory)
        hashes = checkpointed(files.select("path", "sha256"))
        for problems in (W.work_problems(works, hashes), W.credit_problems(credits, works)):
            first = problems.orderBy("pos").first()
            if first:
                raise ValueError(first.problem)
        referenced = works.select(batches.clean_path(P.field(F.col("doc"), "raw_path")).alias("path")).distinct()
        kept = hashes.filter(F.startswith("path", F.lit("raw/"))).unionByName(
            hashes.join(referenced, "path", "left_semi")).distinct()
        digests = [content_digest(works.withColumn("c", P.canonical(F.col("doc"))), "pos", "c"),
                   content_digest(credits.withColumn("c", P.canonical(F.col("doc"))), "pos", "c"),
                   content_digest(kept, "path", "sha256")]
        text = json.dumps([manifest, digests], sort_keys=True, ensure_ascii=False)
        run_id = hashlib.sha256(text.encode()).hexdigest()
        counts = {"works": manifest["works"], "contributions": manifest["contributions"]}
        if not self.runs().filter(F.col("run_id") == run_id).isEmpty():
            return {"run_id": run_id, "status": "unchanged", **counts}
        doc = F.col("doc")
        # Decided on hashes; only the chosen files' contents are then read, and never shuffled.
        chosen = kept.groupBy("sha256").agg(F.min("path").alias("path")).join(
            self.artifacts().select("sha256"), "sha256", "left_anti").select("path")
        chosen = F.broadcast(chosen) if chosen.count() <= TOLD_PATHS else chosen
        new_files = files.join(chosen, "path", "left_semi")
        self.tables.write(new_files.select("sha256", F.col("content").alias("bytes")), "artifacts", mode="append")
        self.tables.write(kept, "run_artifacts", f"run_id={run_id}", mode="overwrite")
        self.tables.write(works.select(P.field(doc, "id").alias("id"), "pos", "payload"), "works", f"run_id={run_id}", mode="overwrite")
        self.tables.write(
            credits.select(P.field(doc, "work_id").alias("work_id"), P.digest(P.canonical(doc)).alias("id"), "pos", "payload"),
            "contributions", f"run_id={run_id}", mode="overwrite")
        sequence = self.runs().agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0] + 1
        self.tables.append_row({"sequence": sequence, "run_id": run_id, "lane": manifest["lane"],
                                "manifest": json.dumps(manifest, sort_keys=True, ensure_ascii=False)}, RUNS, "runs")
        return {"run_id": run_id, "status": "imported", **counts}

    def stats(self) -> dict:
        return {"runs": self.runs().count(), "works": self.works().count(),
                "contributions": self.contributions().count(), "artifacts": self.artifacts().count()}

    def credits(self) -> DataFrame:
        """(run, pos, lane, work, credit): every archived credit beside its work."""
        works = self.works().select("run_id", F.col("id").alias("work_id"), F.col("payload").alias("work"))
        runs = self.runs().select("run_id", F.col("sequence").alias("run"), "lane")
        return (
            self.contributions().join(works, ["run_id", "work_id"]).join(runs, "run_id")
            .select("run", "pos", "lane", "work", F.col("payload").alias("credit"))
        )

    def export(self, store: EvidenceStore, output: str) -> dict:
        """Write a complete export: the store's records plus records made from credits.

        Credits group by source identity only. Records made by an earlier export
        are rebuilt, not added again. Each stream is a folder of JSON lines; a profile
        row holds what its credits add up to, and ``credits`` holds them all, by profile; a store
        that refreshes from the export finds profiles by the texts of their credits.
        """
        unknown = self.runs().filter(~F.col("lane").isin(*W.COLLECTORS)).first()
        if unknown:
            raise KeyError(unknown.lane)
        base = {kind: store.table(kind).filter(~W.is_generated(F.col("payload"))) for kind in
                ("profiles", "observations", "relationships")}
        people = base["profiles"].select(F.col("profile_id").alias("record_id"), W.stripped(F.col("payload")).alias("payload"))
        entries = checkpointed(W.with_fields(W.collapsed_credits(self.credits(), people)))
        rolled = W.rolled_up(entries)
        merged = checkpointed(W.merged_people(people, rolled))
        kept = lambda kind: base[kind].select("payload")
        streams = {
            "people": merged.select("payload"),
            "evidence": kept("observations").unionByName(W.credit_observations(entries).select("payload")),
            "connections": kept("relationships").unionByName(W.credit_relationships(entries, rolled).select("payload")),
            "credits": W.credit_rows(entries, merged).select("payload"),
        }
        counts = {}
        for name, rows in streams.items():
            rows.write.mode("errorifexists").text(f"{output}/{name}.jsonl")
            counts[name] = self.spark.read.text(f"{output}/{name}.jsonl").count()
        origins = {r.origin: r.n for r in merged.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {**counts, "work_profiles": origins.get("new", 0) + origins.get("enriched", 0),
                "new_work_profiles": origins.get("new", 0), "enriched_existing_profiles": origins.get("enriched", 0),
                "archive": self.stats()}
