"""Named queries for positions, extraction, reviews, qualification and names."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import names as N
from ..operators import claims as C
from ..operators import membership
from ..operators import reconcile as R
from ..session import checkpoint_dir
from ..sources import exports
from ..sources.datasets import prepared
from .catalog import Catalog
from .core_queries import ALL_NAMES_SQL, BEST_NAMES, RECONCILE_SQL, _datasets
from .store import search_parts

catalog = Catalog()
query = catalog.add


@query("export_positions", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders""")
def export_positions(table):
    """Orders written as an export of several files of JSON lines: every line has its place in all of them."""
    orders = table("orders").select("o_orderkey", "o_orderstatus")
    path = f"{checkpoint_dir(orders.sparkSession)}/export-{uuid.uuid4().hex}"
    orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select(
        F.to_json(F.struct("*")).alias("value")).write.text(path)
    lines = exports.json_lines(orders.sparkSession, path)
    return lines.select(F.get_json_object("payload", "$.o_orderkey").cast("long").alias("o_orderkey"), "pos")


def _accounts(table):
    """Customers as account profiles: some no JSON, some of another account, some without an id."""
    login = F.when(F.col("c_nationkey") == 1, "someone").otherwise(F.concat(F.lit("C"), "c_custkey"))
    number = F.when(F.col("c_nationkey") != 2, F.col("c_custkey"))
    bio = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))
    body = F.to_json(F.struct(login.alias("login"), number.alias("id"), bio.alias("bio")))
    raw = F.when(F.col("c_nationkey") == 0, "{not json").otherwise(body)
    rows = table("customer")
    responses = rows.select(
        F.col("c_custkey").alias("response_id"), F.col("c_custkey").alias("job_id"), raw.cast("binary").alias("raw"))
    jobs = rows.select(
        F.col("c_custkey").alias("job_id"), F.lit("github-profile").alias("provider"), F.concat(F.lit("c"), "c_custkey").alias("subject"))
    return C.parse_responses(responses, jobs)


@query("extracted_claims", """
SELECT c_custkey AS response_id, 'c' || c_custkey AS subject, 'github_id' AS predicate, c_custkey::VARCHAR AS value
FROM customer WHERE c_nationkey > 2
UNION ALL SELECT c_custkey, 'c' || c_custkey, 'self_reported_bio', '"' || c_mktsegment || '"' FROM customer
WHERE c_nationkey > 2 AND c_nationkey % 2 = 0""")
def extracted_claims(table):
    return C.extract_claims(_accounts(table)).select("response_id", "subject", "predicate", "value")


@query("discarded_responses", """
SELECT c_custkey AS response_id, CASE c_nationkey WHEN 0 THEN 'JSONDecodeError' WHEN 1 THEN 'ValueError' ELSE 'KeyError' END AS error
FROM customer WHERE c_nationkey < 3""")
def discarded_responses(table):
    return C.extraction_errors(_accounts(table)).select("response_id", "error")


@query("search_documents", """
SELECT c_custkey::VARCHAR AS profile_id, md5(concat_ws(' ', c_name, '', c_mktsegment, '', '', '', '')) AS text FROM customer
UNION ALL SELECT o_custkey::VARCHAR, md5(concat_ws(' ', o_orderstatus, o_orderpriority, '')) FROM orders""")
def search_documents(table):
    text = lambda c: F.col(c).cast("string")
    people = table("customer").select(text("c_custkey").alias("profile_id"), F.to_json(
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))).alias("payload"))
    ties = table("orders").select(text("o_custkey").alias("profile_id"), F.to_json(
        F.struct(F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("object_name"))).alias("payload"))
    return search_parts(people, ties).select("profile_id", F.md5("text").alias("text"))


VERDICTS = ("same", "different", "unsure")


def _reviews(left, right):
    """A review of every customer and supplier of one number; those of every seventh saw another record."""
    own = lambda d, side: prepared(d).select(
        F.col("record_id").alias(f"{side}_id"), F.col("record_id").alias("number"), F.col("fingerprint").alias(f"{side}_fingerprint"))
    number = F.col("number").cast("long")
    rows = own(left, "left").join(own(right, "right"), "number")
    seen = F.when(number % 7 == 0, F.lit("another")).otherwise(F.col("left_fingerprint"))
    return rows.select(
        number.alias("sequence"), F.col("number").alias("review_id"), F.lit("run").alias("run_id"),
        F.lit(left.dataset_id).alias("left_dataset"), "left_id", F.lit(right.dataset_id).alias("right_dataset"), "right_id",
        seen.alias("left_fingerprint"), "right_fingerprint",
        F.get(F.array(*[F.lit(v) for v in VERDICTS]), (number % 3).cast("int")).alias("verdict"),
        F.lit("reviewer").alias("reviewer"), F.lit("reason").alias("reason"), F.lit("2026").alias("created_at"))


@query("reviewed_pairs", """
SELECT s_suppkey::VARCHAR AS left_id, s_suppkey::VARCHAR AS right_id,
       CASE WHEN s_suppkey % 7 = 0 THEN 'possible_match' WHEN s_suppkey % 3 = 0 THEN 'matched'
            WHEN s_suppkey % 3 = 1 THEN 'rejected' ELSE 'possible_match' END AS status,
       s_suppkey % 7 = 0 AS stale
FROM supplier JOIN customer ON c_custkey = s_suppkey""")
def reviewed_pairs(table):
    left, right = _datasets(table)
    pairs = R.reconcile(left, right, _reviews(left, right)).pairs
    return pairs.filter("left_id = right_id").select(
        "left_id", "right_id", "status", F.exists("evidence", lambda e: e["type"] == "stale_review").alias("stale"))


BEST_SQL = """
SELECT left_id, right_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY status, score DESC, right_id) AS n FROM pairs) WHERE n = 1"""


def _first_candidates(pairs):
    first = F.row_number().over(Window.partitionBy("left_id").orderBy(*R.candidate_order()))
    return pairs.withColumn("n", first).filter("n = 1").select("left_id", "right_id", "status")


@query("best_candidates", RECONCILE_SQL + BEST_SQL)
def best_candidates(table):
    return _first_candidates(R.reconcile(*_datasets(table), best_names=BEST_NAMES).pairs)


@query("best_of_all_candidates", ALL_NAMES_SQL + BEST_SQL)
def best_of_all_candidates(table):
    return R.best_pairs(R.reconcile(*_datasets(table))).select("left_id", "right_id", "status")


@query("moved_members", """
SELECT c_custkey::VARCHAR AS profile_id, 'A' || c_nationkey AS subject, 1::BIGINT AS candidates
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def moved_members(table):
    """Only profiles linked to a movement candidate qualify."""
    text = lambda c: F.col(c).cast("string")
    items = table("customer").select(text("c_custkey").alias("profile_id"))
    links = table("customer").select(
        text("c_custkey").alias("profile_id"), F.lit("openalex-author").alias("provider"), F.concat(F.lit("A"), "c_nationkey").alias("subject"))
    moved = table("nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("A"), "n_nationkey").alias("subject"), F.col("n_name").alias("name"), F.lit("s").alias("status"),
        F.array("n_name").alias("prior"), F.array("n_name").alias("later"), F.lit("l").alias("limitation"),
        F.lit("u").alias("url"), F.lit(1.0).alias("observed"), F.lit("h").alias("sha256"))
    found = membership.attach_movement(items, moved, links)
    return found.select("profile_id", F.get("movement_candidates", F.lit(0))["subject"].alias("subject"),
                        F.size("movement_candidates").cast("long").alias("candidates"))


@query("member_fingerprints", """
SELECT o_orderkey::VARCHAR AS profile_id, 1::BIGINT AS refetched, 2::BIGINT AS changed FROM orders""")
def member_fingerprints(table):
    """Distinct fingerprints of a record fetched twice, and of that record with another status."""
    def items(observed: str, status):
        return table("orders").select(
            F.col("o_orderkey").cast("string").alias("profile_id"), F.to_json(F.struct(
                "o_orderdate", status.alias("status"), F.lit(observed).alias("observed_at"))).alias("payload"),
            F.lit("basis").alias("match_basis"), F.lit(0).cast("long").alias("claims"), F.lit("").alias("claims_digest"),
            F.array().cast("array<string>").alias("enriched_matches"),
            F.lit(None).cast("struct<known:string,updated_at:double>").alias("workspace"),
            F.array().cast("array<struct<subject:string,name:string,status:string,prior:array<string>,later:array<string>,"
                           "limitation:string>>").alias("movement_candidates"))

    of = lambda frame, name: membership.fingerprinted(frame).select("profile_id", F.lit(name).alias("v"), "fingerprint")
    own, other = F.col("o_orderstatus"), F.concat(F.col("o_orderstatus"), F.lit("?"))
    versions = of(items("1", own), "a").unionByName(of(items("2", own), "b")).unionByName(of(items("1", other), "c"))
    return versions.groupBy("profile_id").agg(
        F.count_distinct(F.when(F.col("v") != "c", F.col("fingerprint"))).alias("refetched"),
        F.count_distinct("fingerprint").alias("changed"))


@query("published_days", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def published_days(table):
    stamp = F.concat(F.date_format("o_orderdate", "EEE, d MMM yyyy"), F.lit(" 12:00:00 GMT"))
    return table("orders").select("o_orderkey", dates.rfc822_date(stamp).alias("day"))


NAMES_SQL = """
WITH w AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS first,
                  upper(substr(n_name, 1, 1)) || translate(lower(substr(n_name, 2)), '_0123456789', 'abcdefghijk') AS last
           FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _named(table):
    nations = table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.translate(F.initcap("n_name"), "_0123456789", "abcdefghijk").alias("last"))
    return table("customer").join(nations, "c_nationkey").select("c_custkey", F.initcap("c_mktsegment").alias("first"), "last")


@query("name_pairs", NAMES_SQL + """
SELECT c_custkey, first || ' ' || last || '|Ada ' || last AS names FROM w WHERE last NOT LIKE '% %'""")
def name_pairs(table):
    both = F.concat(F.lit("Winners: "), "first", F.lit(" "), "last", F.lit(" and Ada "), "last", F.lit(", of nowhere"))
    return _named(table).filter(~F.contains("last", F.lit(" "))).select(
        "c_custkey", F.array_join(N.pair_names(both), "|").alias("names"))


@query("roster_members", NAMES_SQL + """
SELECT c_custkey, first || ' ' || last || '|Ada ' || last AS names FROM w""")
def roster_members(table):
    heading = F.concat("first", F.lit(" "), "last", F.lit(" | Ada "), "last", F.lit(" (Class of 2024) | Our Team | 42"))
    return _named(table).select("c_custkey", F.array_join(N.roster_names(heading), "|").alias("names"))
