"""Typed claims from archived provider responses, and queries over the latest ones.

Inputs: ``jobs(job_id, provider, subject, ...)``, ``links(profile_id, provider,
subject)``, ``responses(response_id, job_id, observed, url, sha256, raw)``.
Claims are ``(response_id, subject, predicate, value, pos)`` with ``value`` as
canonical JSON text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.providers import PROVIDERS, endpoint
from ..functions.text import casefold
from ..functions.urls import tail

# Account fields that become self-reported claims, and what is kept of a repository.
ACCOUNT_FIELDS = ("name", "bio", "company", "location", "blog")
REPOSITORY_FIELDS = ("archived", "description", "html_url", "language", "name", "pushed_at", "topics")
REPOSITORY_PAGE = 100
REPOSITORY_SCOPE = "Most recently pushed owned public repositories"
TOPIC_BASIS = "Provider-assigned publication topic; not a verified skill"
MOVEMENT_STATUS = "later_affiliation_candidate"
MOVEMENT_LIMITATION = (
    "Later publication affiliation outside the supplied institution set; "
    "not proof of leaving a city, residence, or current employment."
)


def ascii_lower(value: Column) -> Column:
    """Lower-cases A–Z only, as the text search over claims does."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _json_or_null(value: Column) -> Column:
    return F.coalesce(P.canonical(value), F.lit("null"))


def _quoted(text: Column) -> Column:
    return P.canonical(text.cast("variant"))


def _object(**members: Column) -> Column:
    """Canonical JSON text of an object whose member texts are already canonical."""
    pieces = []
    for name in sorted(members):
        pieces += [F.lit(("," if pieces else "{") + f'"{name}":'), members[name]]
    return F.concat(*pieces, F.lit("}"))


def _items(doc: Column, name: str) -> Column:
    listed = F.try_variant_get(doc, f"$.{name}", "array<variant>")
    return F.coalesce(listed, F.array().cast("array<variant>"))


def _claim(predicate: str, value: Column) -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), value.alias("value"))


def _one(predicate: str, value: Column, when: Column | None = None) -> Column:
    entry = F.array(_claim(predicate, value))
    return entry if when is None else F.when(when, entry).otherwise(F.array().cast(_ENTRIES))


_ENTRIES = "array<struct<predicate:string,value:string>>"


def _author(doc: Column) -> Column:
    institution = lambda a: tail(P.field(a, "institution.id"))
    return F.concat(
        _one("name", _json_or_null(P.part(doc, "display_name"))),
        _one("provider_orcid", _json_or_null(P.part(doc, "orcid")), P.is_present(doc, "orcid")),
        F.transform(_items(doc, "affiliations"), lambda a: _claim("publication_affiliation", _object(
            institution_id=_quoted(institution(a)), name=_json_or_null(P.part(a, "institution.display_name")),
            years=F.coalesce(P.canonical(P.part(a, "years")), F.lit("[]"))))),
        F.transform(_items(doc, "last_known_institutions"), lambda i: _claim("latest_publication_institution", _object(
            institution_id=_quoted(tail(P.field(i, "id"))), name=_json_or_null(P.part(i, "display_name"))))),
        F.transform(_items(doc, "topics"), lambda t: _claim("research_topic", _object(
            basis=F.lit(f'"{TOPIC_BASIS}"'), id=_json_or_null(P.part(t, "id")),
            name=_json_or_null(P.part(t, "display_name")), work_count=_json_or_null(P.part(t, "count"))))),
    )


def _institution(doc: Column) -> Column:
    return _one("institution_location", _object(
        geo=F.coalesce(P.canonical(P.part(doc, "geo")), F.lit("{}")),
        name=_json_or_null(P.part(doc, "display_name")), ror=_json_or_null(P.part(doc, "ror"))))


def _account(doc: Column) -> Column:
    return F.concat(
        *[_one(f"self_reported_{f}", _json_or_null(P.part(doc, f)), P.is_present(doc, f)) for f in ACCOUNT_FIELDS],
        _one("github_id", _json_or_null(P.part(doc, "id"))))


def _repository_list(doc: Column) -> Column:
    return F.try_variant_get(doc, "$", "array<variant>")


def _repositories(doc: Column) -> Column:
    listed = _repository_list(doc)
    own = F.filter(listed, lambda r: ~P.is_present(r, "fork"))
    return F.concat(
        _one("repository_coverage", _object(
            complete=(F.size(listed) < REPOSITORY_PAGE).cast("string"), limit=F.lit(str(REPOSITORY_PAGE)),
            received=F.size(listed).cast("string"), scope=F.lit(f'"{REPOSITORY_SCOPE}"'))),
        F.transform(own, lambda r: _claim("public_repository", F.to_json(
            P.cast(r, ",".join(f"{f}:variant" for f in REPOSITORY_FIELDS)), {"ignoreNullFields": "false"}))))


def _all_have(items: Column, test) -> Column:
    return F.coalesce(F.forall(items, lambda i: F.coalesce(test(i), F.lit(False))), F.lit(False))


def _error(provider: Column, subject: Column, doc: Column) -> Column:
    """The class of the first problem; NULL when the response can be used whole."""
    same_id = P.is_object(doc) & (tail(F.coalesce(P.field(doc, "id"), F.lit(""))) == subject)
    scholarly = provider.isin("openalex-author", "openalex-institution")
    affiliated = _all_have(_items(doc, "affiliations"), lambda a: P.field(a, "institution.id").isNotNull())
    latest_named = _all_have(_items(doc, "last_known_institutions"), lambda i: P.field(i, "id").isNotNull())
    latest_valid = _all_have(_items(doc, "last_known_institutions"),
                             lambda i: tail(P.field(i, "id")).rlike(PROVIDERS["openalex-institution"][0]))
    same_login = P.is_object(doc) & (F.lower(F.coalesce(P.field(doc, "login"), F.lit(""))) == F.lower(subject))
    owned = _all_have(_repository_list(doc), lambda r: F.lower(P.field(r, "owner.login")) == F.lower(subject))
    return (
        F.when(doc.isNull(), "JSONDecodeError")
        .when(scholarly & ~same_id, "ValueError")
        .when((provider == "openalex-author") & ~(affiliated & latest_named), "KeyError")
        .when((provider == "openalex-author") & ~latest_valid, "ValueError")
        .when((provider == "github-profile") & ~same_login, "ValueError")
        .when((provider == "github-profile") & P.part(doc, "id").isNull(), "KeyError")
        .when((provider == "github-repos") & ~owned, "ValueError")
        .when(~provider.isin(*PROVIDERS), "ValueError")
    )


def parse_responses(responses: DataFrame, jobs: DataFrame) -> DataFrame:
    """(response_id, job_id, provider, subject, doc, error); raw bytes stay in the archive."""
    owned = responses.select("response_id", "job_id", "raw").join(jobs.select("job_id", "provider", "subject"), "job_id")
    parsed = P.once(owned, "doc", P.variant(F.decode("raw", "UTF-8"))).drop("raw")
    return P.once(parsed, "error", _error(F.col("provider"), F.col("subject"), F.col("doc")))


def extract_claims(parsed: DataFrame) -> DataFrame:
    """All claims of usable responses; one bad part discards the whole response."""
    doc, provider = F.col("doc"), F.col("provider")
    entries = (
        F.when(provider == "openalex-author", _author(doc))
        .when(provider == "openalex-institution", _institution(doc))
        .when(provider == "github-profile", _account(doc))
        .when(provider == "github-repos", _repositories(doc))
    )
    return (
        parsed.filter("error IS NULL")
        .select("response_id", "subject", F.posexplode(entries).alias("pos", "claim"))
        .select("response_id", "subject", "claim.predicate", "claim.value", F.col("pos").cast("bigint").alias("pos"))
    )


def extraction_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("response_id", "job_id", "provider", "subject", "error")


def follow_ups(parsed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Institutions named by author responses that no job covers yet."""
    named = (
        parsed.filter("error IS NULL AND provider = 'openalex-author'")
        .select(F.explode(_items(F.col("doc"), "last_known_institutions")).alias("item"))
        .select(F.lit("openalex-institution").alias("provider"), tail(P.field(F.col("item"), "id")).alias("subject"))
        .distinct()
    )
    return named.join(jobs.select("provider", "subject"), ["provider", "subject"], "left_anti")


# --- latest claims ----------------------------------------------------------

def successful_responses(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """Responses with at least one claim; anything else is failed or still in flight."""
    return responses.join(claims.select("response_id"), "response_id", "left_semi")


def latest_responses(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """(job_id, response_id): the newest successful response of each job.

    ``max`` combines map-side; a job with most of the responses is no hot task.
    """
    return successful_responses(responses.select("response_id", "job_id"), claims).groupBy("job_id").agg(
        F.max("response_id").alias("response_id"))


def latest_claims(responses: DataFrame, claims: DataFrame) -> DataFrame:
    newest = latest_responses(responses, claims)
    sources = responses.select("response_id", "url", "observed", "sha256")
    return claims.join(newest, "response_id").join(sources, "response_id")


def search_claims(responses: DataFrame, claims: DataFrame, query: str = "") -> DataFrame:
    found = latest_claims(responses, claims)
    if query:
        wanted = ascii_lower(F.lit(query))
        found = found.filter(F.contains(ascii_lower(F.col("value")), wanted)
                             | F.contains(ascii_lower(F.col("subject")), wanted))
    return found


def matching_claims(links: DataFrame, jobs: DataFrame, responses: DataFrame, claims: DataFrame,
                    words: list[str]) -> DataFrame:
    """(profile_id, response_id, predicate, value, source, observed): every word in the same value.

    Claims are filtered before any join, so only hits travel.
    """
    hits = claims
    for word in words:
        hits = hits.filter(F.contains(ascii_lower(F.col("value")), F.lit(word.lower())))
    newest = latest_responses(responses, claims)
    owners = jobs.select("job_id", "provider", F.col("subject").alias("job_subject")).join(
        links.withColumnRenamed("subject", "job_subject"), ["provider", "job_subject"])
    return (
        hits.join(newest, "response_id")
        .join(responses.select("response_id", F.col("url").alias("source"), "observed"), "response_id")
        .join(owners.select("job_id", "profile_id"), "job_id")
        .select("profile_id", "response_id", "predicate", "value", "pos", "source", "observed")
    )


def movement_candidates(jobs: DataFrame, responses: DataFrame, claims: DataFrame, origins: list[str]) -> DataFrame:
    """Authors whose newest institutions lie outside ``origins`` and follow them strictly in time.

    Gathers per response only; a response is at most 10 MB.
    """
    if not origins or any(not re.fullmatch(r"I\d+", i) for i in origins):
        raise ValueError("Supply at least one origin OpenAlex institution ID")
    authors = jobs.filter(F.col("provider") == "openalex-author").select("job_id", F.col("subject").alias("author"))
    newest = latest_responses(responses, claims).join(authors, "job_id")
    read = P.cast(P.variant(F.col("value")), "institution_id:string,years:variant")
    affiliation = F.struct(
        "pos", F.col("value").alias("claim"), "v.institution_id",
        F.array_max(F.from_json(P.canonical(F.col("v.years")), "array<bigint>")).alias("last_year"))
    is_affiliation = F.col("predicate") == "publication_affiliation"
    is_latest = F.col("predicate") == "latest_publication_institution"
    wanted = claims.filter(F.col("predicate").isin("name", "publication_affiliation", "latest_publication_institution"))
    gathered = (
        P.once(wanted.join(newest, "response_id"), "v", read)
        .groupBy("response_id", "author")
        .agg(
            F.array_sort(F.collect_list(F.when(is_affiliation, affiliation))).alias("affiliations"),
            F.collect_set(F.when(is_latest, F.col("v.institution_id"))).alias("latest"),
            F.min_by(F.when(F.col("predicate") == "name", F.col("value")),
                     F.when(F.col("predicate") == "name", F.col("pos"))).alias("name"))
    )
    home = F.array(*[F.lit(i) for i in origins])
    prior = F.filter("affiliations", lambda a: F.array_contains(home, a["institution_id"]) & a["last_year"].isNotNull())
    later = F.filter("affiliations", lambda a: F.array_contains(F.col("latest"), a["institution_id"])
                     & (a["last_year"] > F.col("last_origin_year")))
    texts = lambda items: F.transform(items, lambda a: a["claim"])
    return (
        gathered.withColumn("prior", prior)
        .withColumn("last_origin_year", F.array_max(F.transform("prior", lambda a: a["last_year"])))
        .filter(F.col("last_origin_year").isNotNull() & ~F.arrays_overlap(F.col("latest"), home))
        .withColumn("later", later)
        .filter(F.size("later") > 0)
        .join(responses.select("response_id", "url", "observed", "sha256"), "response_id")
        .select(
            F.col("author").alias("subject"),
            F.coalesce(F.try_variant_get(P.variant(F.col("name")), "$", "string"), F.col("author")).alias("name"),
            F.lit(MOVEMENT_STATUS).alias("status"), texts(F.col("prior")).alias("prior"),
            texts(F.col("later")).alias("later"), "last_origin_year", "response_id", "url", "observed", "sha256",
            F.lit(MOVEMENT_LIMITATION).alias("limitation"))
    )


# --- jobs -------------------------------------------------------------------

def job_histogram(jobs: DataFrame, now: float) -> DataFrame:
    """Jobs per status, and those that are due."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("due") <= now).alias("due"))


def job_stats(jobs: DataFrame, responses: DataFrame, claims: DataFrame, now: float) -> dict:
    histogram = job_histogram(jobs, now).collect()
    errors = jobs.filter("error IS NOT NULL").select("job_id", "provider", "subject", "status", "error")
    return {
        "jobs": {r.status: r.jobs for r in histogram},
        "due": sum(r.due for r in histogram if r.status == "pending"),
        "responses": responses.count(), "claims": claims.count(),
        "errors": errors,
    }


def eligible_jobs(jobs: DataFrame, now: float, targets: DataFrame | None = None) -> DataFrame:
    """Pending jobs that are due and have attempts left, optionally within a target set."""
    ready = jobs.filter((F.col("status") == "pending") & (F.col("due") <= now) & (F.col("attempts") < 5))
    return ready if targets is None else ready.join(targets, ["provider", "subject"], "left_semi")


def raw_response(responses: DataFrame, response_id: int) -> DataFrame:
    found = responses.filter(F.col("response_id") == response_id).select("response_id", "raw", "sha256", "url")
    if found.isEmpty():
        raise KeyError(response_id)
    return found


def identifier_tasks(profiles: DataFrame) -> DataFrame:
    """(profile_id, position, provider, subject, missing, invalid): one row per usable task.

    ``external_ids`` may be an object or the JSON text of one. The first malformed
    identifier of a record marks it ``invalid`` and ends its list; records with no
    usable task keep one row without a provider.
    """
    doc = P.variant(F.col("payload"))
    stored = P.part(doc, "external_ids")
    text = F.coalesce(F.nullif(F.try_variant_get(doc, "$.external_ids", "string"), F.lit("")), F.lit("{}"))
    ids = F.when(P.is_object(stored), stored).otherwise(P.variant(text))
    named = lambda name: F.schema_of_variant(P.part(F.col("ids"), name)) == "STRING"
    scholarly, coded = P.is_present(F.col("ids"), "openalex"), P.is_present(F.col("ids"), "github")
    author, account = tail(P.field(F.col("ids"), "openalex")), casefold(P.field(F.col("ids"), "github"))
    task = lambda provider, subject: F.struct(
        F.lit(provider).alias("provider"), subject.alias("subject"),
        endpoint(F.lit(provider), subject).isNotNull().alias("ok"))
    none = F.array().cast(_TASKS)
    listed = F.concat(
        F.when(scholarly, F.array(task("openalex-author", author))).otherwise(none),
        F.when(coded, F.array(task("github-profile", account), task("github-repos", account))).otherwise(none))
    readable = P.is_object(F.col("ids")) & (~scholarly | named("openalex")) & (~coded | named("github"))
    first_bad = F.array_position(F.transform("tasks", lambda t: t["ok"]), False)
    usable = F.when(first_bad > 0, F.slice("tasks", F.lit(1), F.greatest(first_bad - 1, F.lit(0)).cast("int"))).otherwise(F.col("tasks"))
    return (
        P.once(profiles.select("profile_id", "payload"), "ids", ids).drop("payload")
        .select("profile_id", readable.alias("readable"), F.when(readable, listed).otherwise(none).alias("tasks"))
        .select("profile_id", (F.col("readable") & (F.size("tasks") == 0)).alias("missing"),
                (~F.col("readable") | (first_bad > 0)).alias("invalid"), F.posexplode_outer(usable).alias("position", "task"))
        .select("profile_id", "position", "task.provider", "task.subject", "missing", "invalid")
    )


_TASKS = "array<struct<provider:string,subject:string,ok:boolean>>"


def new_links(links: DataFrame, tasks: DataFrame) -> DataFrame:
    """Links not known yet, each once."""
    keys = ["profile_id", "provider", "subject"]
    return tasks.select(*keys).dropDuplicates().join(links, keys, "left_anti")


def seed_tasks(profiles: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """The identifier tasks that no job covers yet, all or the first ``limit`` in profile order."""
    if limit is not None and limit < 1:
        raise ValueError("Seed limit must be positive")
    tasks = identifier_tasks(profiles).filter("provider IS NOT NULL")
    first = tasks.groupBy("provider", "subject").agg(F.min(F.struct("profile_id", "position")).alias("first"))
    fresh = first.join(jobs.select("provider", "subject"), ["provider", "subject"], "left_anti")
    tasks = fresh.select("first.profile_id", "first.position", "provider", "subject")
    return tasks if limit is None else tasks.orderBy("profile_id", "position").limit(limit)
