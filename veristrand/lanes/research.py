"""Scholarly works, deposits, theses and lab rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import payload as P
from ..functions.dates import has_timezone
from ..functions.text import clean_html, compact_text, or_empty, sentence, squeeze
from ..functions.urls import last_segment, tail
from ..sources import pages as H
from .common import Lane, accumulate, identifiers, keep, no_identifiers

AUTHORSHIP = ("struct<author:struct<id:string,display_name:string,orcid:string>,author_position:string,"
              "institutions:array<struct<id:string>>>")
SCHOLARLY = (f"id:string,display_name:string,title:string,publication_year:string,publication_date:string,type:string,"
             f"authorships:array<{AUTHORSHIP}>")
DEPOSIT = ("id string, links struct<html:string,self:string>, metadata struct<title:string,publication_date:string,"
           "description:string,resource_type:struct<title:string,type:string>,"
           "creators:array<struct<name:string,affiliation:string,orcid:string>>>")
# Evidence texts, field lengths and the words that open or close a roster section.
GROUP_REASON = ("OpenAlex author entity matches a known institution or has an explicit group/consortium label; "
                "retained as unresolved rather than projected as a person.")
AMBIGUOUS_REASON = ("Browse text contains comma-separated creator text whose individual name boundaries are ambiguous; "
                    "preserved unresolved instead of splitting by guesswork.")
NO_TIME = "Cached response requires its original timezone-aware fetched_at"
WORK_TIE = "OpenAlex records author-level institutional affiliation(s) on this work: {listed}."
WORK_TEXT = "OpenAlex indexes this {kind}{from_year}."
AUTHOR_CREDIT = "OpenAlex authorship lists {name} with {institutions} on this work."
DEPOSIT_TIE = "Zenodo creator metadata lists this affiliation: {target}; named regional creator(s): {named}."
DEPOSIT_CREDIT = "Zenodo lists {name} as a creator with affiliation {affiliation}."
LISTING_CREDIT = "Repository metadata credits {name} as {role} on this thesis."
INDEX_CREDIT = "Thesis listing credits {name} as author of this item."
ROSTER_CREDIT = "Official lab page lists {name} as {role}."
ROSTER_TIE = "The page is published under the official {organization} research domain."
SECTION_WORDS = "team|member|alum|people|personnel|student|research assistant|director"
CLOSING_WORDS = "research|project|contact|about|publication|join|news|funding|program"


# --- sources ----------------------------------------------------------------

def institution_seed(lines: DataFrame, default_scope: str) -> DataFrame:
    """(institution_id, institution, scope), the last row per id, from ``lines(pos, doc)``."""
    doc = F.col("doc")
    rows = lines.select(
        tail(or_empty(P.field(doc, "openalex_id"))).alias("institution_id"), or_empty(P.field(doc, "display_name")).alias("institution"),
        F.coalesce(P.field(doc, "geography_scope"), F.lit(default_scope)).alias("scope"), "pos")
    return keep(rows.filter("institution_id != ''"), ["institution_id"], "pos", True).drop("pos")


def known_authors(people: DataFrame) -> DataFrame:
    """Distinct author ids of a people file, from identifiers or from a profile URL."""
    doc = F.col("doc")
    own = F.nullif(P.field(doc, "external_ids.openalex"), F.lit(""))
    url = F.when(F.startswith(or_empty(P.field(doc, "profile_url")), F.lit("https://openalex.org/A")), P.field(doc, "profile_url"))
    return people.select(last_segment(F.coalesce(own, url)).alias("author_id")).filter("author_id IS NOT NULL").distinct()


def cached_envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted (ord, observed, raw_sha256, raw_path, doc) per work, and rejected lines.

    A line is archived either way; without its original time and offset its works
    are not used.
    """
    doc = F.col("doc")
    stamped = lines.select(
        F.col("pos").alias("line"), "payload", "doc", P.field(doc, "fetched_at").alias("observed"),
        P.digest(F.col("payload")).alias("raw_sha256")).withColumn("raw_path", F.concat(F.lit("raw/cached-"), "raw_sha256", F.lit(".jsonl")))
    timed = F.coalesce(has_timezone(F.col("observed")), F.lit(False))
    works = stamped.filter(timed).select(
        "line", "observed", "raw_path", "raw_sha256",
        F.posexplode(F.from_json(P.canonical(P.part(doc, "response.results")), "array<variant>")).alias("n", "work"))
    accepted = works.select(F.struct("line", "n").alias("ord"), "observed", "raw_path", "raw_sha256", F.col("work").alias("doc"),
                            F.lit("cache").alias("origin"))
    return accepted, stamped.filter(~timed).select("line", "payload", F.lit(NO_TIME).alias("reason"))


# --- scholarly works --------------------------------------------------------

def abstract_text(index: Column) -> Column:
    """The text behind a token → positions map; one token per position."""
    placed = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(
        F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("at"), e["key"].alias("token"))))))
    # Beside its predecessor, so that each entry is looked at once.
    paired = F.arrays_zip(placed.alias("own"), F.concat(F.array(F.lit(None)), placed).alias("before"))
    first = F.filter(paired, lambda x: x["own"].isNotNull() & (x["before"].isNull() | (x["own"]["at"] != x["before"]["at"])))
    return or_empty(F.array_join(F.transform(first, lambda x: x["own"]["token"]), " "))


def inverted_index(documents: DataFrame, tokens: Column) -> DataFrame:
    """Documents with the token → positions map of their ``tokens`` as ``index``.

    Equal tokens lie side by side once a document's are sorted, so no token leaves its row.
    """
    placed = P.once(documents, "_placed", F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("at")))))
    own = F.col("_placed")
    paired = F.arrays_zip(own.alias("own"), F.concat(F.array(F.lit(None)), own).alias("before"))
    begins = lambda x: x["own"].isNotNull() & (x["before"].isNull() | (x["own"]["token"] != x["before"]["token"]))
    marked = P.once(placed, "_starts", F.array_compact(F.transform(paired, lambda x, i: F.when(begins(x), i))))
    end = lambda i: F.coalesce(F.get("_starts", i + 1), F.size(own))
    entries = F.transform("_starts", lambda start, i: F.struct(
        F.get(own, start)["token"].alias("token"),
        F.transform(F.slice(own, start + 1, end(i) - start), lambda p: p["at"]).alias("at")))
    return marked.withColumn("index", F.map_from_entries(entries)).drop("_placed", "_starts")


def scholarly_works(documents: DataFrame, institutions: DataFrame, scopes: tuple[str, ...]) -> Lane:
    """Works with a credited author at a listed institution.

    ``documents(ord, origin, observed, raw_path, raw_sha256, doc)``. Only authors who
    name a listed institution on that work are credited. A live record replaces a
    cached one; otherwise the first stays. ``scopes`` is in order of precedence.
    """
    indexed = documents.withColumn("index", F.from_json(
        P.canonical(P.part(F.col("doc"), "abstract_inverted_index")), "map<string,array<int>>"))
    typed = P.once(indexed, "w", P.cast(F.col("doc"), SCHOLARLY)).drop("doc").withColumn(
        "work_key", last_segment(or_empty(F.col("w.id")))).filter("work_key != ''").withColumn(
        "work_id", F.concat(F.lit("openalex:"), "work_key")).withColumn(
        "title", compact_text(F.coalesce(F.nullif(F.col("w.display_name"), F.lit("")), F.col("w.title")))).filter("title != ''")
    rank = F.when(F.col("origin") == "live", 0).otherwise(1)
    authors = (
        typed.select("work_id", "ord", rank.alias("rank"), F.col("w.id").alias("work_url"), F.posexplode("w.authorships").alias("at", "a"))
        .select("work_id", "ord", "rank", "work_url", "at", F.col("a.author.id").alias("person_url"),
                F.col("a.author.display_name").alias("name"), F.col("a.author.orcid").alias("orcid"),
                F.col("a.author_position").alias("position"),
                F.explode(F.array_distinct(F.transform("a.institutions", lambda i: last_segment(i["id"])))).alias("institution_id"))
        .filter("person_url != ''").join(institutions, "institution_id")
    )
    regional = authors.groupBy("work_id", "ord").agg(
        F.array_sort(F.collect_set(F.when(F.col("institution") != "", F.col("institution")))).alias("institutions"),
        F.collect_set("scope").alias("found"))
    scope = F.lit(scopes[-1])
    for name in reversed(scopes[:-1]):
        scope = F.when(F.array_contains("found", name), name).otherwise(scope)
    listed = F.array_join("institutions", "; ")
    year = or_empty(F.col("w.publication_year"))
    abstract = F.col("abstract")
    kind = F.coalesce(F.nullif(F.col("w.type"), F.lit("")), F.lit("publication"))
    generic = sentence(WORK_TEXT, kind=compact_text(kind), from_year=F.when(year != "", F.concat(F.lit(" from "), year)).otherwise(""))
    read = typed.join(regional, ["work_id", "ord"]).withColumn("abstract", abstract_text(F.col("index")))
    works = read.withColumn("abstract", compact_text(F.col("abstract"))).select(
        F.col("work_id").alias("id"), "title", kind.alias("kind"), F.col("w.id").alias("source_url"),
        F.col("observed").alias("observed_at"), F.coalesce(F.nullif(F.col("w.publication_date"), F.lit("")), year).alias("work_date"),
        listed.alias("organization"),
        sentence(WORK_TIE, listed=listed).alias("regional_evidence"),
        scope.alias("geography_scope"), F.when(abstract != "", abstract).otherwise(generic).alias("description"),
        "raw_path", "raw_sha256", F.struct(rank.alias("rank"), "ord").alias("ord"))
    placed = (
        authors.groupBy("work_id", "work_url", "ord", "rank", "at", "person_url", "name", "orcid", "position")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("institution_id", "institution"))),
                                      lambda i: i["institution"]), ", ").alias("institutions"))
        # Names are read once their author is known to be credited.
        .withColumns({"name": compact_text(F.col("name")), "position": squeeze(F.col("position"))}).filter("name != ''")
        .withColumn("plain", N.plain_words(F.col("name"))).withColumn("order", F.struct("ord", "at"))
    )
    known = institutions.select(N.plain_words(F.col("institution")).alias("plain")).filter("plain != ''").distinct()
    flagged = placed.join(known.withColumn("is_known", F.lit(True)), "plain", "left")
    group = F.coalesce("is_known", F.lit(False)) | N.is_group_author(F.col("name"))
    return Lane(
        keep(works, ["id"], "ord", False).drop("ord"), merged_authorships(flagged.filter(~group)),
        flagged.filter(group).select("work_id", "name", F.col("work_url").alias("source_url"), F.lit(GROUP_REASON).alias("reason")).distinct())


def merged_authorships(placed: DataFrame) -> DataFrame:
    """One credit per (work, author): first row, further institutions appended, first telling position.

    Equal institution texts collapse before anything is gathered.
    """
    told = (F.col("position") != "") & (F.col("position") != "middle")
    texts = placed.groupBy("work_id", "person_url", "institutions").agg(
        F.min("order").alias("order"), F.min_by(F.struct("name", "orcid", "work_url"), "order").alias("head"),
        F.min(F.when(told, F.struct("order", "position"))).alias("told"))
    merged = texts.groupBy("work_id", "person_url").agg(
        F.min_by("head", "order").alias("head"), F.min("told").alias("told"),
        F.array_sort(F.collect_list(F.struct("order", "institutions"))).alias("seen"))
    first = sentence(AUTHOR_CREDIT, name=F.col("head.name"), institutions=F.get("seen", F.lit(0))["institutions"])
    evidence = F.aggregate(F.slice("seen", F.lit(2), F.size("seen")), first, lambda text, s: F.when(
        F.contains(text, s["institutions"]), text).otherwise(F.concat(text, F.lit(" Also lists "), s["institutions"], F.lit("."))))
    role = F.when(F.col("told").isNotNull(), F.concat(F.lit("author ("), F.col("told.position"), F.lit(")"))).otherwise("author")
    return merged.select(
        "work_id", F.col("head.name").alias("name"), role.alias("role"), "person_url",
        identifiers(openalex=F.col("person_url"), orcid=F.col("head.orcid")).alias("identifiers"), evidence.alias("evidence"),
        F.col("head.work_url").alias("source_url"))


# --- deposits ---------------------------------------------------------------

def deposits(responses: DataFrame) -> Lane:
    """Deposit records with a creator at the response's ``target`` organization.

    ``responses(ord, target, scope, observed, raw_path, raw_sha256, doc)``.
    """
    hits = responses.select("ord", "target", "scope", "observed", "raw_path", "raw_sha256", F.posexplode(
        F.from_json(P.canonical(P.part(F.col("doc"), "hits.hits")), "array<variant>")).alias("at", "hit"))
    typed = P.once(hits, "r", P.typed(F.col("hit"), DEPOSIT)).drop("hit").withColumn(
        "ord", F.struct("ord", "at"))
    creators = F.filter(F.transform("r.metadata.creators", lambda c: F.struct(
        F.trim(F.regexp_replace(or_empty(c["name"]), r"\s+", " ")).alias("name"),
        F.trim(F.regexp_replace(or_empty(c["affiliation"]), r"\s+", " ")).alias("affiliation"), or_empty(c["orcid"]).alias("orcid"))),
        lambda c: F.contains(F.lower(c["affiliation"]), F.lower("target")))
    record = F.coalesce(F.nullif(F.col("r.id"), F.lit("")), F.col("r.links.self"), F.lit(""))
    rows = typed.withColumn("creators", creators).withColumn("record", record).withColumn(
        "title", compact_text(F.col("r.metadata.title"))).filter("size(creators) > 0 AND record != '' AND title != ''").withColumn(
        "work_id", F.concat(F.lit("zenodo:"), "record")).withColumn(
        "url", F.coalesce("r.links.html", F.concat(F.lit("https://zenodo.org/records/"), "record")))
    named = F.array_join(F.transform(F.filter("creators", lambda c: c["name"] != ""), lambda c: c["name"]), ", ")
    kind = F.coalesce("r.metadata.resource_type.title", "r.metadata.resource_type.type", F.lit("Zenodo record"))
    works = rows.select(
        F.col("work_id").alias("id"), "title", kind.alias("kind"), F.col("url").alias("source_url"), F.col("observed").alias("observed_at"),
        or_empty(F.col("r.metadata.publication_date")).alias("work_date"), F.col("target").alias("organization"),
        sentence(DEPOSIT_TIE, named=named).alias("regional_evidence"),
        F.col("scope").alias("geography_scope"), clean_html(F.col("r.metadata.description")).alias("description"),
        "raw_path", "raw_sha256", "ord")
    person = F.when(F.col("c.orcid") != "", F.concat(F.lit("https://orcid.org/"), "c.orcid")).otherwise("")
    credits = rows.select("work_id", "url", "ord", F.posexplode("creators").alias("nth", "c")).filter("c.name != ''").select(
        "work_id", F.col("c.name").alias("name"), F.lit("creator").alias("role"), person.alias("person_url"),
        identifiers(orcid=person).alias("identifiers"),
        sentence(DEPOSIT_CREDIT, name=F.col("c.name"), affiliation=F.col("c.affiliation")).alias("evidence"),
        F.col("url").alias("source_url"), F.struct("ord", "nth").alias("ord")).withColumn(
        "who", F.when(F.col("person_url") != "", F.col("person_url")).otherwise(F.col("name")))
    return accumulate(works, credits, credit_key=("work_id", "who"))


# --- theses -----------------------------------------------------------------

def thesis_listing(pages: DataFrame, site: str, prefix: str, organization: str, scope: str, regional: str) -> Lane:
    """Table rows of a repository listing: an item link, abstract, year and contributors with roles.

    ``pages(ord, html, observed, raw_path, raw_sha256)``.
    """
    row = pages.select("ord", "observed", "raw_path", "raw_sha256", F.posexplode(
        F.regexp_extract_all(or_empty(F.col("html")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("at", "row"))
    item = r'(?is)href="([^"]*institutionalPublicationPublicView\.action\?institutionalItemId=(\d+)[^"]*)"[^>]*>(.*?)</a>'
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    parsed = row.select(
        F.struct("ord", "at").alias("ord"), "observed", "raw_path", "raw_sha256", F.regexp_extract("row", item, 1).alias("href"),
        F.regexp_extract("row", item, 2).alias("number"), clean_html(F.regexp_extract("row", item, 3)).alias("title"), cells.alias("cells")
    ).filter("number != '' AND title != ''").withColumn("full", F.size("cells") >= 5).withColumn(
        "id", F.concat(F.lit(prefix + ":"), "number")).withColumn("source_url", F.concat(F.lit(site), "href"))
    cell = lambda i: F.when(F.col("full"), clean_html(F.get("cells", F.lit(i)))).otherwise("")
    year = cell(2)
    works = parsed.select(
        "id", "title", F.lit("thesis").alias("kind"), "source_url", F.col("observed").alias("observed_at"),
        F.when(year.rlike(r"^\d{4}$"), year).otherwise("").alias("work_date"), F.lit(organization).alias("organization"),
        F.lit(regional).alias("regional_evidence"), F.lit(scope).alias("geography_scope"),
        cell(1).alias("description"), "raw_path", "raw_sha256", "ord")
    person = r'(?is)<a href="([^"]*viewContributorPage\.action\?[^"]*)"[^>]*>(.*?)</a>\s*-\s*([^<]+)'
    people = parsed.filter("full").select(F.col("id").alias("work_id"), "source_url", "ord", F.posexplode(
        F.regexp_extract_all(F.get("cells", F.lit(4)), F.lit(f"({person})".replace("(?is)", "")), 1)).alias("nth", "match"))
    url = F.regexp_extract("match", person, 1)
    credits = people.select(
        "work_id", clean_html(F.regexp_extract("match", person, 2)).alias("name"), compact_text(F.regexp_extract("match", person, 3)).alias("role"),
        F.when(F.startswith(url, F.lit("https://")), url).otherwise(F.concat(F.lit(site), url)).alias("person_url"),
        no_identifiers().alias("identifiers"), "source_url", F.struct("ord", "nth").alias("ord")).filter("name != ''").withColumn(
        "evidence", sentence(LISTING_CREDIT))
    return accumulate(works, credits)


def thesis_index(pages: DataFrame, site: str, prefix: str, organization: str, scope: str, regional: str, description: str) -> Lane:
    """Index paragraphs "title, authors" under year headings; unclear author lists stay unresolved.

    ``pages(ord, html, observed, raw_path, raw_sha256)``. The year runs within a page.
    """
    part = r'(?is)(<h3\b[^>]*\bid="year_[^"]*"[^>]*>|<p\b[^>]*\bclass="[^"]*article-listing[^"]*"[^>]*>.*?</p>)'
    parts = pages.select("ord", "observed", "raw_path", "raw_sha256", F.posexplode(
        F.regexp_extract_all(or_empty(F.col("html")), F.lit(part), 1)).alias("at", "part"))
    running = Window.partitionBy("ord").orderBy("at")
    year = F.last(F.nullif(F.regexp_extract("part", r'(?is)^<h3\b[^>]*\bid="year_([^"]*)"', 1), F.lit("")), ignorenulls=True).over(running)
    anchor = r"(?is)(<a\b[^>]*>)(.*?)</a\s*>"
    listed = parts.withColumn("year", F.coalesce(year, F.lit(""))).filter(F.col("part").rlike("(?i)^<p")).select(
        F.struct("ord", "at").alias("ord"), "observed", "raw_path", "raw_sha256", "year",
        H.attribute(F.regexp_extract("part", anchor, 1), "href").alias("href"), H.fragment_text(F.regexp_extract("part", anchor, 2)).alias("title"),
        F.regexp_replace(H.fragment_text(F.regexp_replace("part", anchor, " ")), "^[, ]+", "").alias("authors"))
    numbered = listed.filter("href != '' AND title != '' AND authors != ''").withColumn(
        "number", F.regexp_extract("href", r"/theses/(\d+)", 1)).filter("number != ''").withColumn(
        "id", F.concat(F.lit(prefix + ":"), "number")).withColumn(
        "source_url", F.when(F.startswith("href", F.lit("https://")), F.col("href")).otherwise(F.concat(F.lit(site), "href"))).withColumn(
        "split", N.split_authors(F.col("authors")))
    works = numbered.select(
        "id", "title", F.lit("thesis_or_student_project").alias("kind"), "source_url", F.col("observed").alias("observed_at"),
        F.col("year").alias("work_date"), F.lit(organization).alias("organization"), F.lit(regional).alias("regional_evidence"),
        F.lit(scope).alias("geography_scope"), F.lit(description).alias("description"), "raw_path", "raw_sha256", "ord")
    credits = numbered.select(F.col("id").alias("work_id"), "source_url", "ord", F.posexplode("split.names").alias("nth", "name")).select(
        "work_id", "name", F.lit("thesis author").alias("role"), F.lit("").alias("person_url"), no_identifiers().alias("identifiers"),
        sentence(INDEX_CREDIT).alias("evidence"), "source_url",
        F.struct("ord", "nth").alias("ord"))
    unresolved = numbered.filter("split.ambiguous").select(
        F.col("id").alias("work_id"), F.col("authors").alias("name"), "source_url", F.lit(AMBIGUOUS_REASON).alias("reason"), "ord")
    return accumulate(works, credits, unresolved, credit_key=("work_id", "name"))


# --- rosters ----------------------------------------------------------------

def roster_credits(blocks: DataFrame) -> DataFrame:
    """Members under the sections of a roster page, from ``blocks(url, work_id, pos, tag, text)``.

    A heading that names people opens a section and may set its role; one that
    names other content closes it. Both states run in block order within a page.
    """
    low = F.lower("text")
    heading = F.col("tag").rlike("^h[1-5]$")
    opens = heading & low.rlike(SECTION_WORDS)
    state = F.when(opens, True).when(heading & low.rlike(CLOSING_WORDS), False)
    role = F.when(opens, F.when(low.rlike("alum|former|previous|past"), "former lab member").when(
        F.contains(low, F.lit("current")), "current lab member").when(low.rlike("team|people|director"), "lab member"))
    running = Window.partitionBy("url").orderBy("pos")
    tracked = blocks.withColumn("open", F.coalesce(F.last(state, True).over(running), F.lit(False))).withColumn(
        "role", F.coalesce(F.last(role, True).over(running), F.lit("lab member")))
    named = tracked.filter(F.col("open") & F.col("tag").rlike("^h[2-5]$")).select(
        "work_id", "url", "role", "pos", F.posexplode(N.roster_names(F.col("text"))).alias("nth", "name"))
    rows = named.select(
        "work_id", "name", "role", F.lit("").alias("person_url"), no_identifiers().alias("identifiers"),
        sentence(ROSTER_CREDIT).alias("evidence"),
        F.col("url").alias("source_url"), F.struct("pos", "nth").alias("ord"))
    return keep(rows, ["work_id", "name"], "ord", False).drop("ord")


def roster_pages(pages: DataFrame) -> Lane:
    """One work per page and its members; ``pages(url, html, observed, kind, organization, scope, raw_path, raw_sha256)``."""
    work_id = F.concat(F.lit("labpage:"), F.substring(F.sha2("url", 256), 1, 16))
    blocks = H.page_blocks(pages)
    heads = blocks.filter("tag = 'h1' AND NOT contains(lower(text), 'privacy')").groupBy("url").agg(F.min_by("text", "pos").alias("head"))
    opening = blocks.filter("tag = 'p' AND length(text) > 45")
    summaries = opening.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), " ").alias("summary"))
    titled = pages.join(heads, "url", "left").join(summaries, "url", "left")
    title = F.coalesce("head", F.nullif(H.page_title(F.col("html")), F.lit("")), "organization")
    works = titled.select(
        work_id.alias("id"), title.alias("title"), "kind", F.col("url").alias("source_url"), F.col("observed").alias("observed_at"),
        F.lit("").alias("work_date"), "organization",
        sentence(ROSTER_TIE).alias("regional_evidence"),
        F.col("scope").alias("geography_scope"), or_empty(F.col("summary")).alias("description"), "raw_path", "raw_sha256")
    return Lane(works, roster_credits(blocks.withColumn("work_id", work_id)))
