"""Film listings, exhibitions, events, podcasts and community reports."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.dates import rfc822_date
from ..functions.text import casefold, or_empty, squeeze
from ..sources import pages as H
from .common import CREDIT, UNRESOLVED, WORK, Lane, keep, no_identifiers, public_id

# Credit labels with their roles, patterns and reasons.
CREDIT_LABELS = (
    ("Curated by", "curator"), ("Curator:", "curator"), ("Curators:", "curator"), ("Artist:", "artist"),
    ("Artists:", "exhibiting artist"), ("Photographers:", "photographer"), ("Project Coordinators:", "project coordinator"),
    ("Project Coordinator:", "project coordinator"), ("Director:", "director"), ("Directed by:", "director"),
    ("Facilitator:", "workshop facilitator"), ("Workshop leader:", "workshop leader"), ("Speaker:", "speaker"),
    ("Speakers:", "speaker"), ("Moderated by curator", "moderator"), ("featuring", "featured artist"),
)
LABEL_END = r"(?=\.|\n|;|\s+The exhibition|\s+This exhibition|\s+Facebook|\s+About the artist|\s+Credits|$)"
TITLED_KINDS = ("exhibition", "public art", "architecture design", "film", "performance")
SHOWN_KINDS = ("exhibition", "public art")
PLAIN_FULL_NAME = N.FULL_NAME.replace("(?U)", "")
FILM_PAIR = r"(?U)[“\"]([^”\"]{2,120})[”\"]\s+((?:[A-Z][\w'’.-]+\s+){1,4}[A-Z][\w'’.-]+)\s*\(\s*(?:Co-)?Dir\s*\)"
FILM_DIRECTOR = r"(?U)((?:[A-Z][\w'’.-]+\s+){1,4}[A-Z][\w'’.-]+)\s*\(\s*(?:Co-)?Dir\s*\)"
FILM_WORDS = r"(?i)\b(?:film|short|documentary|screening|cinema|festival)\b"
PANELIST = r"(?U)(?:^|,\s*(?:and\s+)?)(Director|Producer|Documentary Participant|Writer|Star)\s+((?:[A-Z][\w'’.-]+\s+){1,3}[A-Z][\w'’.-]+)"
TITLE_MARK = "Official page title identifies"
NOT_A_DIRECTOR = "Director credit did not resolve to a verified individual name."
TWO_SPELLINGS = ("This source spells the same apparent credit differently in its title and body; "
                 "retained unresolved without choosing a spelling.")
A_PLACE = "The candidate appears in a parenthetical city/state location field, not as a credited person."
NOT_A_PERSON = ("The source presents a credit-like phrase, but it is an organization, collective, event, subject, or "
                "incomplete alias rather than a verified individual name.")
NOT_A_GUEST = ("Podcast title/show-note guest candidate is an alias or organization/event/topic phrase without enough "
               "evidence to verify an individual identity.")
TITLE_RATIO, TEXT_RATIO = 0.88, 0.93
WORKSHOP_EVENTS = ((r"(?i)workshop|orientation|class|lab", "workshop"), (r"(?i)talk|conversation|in conversation|reading series", "talk"),
                   (r"(?i)film|screening|animation", "film"))
GALLERY_EVENTS = ((r"(?i)workshop|class|talk|roundtable", "workshop"), (r"(?i)film|screening|video", "film"))


@dataclass(frozen=True)
class Venue:
    organization: str
    regional: str
    geography: str
    #: Words of places that must not pass for names of persons.
    places: tuple[str, ...] = ()


def event_kind(title: Column, rules: tuple[tuple[str, str], ...], otherwise: str = "exhibition") -> Column:
    """The kind of an event page from the words of its title; the first rule that matches."""
    result = F.lit(otherwise)
    for pattern, kind in reversed(rules):
        result = F.when(title.rlike(pattern), kind).otherwise(result)
    return result


# --- gate -------------------------------------------------------------------

def gated(works: DataFrame, candidates: DataFrame, unresolved: DataFrame | None = None, places: tuple[str, ...] = ()) -> Lane:
    """First work per id; credits of persons once per work, name and role; unresolved names once per work.

    ``candidates(work_id, name, role, evidence, source_url, person_url, reason, ord)``: a
    candidate with a reason, or one that reads as no person, stays unresolved.
    """
    kept = keep(works.withColumn("title", squeeze(F.col("title"))).filter("title != ''").withColumn(
        "description", squeeze(F.col("description"))), ["id"], "ord", False).select(*WORK)
    checked = candidates.withColumn("person", N.person_name(F.col("name"))).withColumn("is_person", N.is_person(F.col("name"), places))
    good = checked.filter(F.col("is_person") & (F.col("reason") == "") & (F.col("role") != "")).select(
        "work_id", F.col("person").alias("name"), squeeze(F.col("role")).alias("role"), "person_url", no_identifiers().alias("identifiers"),
        squeeze(F.col("evidence")).alias("evidence"), "source_url", "ord")
    keyed = good.withColumn("folded", casefold(F.col("name"))).withColumn("folded_role", casefold(F.col("role")))
    credits = keep(keyed, ["work_id", "folded", "folded_role"], "ord", False).select(*CREDIT)
    left = checked.filter(~F.col("is_person") | (F.col("reason") != "")).select(
        "work_id", F.regexp_replace(squeeze(F.col("name")), N.EDGES, "").alias("name"), "source_url",
        F.when(F.col("reason") != "", F.col("reason")).otherwise(F.col("fallback")).alias("reason"), "ord")
    if unresolved is not None:
        left = left.unionByName(unresolved)
    named = left.filter("name != ''").withColumn("folded", casefold(F.col("name")))
    return Lane(kept, credits, keep(named, ["work_id", "folded"], "ord", True).select(*UNRESOLVED))


def _candidates(rows: DataFrame, role: Column, evidence: Column, fallback: str, reason: Column | None = None) -> DataFrame:
    return rows.select(
        "work_id", "name", role.alias("role"), evidence.alias("evidence"), F.col("url").alias("source_url"),
        (F.col("person_url") if "person_url" in rows.columns else F.lit("")).alias("person_url"),
        (F.lit("") if reason is None else reason).alias("reason"), F.lit(fallback).alias("fallback"), "ord")


def with_person_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The first page link whose label equals the name, made absolute, as ``person_url``."""
    labelled = links.select("url", casefold(F.col("label")).alias("folded"), "pos", "href").filter("folded != ''")
    first = labelled.groupBy("url", "folded").agg(F.min_by("href", "pos").alias("href"))
    keyed = candidates.withColumn("folded", casefold(squeeze(F.col("name"))))
    return keyed.join(first, ["url", "folded"], "left").withColumn(
        "person_url", F.when(F.col("href").isNotNull(), H.resolve_href(F.col("url"), F.col("href"))).otherwise("")).drop("folded", "href")


# --- listings ---------------------------------------------------------------

def film_listings(pages: DataFrame, venue: Venue) -> Lane:
    """Film and panel credits of festival pages ``(ord, url, html, observed, raw_path, raw_sha256)``.

    Quoted films with their directors come first; a page without any is one film
    by its unquoted directors if its words say film. Panels and moderators make a talk.
    """
    read = pages.withColumn("full", H.page_text(F.col("html"))).withColumn(
        "title", F.coalesce(F.nullif(F.trim(F.substring_index(H.page_title(F.col("html")), " | ", 1)), F.lit("")), H.first_heading(F.col("html")))).filter(
        "title != ''").withColumn("date", N.mentioned_date(F.col("full"))).drop("html")
    pairs = F.transform(F.regexp_extract_all("full", F.lit(f"({FILM_PAIR[4:]})"), 1), lambda m: F.struct(
        F.regexp_extract(m, FILM_PAIR, 1).alias("film"), F.regexp_extract(m, FILM_PAIR, 2).alias("director")))
    alone = F.array_distinct(F.regexp_extract_all("full", F.lit(FILM_DIRECTOR), 1))
    says_film = F.concat_ws(" ", "title", "full").rlike(FILM_WORDS)
    none = F.array().cast("array<struct<film:string,director:string>>")
    films = read.withColumn("pairs", pairs).withColumn("pairs", F.when(F.size("pairs") > 0, F.col("pairs")).when(
        says_film, F.transform(alone, lambda d: F.struct(F.col("title").alias("film"), d.alias("director")))).otherwise(none))
    rows = films.select("url", "ord", "title", "date", "full", "observed", "raw_path", "raw_sha256", F.posexplode("pairs").alias("nth", "p")).withColumn(
        "work_id", public_id(F.col("url"), F.concat(F.lit("film:"), "p.film", F.lit(":"), "p.director"))).withColumn(
        "name", F.col("p.director")).withColumn("ord", F.struct("ord", F.lit(0).alias("part"), "nth"))
    directors = _candidates(rows, F.lit("director"), F.concat(F.lit("Official listing credits "), "name", F.lit(" as director of "), "p.film", F.lit(".")), NOT_A_DIRECTOR)
    panel = F.regexp_extract("full", r"(?i)Panelists?:\s*(.*?)(?=\s+Moderator:|\s+\*|\n|$)", 1)
    moderator = F.trim(F.regexp_extract("full", r"(?i)Moderator:\s*([^*\n]+)", 1))
    talks = read.withColumn("panel", panel).withColumn("moderator", moderator).filter("panel != '' OR moderator != ''").withColumn(
        "work_id", public_id(F.col("url"), F.concat(F.lit("talk:"), "title")))
    spoken = F.regexp_extract_all("panel", F.lit(f"({PANELIST[4:]})"), 1)
    speakers = talks.select("url", "ord", "work_id", F.posexplode(spoken).alias("nth", "m")).select(
        "url", "work_id", F.regexp_extract("m", PANELIST, 1).alias("said"), F.regexp_extract("m", PANELIST, 2).alias("name"),
        F.struct("ord", F.lit(1).alias("part"), "nth").alias("ord"))
    panelists = _candidates(speakers, F.lower("said"), F.concat(F.lit("Official panel listing identifies "), "name", F.lit(" as "), "said", F.lit(".")), NOT_A_PERSON)
    leading = talks.withColumn("name", F.regexp_extract(N.person_name(F.col("moderator")), f"^({N.FULL_NAME})", 1)).filter("name != ''").withColumn(
        "ord", F.struct("ord", F.lit(2).alias("part"), F.lit(0).alias("nth")))
    moderators = _candidates(leading, F.lit("moderator"), F.concat(F.lit("Official panel listing identifies "), "name", F.lit(" as moderator.")), NOT_A_PERSON)
    work = lambda frame, title, kind, ord_: frame.select(
        F.col("work_id").alias("id"), title.alias("title"), F.lit(kind).alias("kind"), F.col("url").alias("source_url"), F.col("observed").alias("observed_at"),
        F.col("date").alias("work_date"), F.lit(venue.organization).alias("organization"), F.lit(venue.regional).alias("regional_evidence"),
        F.lit(venue.geography).alias("geography_scope"), F.col("full").alias("description"), "raw_path", "raw_sha256", ord_.alias("ord"))
    works = work(rows, F.col("p.film"), "film", F.col("ord")).unionByName(
        work(talks, F.col("title"), "talk", F.struct("ord", F.lit(1).alias("part"), F.lit(0).alias("nth"))))
    return gated(works, directors.unionByName(panelists).unionByName(moderators), places=venue.places)


# --- labelled credits -------------------------------------------------------

@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def spelling_conflicts(candidates: pd.Series, in_title: pd.Series, in_text: pd.Series) -> pd.Series:
    """Names of one page that are nearly but not exactly the same, each with its other spelling."""

    def near(a: str, b: str, least: float) -> bool:
        x, y = a.casefold(), b.casefold()
        return x != y and SequenceMatcher(None, x, y).ratio() >= least

    def conflicts(names, titles, texts):
        found: dict[str, str] = {}
        for name in names:
            others = [(t, TITLE_RATIO) for t in titles] + [(t, TEXT_RATIO) for t in texts]
            for other, least in others:
                if near(name, other, least):
                    found[name], found[other] = other, name
        return found

    return pd.Series([conflicts(*row) for row in zip(candidates, in_title, in_text)], dtype="object")


def labelled_names(pages: DataFrame) -> DataFrame:
    """(url, ord, name, role, evidence) behind credit labels, in titles and in artist lists.

    ``pages(url, title, text, kind)``.
    """
    def labelled(number: int, label: str, role: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(rf"(?i)\Q{label}\E\s+(.*?){LABEL_END}"), 1)
        return F.transform(found, lambda span, i: F.struct(
            F.lit(number).alias("rule"), i.alias("at"), span.alias("span"), F.lit(role).alias("role"),
            F.concat(F.lit(label + " "), F.trim(span)).alias("evidence")))

    spans = F.concat(*[labelled(number, label, role) for number, (label, role) in enumerate(CREDIT_LABELS)])
    in_title = F.when(F.col("kind").isin(*TITLED_KINDS), F.regexp_extract_all(
        "title", F.lit(rf"(?U)(?:\bby\s+|:\s*|\|\s*)({PLAIN_FULL_NAME})(?=\s*(?:[|:,.;]|$))"), 1)).otherwise(F.array().cast("array<string>"))
    shown = F.when(F.col("kind").isin(*SHOWN_KINDS), "featured artist").otherwise("credited creator")
    titled = F.transform(in_title, lambda name, i: F.struct(
        F.lit(100).alias("rule"), i.alias("at"), name.alias("span"), shown.alias("role"),
        F.concat(F.lit(TITLE_MARK + " "), name, F.lit(" in the credited work title.")).alias("evidence")))
    listed = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?i)(?:artists?|filmmakers?|performers?)\s+(?:include|are)\s+(.*?)(?:\.|\n|$)"), 1),
        lambda span, i: F.struct(F.lit(200).alias("rule"), i.alias("at"), span.alias("span"),
                                 F.when(F.col("kind") == "exhibition", "exhibiting artist").otherwise("credited creator").alias("role"), F.lit("").alias("evidence")))
    rows = pages.select("url", "kind", F.explode(F.concat(spans, titled, listed)).alias("s"))
    named = rows.select("url", "kind", "s", F.posexplode(F.when(F.col("s.rule") == 100, F.array("s.span")).otherwise(N.named_people(F.col("s.span")))).alias("nth", "name"))
    evidence = F.when(F.col("s.rule") == 200, F.concat(F.lit("The official page lists "), "name", F.lit(" among the "), "kind", F.lit(" credits."))).otherwise(F.col("s.evidence"))
    return named.select("url", F.struct("s.rule", "s.at", "nth").alias("ord"), "name", F.col("s.role").alias("role"), evidence.alias("evidence"))


def credited_pages(pages: DataFrame, venue: Venue) -> Lane:
    """Works and labelled credits of gallery, art and event pages.

    ``pages(url, html, kind, observed, raw_path, raw_sha256)`` with optional ``title``.
    All comparisons stay within a page.
    """
    title = F.col("title") if "title" in pages.columns else N.content_title(H.page_title(F.col("html")), H.first_heading(F.col("html")))
    read = pages.withColumn("title", title).withColumn("text", H.page_text(F.col("html")))
    names = labelled_names(read)
    per_page = names.groupBy("url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda c: c["name"]).alias("candidates"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(
            F.startswith("evidence", F.lit(TITLE_MARK)), F.struct("ord", "name")))), lambda c: N.person_name(c["name"]))).alias("in_title"))
    texts = read.select("url", F.filter(N.named_people(F.col("text")), lambda n: N.is_person(n, venue.places)).alias("in_text"))
    conflicts = per_page.join(texts, "url").select("url", spelling_conflicts("candidates", "in_title", "in_text").alias("conflicts"))
    judged = names.join(conflicts, "url").join(read.select("url", F.col("title").alias("page_title"), F.col("kind").alias("page_kind")), "url").withColumn(
        "work_id", public_id(F.col("url"), F.concat("page_kind", F.lit(":"), "page_title"))).withColumn(
        "other", F.try_element_at("conflicts", F.col("name")))
    place = F.rlike("evidence", F.concat(F.lit(r"\b"), N.quoted(F.col("name")), F.lit(r"\s*,\s*(?:[A-Za-z .'-]+,\s*)?[A-Z]{2}\b")))
    reason = F.when(F.col("other").isNotNull(), TWO_SPELLINGS).when(place, A_PLACE).otherwise("")
    linked = with_person_links(judged.withColumn("reason", reason), H.page_links(pages))
    linked = linked.withColumn("name", F.when(F.col("other").isNotNull(), F.concat_ws(" / ", "name", "other")).otherwise(F.col("name")))
    works = read.select(
        public_id(F.col("url"), F.concat("kind", F.lit(":"), "title")).alias("id"), "title", "kind", F.col("url").alias("source_url"),
        F.col("observed").alias("observed_at"), N.mentioned_date(F.col("text")).alias("work_date"), F.lit(venue.organization).alias("organization"),
        F.lit(venue.regional).alias("regional_evidence"), F.lit(venue.geography).alias("geography_scope"),
        F.col("text").alias("description"), "raw_path", "raw_sha256", F.lit(0).alias("ord"))
    return gated(works, _candidates(linked, F.col("role"), F.col("evidence"), NOT_A_PERSON, F.col("reason")), places=venue.places)


# --- podcasts ---------------------------------------------------------------

FEED_ITEM = "title string, link string, `content:encoded` string, description string, guid string, pubDate string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title, link, notes, guid, published) of the items of archived feeds."""
    schema = T.StructType.fromDDL(FEED_ITEM.replace("guid string", "guid struct<_VALUE:string,_isPermaLink:string>"))
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    text = lambda name: or_empty(F.col(name))
    return items.select(
        F.monotonically_increasing_id().alias("pos"), squeeze(text("title")).alias("title"), squeeze(text("link")).alias("link"),
        F.coalesce("content:encoded", "description", F.lit("")).alias("notes"), squeeze(text("guid._VALUE")).alias("guid"), text("pubDate").alias("published"))


def guest_of(summary: Column, title: Column, titled_guests: bool) -> tuple[Column, Column]:
    """(guest, resolved): who the notes name as guest, and whether they resolve an alias."""
    name = PLAIN_FULL_NAME
    patterns = (
        rf"(?U)\b(?:our guest is|guest is|interviews? with|talks? with|speaks? with|welcomes?|features?)\s+(?:host\s+)?({name})\b",
        rf"(?U)\b(?:guest|artist|filmmaker|musician|speaker)\s+(?:is\s+)?({name})\b")
    alias = F.regexp_extract(summary, rf"(?U)\b(?i:also known as|real name is|legal name is)\s+({name})\b", 1)
    found = [F.nullif(N.person_name(F.regexp_extract(summary, p, 1)), F.lit("")) for p in patterns]
    before = F.regexp_extract(title, r"(?is)^(.*?)(?:\s+(?:of|from)\s+.*)?$", 1)
    in_title = F.nullif(N.person_name(F.regexp_extract(
        before, rf"(?U)(?i:Episode\s+\d+|BREAKING EPISODE|Podcast BREAKING EPISODE):\s*({name})(?=\s*(?:$|\b(?i:and)\b|&|:))", 1)), F.lit(""))
    resolved = alias != ""
    return F.coalesce(F.when(resolved, N.person_name(alias)), *found, *([in_title] if titled_guests else []), F.lit("")), resolved


def podcast_episodes(items: DataFrame, venue: Venue, feed_url: str, observed: str, raw_path: str = "", raw_sha256: str = "",
                     titled_guests: bool = False) -> Lane:
    """Episodes as works; a guest is credited only when the notes give a full personal name."""
    title = F.trim(F.regexp_replace("title", r"^\[[^\]]+\]\s*", ""))
    read = items.filter("title != ''").select(
        "pos", "title", title.alias("work_title"), F.when(F.col("link") != "", F.col("link")).otherwise(feed_url).alias("url"),
        F.coalesce(F.nullif("guid", F.lit("")), "title").alias("guid"), "published", H.page_text(F.col("notes")).alias("notes_text"),
    ).withColumn("summary", squeeze(F.col("notes_text"))).withColumn(
        "work_id", public_id(F.col("url"), F.concat(F.lit("episode:"), "guid")))
    day = rfc822_date(F.col("published"))
    works = read.select(
        F.col("work_id").alias("id"), F.col("work_title").alias("title"), F.lit("podcast episode").alias("kind"), F.col("url").alias("source_url"),
        F.lit(observed).alias("observed_at"), F.when(F.col("published") == "", "").when(day != "", day).otherwise(N.mentioned_date(F.col("published"))).alias("work_date"),
        F.lit(venue.organization).alias("organization"), F.lit(venue.regional).alias("regional_evidence"), F.lit(venue.geography).alias("geography_scope"),
        F.when(F.col("summary") != "", F.col("summary")).otherwise(F.concat(F.lit("Public episode listing for "), "work_title", F.lit("."))).alias("description"),
        F.lit(raw_path).alias("raw_path"), F.lit(raw_sha256).alias("raw_sha256"), F.col("pos").alias("ord"))
    guest, resolved = guest_of(F.col("summary"), F.col("work_title"), titled_guests)
    guests = read.withColumn("name", guest).withColumn("resolved", resolved).filter("name != ''")
    quote = or_empty(F.regexp_substr("notes_text", F.concat(F.lit(r"(?i)[^.!?\n]*\b"), N.quoted(F.col("name")), F.lit(r"\b[^.!?\n]*"))))
    evidence = F.concat(F.lit("The public show notes identify "), "name", F.lit(" as the episode's interview subject/guest: "),
                        F.when(quote != "", F.trim(quote)).otherwise(F.col("summary")))
    reason = F.when(F.col("resolved"), "").otherwise(N.guest_uncertainty(F.col("name"), F.col("summary"), F.col("work_title")))
    rows = guests.withColumn("ord", F.col("pos"))
    return gated(works, _candidates(rows, F.lit("interview guest"), evidence, NOT_A_GUEST, reason), places=venue.places)


# --- reports ----------------------------------------------------------------

def staff_lines(texts: DataFrame, key: str, opening: str, closing: str) -> DataFrame:
    """(key, pos, name, printed, job, heading) of staff lines "NAME, job" between two section titles.

    ``texts(key, text)``. A line in capitals without a job is the running heading.
    """
    order = Window.partitionBy(key).orderBy("pos")
    lines = H.text_lines(texts, key)
    state = F.when(F.contains("line", F.lit(closing)), False).when(F.contains("line", F.lit(opening)), True)
    inside = lines.withColumn("open", F.coalesce(F.last(state, True).over(order), F.lit(False))).filter("open")
    heading = F.when(F.col("line").rlike(r"^[A-Z][A-Z &'.-]{3,}$") & ~F.col("line").rlike(r"\b[A-Z]{2,3}\b"), F.initcap("line"))
    running = inside.withColumn("title", heading).withColumn("heading", F.coalesce(F.last("title", True).over(order), F.lit("project staff")))
    pattern = r"^([A-Z][A-Z'-]+(?:\s+[A-Z][A-Z'-]+){1,3}),\s+(.+)$"
    named = running.filter("title IS NULL").select(
        key, "pos", F.regexp_extract("line", pattern, 1).alias("printed"), F.regexp_extract("line", pattern, 2).alias("job"), "heading")
    return named.filter("printed != ''").withColumn("name", F.initcap("printed")).filter(N.is_person(F.col("name")))


def report_staff(texts: DataFrame, opening: str, closing: str, report: str) -> DataFrame:
    """Credits of a report's staff section; ``texts(url, work_id, text)``."""
    found = staff_lines(texts.select("url", "text"), "url", opening, closing).join(texts.select("url", "work_id"), "url")
    rows = found.select(
        "work_id", "name", F.concat(F.lit("project staff — "), "heading", F.lit(": "), "job").alias("role"), F.lit("").alias("person_url"),
        no_identifiers().alias("identifiers"),
        F.concat(F.lit(f"{report} acknowledgments list "), "printed", F.lit(", "), "job", F.lit(", under "), "heading", F.lit(".")).alias("evidence"),
        F.col("url").alias("source_url"), F.col("pos").alias("ord"))
    keyed = rows.withColumn("folded", casefold(F.col("name"))).withColumn("folded_role", casefold(F.col("role")))
    return keep(keyed, ["work_id", "folded", "folded_role"], "ord", False).select(*CREDIT)
