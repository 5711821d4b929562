"""Companies, student projects, case studies, awards and applied research.

Site structure is common to many pages; organizations, places and evidence
sentences are parameters of each call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import or_empty, squeeze
from ..operators.paging import CHUNK, number_rows
from ..sources import pages as H
from .common import CREDIT, WORK, Lane, no_identifiers, page_id

# Role words of case studies and where a partner's name ends.
LEADER_LINE = r"(?i)\b(founder|co-founder|CEO|CTO|president|chief technology officer|chief executive officer)\b"
PLAIN_NAME = r"^[A-Z][A-Za-z’'\-]+(?:\s+[A-Z][A-Za-z’'\-]+){1,3}$"
PARTNER_END = r"(?i)\s+(?:is|are|employs|helps|invent\w*|develop\w*|deliver\w*|provides|uses|leverages)\b"
MEMBER_ROLE = "student project team member"


@dataclass(frozen=True)
class Site:
    """What a call knows about the pages it reads."""

    organization: str
    geography: str
    kind: str
    evidence: str
    fallback: str = ""


def _works(rows: DataFrame, site: Site, title: Column, description: Column, key: Column, regional: Column | None = None) -> DataFrame:
    return rows.select(
        page_id(F.col("url"), key).alias("id"), squeeze(title).alias("title"), F.lit(site.kind).alias("kind"), F.col("url").alias("source_url"),
        F.col("observed").alias("observed_at"), F.lit("").alias("work_date"), F.lit(site.organization).alias("organization"),
        (F.lit(site.evidence) if regional is None else regional).alias("regional_evidence"), F.lit(site.geography).alias("geography_scope"),
        squeeze(description).alias("description"), "raw_path", "raw_sha256")


def _credits(rows: DataFrame, work_id: Column, role: Column, evidence: Column) -> DataFrame:
    """Credits as found; this family keeps duplicates, which the archive then rejects."""
    return rows.select(
        work_id.alias("work_id"), squeeze(F.col("name")).alias("name"), squeeze(role).alias("role"), F.lit("").alias("person_url"),
        no_identifiers().alias("identifiers"), squeeze(evidence).alias("evidence"), F.col("url").alias("source_url")).filter("name != '' AND role != ''").select(*CREDIT)


# --- portfolio --------------------------------------------------------------

def portfolio_cards(pages: DataFrame) -> DataFrame:
    """(card_url, name, location, description, cohort), the last card per company page, from ``pages(ord, html)``."""
    cards = pages.select("ord", F.posexplode(F.regexp_extract_all(or_empty(F.col("html")), F.lit(
        r'(?is)(<article\b[^>]*\bclass="[^"]*portfolio-list-item[^"]*"[^>]*>.*?</article>)'), 1)).alias("nth", "card"))
    heading = F.regexp_extract("card", r'(?is)<h2\b[^>]*portfolio-list-item__heading[^>]*>(.*?)</h2>', 1)
    paragraphs = F.regexp_extract_all("card", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    filled = F.filter(paragraphs, lambda p: F.trim(F.regexp_replace(p, H.TAG, "")) != "")
    found = cards.select(
        F.struct("ord", "nth").alias("ord"), H.attribute(F.regexp_extract(heading, r"(?is)(<a\b[^>]*>)", 1), "href").alias("card_url"),
        H.fragment_text(heading).alias("name"), H.fragment_text(F.regexp_extract("card", r"(?is)<small\b[^>]*>(.*?)</small>", 1)).alias("location"),
        or_empty(F.get(filled, F.lit(0))).alias("described"),
        H.fragment_text(F.regexp_extract("card", r'(?is)<a\b[^>]*\bclass="[^"]*badge[^"]*"[^>]*>(.*?)</a>', 1)).alias("cohort"))
    told = found.withColumn("description", H.fragment_text(F.col("described"))).drop("described").filter("card_url != ''")
    return told.groupBy("card_url").agg(F.max_by(F.struct("name", "location", "description", "cohort"), "ord").alias("c")).select("card_url", "c.*")


def founders(pages: DataFrame) -> DataFrame:
    """(url, nth, name, title) of founder cards on company pages ``(url, html)``."""
    cards = pages.select("url", F.posexplode(F.split(or_empty(F.col("html")), r'(?i)<div class="founder-card\b')).alias("nth", "card")).filter("nth > 0")
    return cards.select(
        "url", "nth", H.fragment_text(F.regexp_extract("card", r"(?is)<h4[^>]*>(.*?)</h4>", 1)).alias("name"),
        H.fragment_text(F.regexp_extract("card", r'(?is)<p class="founder__title[^>]*>(.*?)</p>', 1)).alias("title")).filter("name != ''")


def portfolio(listing: DataFrame, details: DataFrame, site: Site, places: tuple[str, ...]) -> Lane:
    """Local companies of a portfolio with the founders their own pages name.

    ``details(url, html, observed, raw_path, raw_sha256)``. ``site.evidence`` holds
    ``{location}`` where the card's location belongs.
    """
    local = portfolio_cards(listing).filter(F.lower("location").rlike("|".join(places)))
    found = details.join(local.withColumnRenamed("card_url", "url"), "url")
    before, _, after = site.evidence.partition("{location}")
    product = F.regexp_replace("description", r"\.+$", "")
    title = F.concat(F.col("name"), F.when(product != "", F.concat(F.lit(" — "), product)).otherwise(""))
    works = _works(found, site, title, F.col("description"), F.col("url"), F.concat(F.lit(before), "location", F.lit(after)))
    people = founders(found.select("url", "html"))
    titled = lambda text: F.when(F.col("title") != "", text).otherwise("")
    credits = _credits(
        people, page_id(F.col("url"), F.col("url")), F.concat(F.lit("Founder"), titled(F.concat(F.lit("; "), "title"))),
        F.concat(F.lit(f"{site.organization} company page lists "), "name", F.lit(" in the Founders section"),
                 titled(F.concat(F.lit(" with title "), "title")), F.lit(".")))
    return Lane(works.select(*WORK), credits)


# --- team lists -------------------------------------------------------------

def section_items(pages: DataFrame, heading: str) -> DataFrame:
    """(url, pos, nth, item): list items and broken paragraph lines under one heading, until the next heading."""
    blocks = pages.select("url", F.posexplode(F.regexp_extract_all(H.visible(F.col("html")), F.lit(H.BLOCK), 1)).alias("pos", "block")).withColumn(
        "tag", F.lower(F.regexp_extract("block", r"(?is)^<(h[1-6]|p|li)\b", 1)))
    titled = F.when(F.col("tag").rlike("^h"), F.lower(H.fragment_text(F.col("block"))))
    under = F.last(titled, ignorenulls=True).over(Window.partitionBy("url").orderBy("pos"))
    inside = blocks.withColumn("under", under).filter((F.col("under") == heading.lower()) & ~F.col("tag").rlike("^h"))
    parts = F.when(F.col("tag") == "p", F.split("block", r"(?i)<br\s*/?>")).otherwise(F.array("block"))
    return inside.select("url", "pos", F.posexplode(parts).alias("nth", "part")).select(
        "url", "pos", "nth", H.fragment_text(F.col("part")).alias("item")).filter("item != ''")


def inline_items(pages: DataFrame, heading: str) -> DataFrame:
    """(url, pos, nth, item) of a span after a bold label, split at breaks and commas."""
    span = F.regexp_extract(or_empty(F.col("html")), rf"(?is){heading}\s*<br\s*/?>\s*<span[^>]*>(.*?)</span>", 1)
    parts = pages.select("url", F.posexplode(F.split(span, r"(?i)<br\s*/?>|,")).alias("nth", "part"))
    return parts.select("url", F.lit(0).alias("pos"), "nth", H.fragment_text(F.col("part")).alias("item")).filter("item != ''")


def is_project_url(url: Column, host: str, root: str) -> Column:
    """A page directly below the root of the project section."""
    slug = F.trim(F.regexp_extract(url, rf"(?i)^https?://[^/?#]+\Q{root}\E([^?#]*)", 1), F.lit("/"))
    on_host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)) == host
    return on_host & (slug != "") & ~F.contains(slug, F.lit("/"))


def project_pages(pages: DataFrame, categories: DataFrame, host: str, root: str) -> DataFrame:
    """Pages that are projects: below the root and not a known category page."""
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    return pages.filter(is_project_url(F.col("url"), host, root)).withColumn("_bare", bare).join(
        categories.select(F.col("url").alias("_bare")), "_bare", "left_anti").drop("_bare")


def evenly_spaced(links: DataFrame, count: int) -> DataFrame:
    """``count`` rows spread over the whole ``pos`` order, first and last included."""
    total = links.count()
    if total <= count:
        return links
    wanted = sorted({round(i * (total - 1) / max(1, count - 1)) for i in range(count)})
    numbered = number_rows(links, F.floor(F.col("pos") / CHUNK), [F.col("pos")], start=-1, name="_at")
    return numbered.filter(F.col("_at").isin(wanted)).drop("_at")


def project_title(html: Column, url: Column) -> Column:
    heading = H.first_heading(html)
    return F.when(heading != "", heading).otherwise(F.initcap(F.replace(F.substring_index(url, "/", -1), F.lit("-"), F.lit(" "))))


def team_projects(pages: DataFrame, items: DataFrame, site: Site, credit_prefix: str) -> Lane:
    """Project pages and the likely members among their list items.

    ``pages(url, html, observed, raw_path, raw_sha256, description)``.
    """
    description = F.when(or_empty(F.col("description")) != "", F.col("description")).otherwise(F.lit(site.fallback))
    works = _works(pages, site, project_title(F.col("html"), F.col("url")), description, F.col("url"))
    members = items.filter(N.likely_team_member(F.col("item"))).withColumn("name", F.col("item"))
    credits = _credits(members, page_id(F.col("url"), F.col("url")), F.lit(MEMBER_ROLE),
                       F.concat(F.lit(credit_prefix + " lists "), "name", F.lit(" under Team Members")))
    return Lane(works.select(*WORK), credits)


def described(pages: DataFrame, markers: tuple[str, ...] = ("Abstract", "Project Description")) -> DataFrame:
    """Pages with the three lines after the first marker line as ``description``."""
    lines = H.page_lines(pages)
    after = Window.partitionBy("url").orderBy("pos")
    rank = F.array_position(F.array(*[F.lit(m) for m in markers]), F.col("line"))
    text = F.concat_ws(" ", *[F.lead("line", i).over(after) for i in (1, 2, 3)])
    marked = lines.select("url", "pos", rank.alias("rank"), text.alias("text")).filter("rank > 0 AND text != ''")
    first = marked.groupBy("url").agg(F.min_by("text", F.struct("rank", "pos")).alias("description"))
    return pages.join(first, "url", "left")


# --- prose ------------------------------------------------------------------

def leader_lines(pages: DataFrame) -> DataFrame:
    """(url, pos, name, role, line): a plain name directly above a line that names a leading role."""
    above = F.lag("line").over(Window.partitionBy("url").orderBy("pos"))
    lines = H.page_lines(pages).withColumn("name", above)
    return lines.filter(F.col("line").rlike(LEADER_LINE) & F.col("name").rlike(PLAIN_NAME)).select(
        "url", "pos", "name", F.substring_index("line", ",", 1).alias("role"), "line")


def case_studies(pages: DataFrame, site: Site, noise: str) -> Lane:
    """Company case studies: the last real heading, the first long paragraph after it, and adjacent roles."""
    blocks = H.page_blocks(pages)
    heads = blocks.filter((F.col("tag") == "h1") & ~F.col("text").rlike(r"(?i)privacy|cookies")).groupBy("url").agg(
        F.max_by("text", "pos").alias("head"))
    last_h1 = blocks.filter("tag = 'h1'").groupBy("url").agg(F.max("pos").alias("after"))
    body = blocks.join(last_h1, "url").filter((F.col("tag") == "p") & (F.col("pos") > F.col("after")) & (F.length("text") > 60) & ~F.col("text").rlike(noise)).groupBy(
        "url").agg(F.min_by("text", "pos").alias("body"))
    named = pages.join(heads, "url", "left").join(body, "url", "left")
    slug = F.replace(F.substring_index(F.substring_index("url", "/", -1), ".", 1), F.lit("-"), F.lit(" "))
    title = F.initcap(F.coalesce("head", slug))
    works = _works(named, site, title, F.coalesce("body", F.lit(site.fallback)), F.col("url")).withColumn("organization", F.col("title"))
    credits = _credits(leader_lines(pages), page_id(F.col("url"), F.col("url")), F.col("role"),
                       F.concat(F.lit("Case study names "), "name", F.lit(" immediately before the role credit "), "line"))
    return Lane(works.select(*WORK), credits)


@dataclass(frozen=True)
class AwardRule:
    """One sentence form: groups 1 to 3 are people, title and description in ``order``."""

    pattern: str
    role: str
    evidence: str
    order: tuple[int, int, int] = (1, 2, 3)
    strip: str = ""


# The two sentence forms in which award stories credit projects.
AWARD_RULES = (
    AwardRule(r"(.+?)\s+received the \d{4} Student Project of the Year award for\s+[“\"]([^”\"]+)[”\"],?\s*([^.]+)",
              "student architecture project designer", "The story reports a student award for this project."),
    AwardRule(r"(?i)Winning a Merit Award in the Unbuilt category was\s+([^,]+),\s+(a [^.]+)\.\s+It was designed by\s+([^.]+)",
              "architecture co-designer", "The story reports a merit award for this project.", (3, 1, 2),
              r"(?i)^(?:\w+\s+)?architecture faculty members?\s+|\s+of the creative practice.*$"),
)


def award_projects(pages: DataFrame, rules: tuple[AwardRule, ...] = AWARD_RULES) -> DataFrame:
    """(url, rule, title, description, people, role, regional_evidence) per sentence that names people."""
    text = squeeze(F.replace(H.page_text(F.col("html")), F.lit("\n"), F.lit(" ")))
    prose = pages.select("url", text.alias("text"))
    found = None
    for number, rule in enumerate(rules):
        people, title, told = (F.regexp_extract("text", rule.pattern, i) for i in rule.order)
        people = F.regexp_replace(people, rule.strip, "") if rule.strip else people
        rows = prose.select(
            "url", F.lit(number).alias("rule"), F.regexp_replace(squeeze(title), ",$", "").alias("title"), squeeze(told).alias("description"),
            N.pair_names(people).alias("people"), F.lit(rule.role).alias("role"), F.lit(rule.evidence).alias("regional_evidence"))
        found = rows if found is None else found.unionByName(rows)
    return found.filter("title != '' AND size(people) > 0")


def awards(pages: DataFrame, site: Site, rules: tuple[AwardRule, ...] = AWARD_RULES) -> Lane:
    found = award_projects(pages, rules).join(pages.drop("html"), "url")
    works = _works(found, site, F.col("title"), F.col("description"), F.col("title"), F.col("regional_evidence"))
    people = found.select("url", "title", "role", F.explode("people").alias("name"))
    credits = _credits(people, page_id(F.col("url"), F.col("title")), F.col("role"),
                       F.concat(F.lit("Award story explicitly credits "), "name", F.lit(" as a "), "role", F.lit(" on "), "title"))
    return Lane(works.select(*WORK), credits)


def labelled_projects(pages: DataFrame, opening: str, closing: str) -> DataFrame:
    """(url, pos, title, description, partner, people) of Faculty / Industry partner / Project lines in a row.

    Only lines between an opening and a closing line count.
    """
    order = Window.partitionBy("url").orderBy("pos")
    lines = H.page_lines(pages)
    bounds = lines.groupBy("url").agg(F.min(F.when(F.startswith("line", F.lit(opening)), F.col("pos"))).alias("start")).filter("start IS NOT NULL")
    inside = lines.join(bounds, "url").filter("pos > start")
    stop = F.max(F.startswith("line", F.lit(closing))).over(order)
    rows = inside.withColumn("stopped", stop).filter("NOT stopped").withColumn("second", F.lead("line", 1).over(order)).withColumn(
        "third", F.lead("line", 2).over(order))
    labels = ("Faculty:", "Industry partner:", "Project:")
    triple = [F.startswith(c, F.lit(label)) for c, label in zip(("line", "second", "third"), labels)]
    after = lambda c, label: F.trim(F.substring(c, F.lit(len(label) + 1), F.length(c)))
    named = F.filter(F.transform(F.split(after(F.col("line"), labels[0]), r"(?i);\s*and\s+"), lambda p: F.trim(F.substring_index(p, ",", 1))), lambda n: n != "")
    partner = F.trim(F.get(F.split(after(F.col("second"), labels[1]), PARTNER_END, 2), F.lit(0)))
    found = rows.filter(triple[0] & triple[1] & triple[2]).select(
        "url", "pos", after(F.col("third"), labels[2]).alias("description"), partner.alias("partner"), named.alias("people"))
    return found.withColumn("title", F.concat("partner", F.lit(" — "), "description")).filter("size(people) > 0 AND partner != '' AND description != ''")


def applied_research(pages: DataFrame, site: Site, opening: str, closing: str) -> Lane:
    found = labelled_projects(pages, opening, closing).join(pages.drop("html"), "url")
    works = _works(found, site, F.col("title"), F.col("description"), F.col("title"))
    partners = found.select(page_id(F.col("url"), F.col("title")).alias("id"), "partner")
    works = works.drop("organization").join(partners.withColumnRenamed("partner", "organization"), "id")
    people = found.select("url", "title", "partner", F.explode("people").alias("name"))
    credits = _credits(people, page_id(F.col("url"), F.col("title")), F.lit("faculty project team member"),
                       F.concat(F.lit("The report names "), "name", F.lit(" in the Faculty credit for the project with "), "partner"))
    return Lane(works.select(*WORK), credits)
