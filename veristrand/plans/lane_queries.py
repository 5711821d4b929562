"""Lane operators bound to the given tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import payload as P
from ..functions.text import slug
from ..functions.urls import github_repository
from ..lanes import builders, common, creative, funded, research, software
from ..sources import pages as H
from .catalog import Catalog
from .core_queries import text_of

catalog = Catalog()
query = catalog.add


# --- pages ------------------------------------------------------------------

def unescaped(text: str) -> str:
    """The references that occur in the pages, resolved in SQL."""
    for reference, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{reference}', '{char}')"
    return text


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def fragment(text: str) -> str:
    return squeezed(unescaped(f"regexp_replace({text}, '<[^>]*>', ' ', 'g')"))


VISIBLE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


@query("page_links", f"""
SELECT page_id, (pos - 1)::INTEGER AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {fragment('a')} AS label
FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS a FROM
  (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a\\s*>)', 1) AS l FROM pages))
WHERE regexp_extract(a, 'href="([^"]*)"', 1) <> ''""")
def page_links(table):
    return H.page_links(table("pages"), key="page_id")


@query("link_targets", f"""
SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets,
       min(regexp_extract(url, '^(https?://[^/?#]+)', 1) || href) AS first_target FROM (
  SELECT page_id, url, regexp_extract(unnest(regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a\\s*>)', 1)), 'href="([^"]*)"', 1) AS href FROM pages)
WHERE href <> '' GROUP BY page_id""")
def link_targets(table):
    links = H.page_links(table("pages"), key="page_id").join(table("pages").select("page_id", "url"), "page_id")
    return links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("targets"),
        F.min(H.resolve_href(F.col("url"), F.col("href"))).alias("first_target"))


@query("page_blocks", f"""
SELECT page_id, tag, count(*) AS blocks, md5(min(text)) AS first_text FROM (
  SELECT page_id, lower(regexp_extract(b, '(?is)^<(h[1-6]|p|li)\\b', 1)) AS tag, {fragment('b')} AS text
  FROM (SELECT page_id, unnest(regexp_extract_all({VISIBLE}, '(?is)(<(?:h[1-6]|p|li)\\b[^>]*>.*?</(?:h[1-6]|p|li)\\s*>)', 1)) AS b FROM pages))
WHERE text <> '' GROUP BY page_id, tag""")
def page_blocks(table):
    return H.page_blocks(table("pages"), key="page_id").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("blocks"), F.md5(F.min("text")).alias("first_text"))


BREAKS_SQL = "(?i)</?(?:br|p|div|h[1-6]|li|tr|section|article|ul|ol|table|header|footer|nav|main)\\b[^>]*>"
LINES_SQL = f"""
lines AS (SELECT page_id, {squeezed('line')} AS line FROM (
  SELECT page_id, unnest(string_split({unescaped(f"regexp_replace(regexp_replace({VISIBLE}, '{BREAKS_SQL}', chr(10), 'g'), '<[^>]*>', '', 'g')")}, chr(10))) AS line FROM pages))"""


@query("page_lines", f"WITH {LINES_SQL} SELECT page_id, md5(line) AS line, count(*) AS n FROM lines WHERE line <> '' GROUP BY ALL")
def page_lines(table):
    return H.page_lines(table("pages"), key="page_id").groupBy("page_id", F.md5("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("page_titles", f"""
SELECT page_id, title, heading, CASE WHEN trim(split_part(title, ' | ', 1)) <> '' THEN trim(split_part(title, ' | ', 1)) ELSE heading END AS content FROM (
SELECT page_id, {fragment("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
       {fragment("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM pages)""")
def page_titles(table):
    found = table("pages").select("page_id", H.page_title(F.col("html")).alias("title"), H.first_heading(F.col("html")).alias("heading"))
    return found.withColumn("content", N.content_title(F.col("title"), F.col("heading")))


@query("section_items", f"""
SELECT page_id, count(*) AS items, md5(string_agg(item, '|' ORDER BY item)) AS digest FROM (
  SELECT page_id, {fragment('part')} AS item FROM (
    SELECT page_id, unnest(string_split_regex(b, '(?i)<br\\s*/?>')) AS part FROM (
      SELECT page_id, unnest(regexp_extract_all(regexp_extract({VISIBLE}, '(?is)</h1>(.*)$', 1), '(?is)(<p\\b[^>]*>.*?</p\\s*>)', 1)) AS b FROM pages)))
WHERE item <> '' GROUP BY page_id""")
def section_items(table):
    """Paragraph lines under the page's only heading, renamed to a team section."""
    renamed = F.regexp_replace("html", r"(?is)(<h1[^>]*>).*?(</h1>)", "$1Team Members$2")
    pages = table("pages").select(text_of("page_id").alias("url"), renamed.alias("html"))
    items = builders.section_items(pages, "Team Members")
    return items.groupBy(F.col("url").cast("bigint").alias("page_id")).agg(
        F.count(F.lit(1)).alias("items"), F.md5(F.array_join(F.array_sort(F.collect_list("item")), "|")).alias("digest"))


@query("project_pages", """
SELECT page_id FROM pages
WHERE regexp_matches(url, '^https?://[^/?#]*\\.example\\.com/en/') AND trim(regexp_extract(url, '^https?://[^/?#]+/en/([^?#]*)', 1), '/') <> ''
  AND NOT contains(trim(regexp_extract(url, '^https?://[^/?#]+/en/([^?#]*)', 1), '/'), '/')
  AND page_id NOT IN (SELECT page_id FROM pages WHERE regexp_matches(url, '^https://'))""")
def project_pages(table):
    """Pages below /en/ on any example.com host, none of those served over https being a project."""
    host = F.regexp_extract("url", r"(?i)^https?://([^/?#]*)", 1)
    pages = table("pages").withColumn("url", F.when(F.endswith(host, F.lit(".example.com")), F.regexp_replace(
        "url", r"^(https?)://[^/?#]*", "$1://www.example.com")).otherwise(F.col("url")))
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/+$", "")
    categories = pages.filter(F.startswith("url", F.lit("https://"))).select(bare.alias("url")).distinct()
    return builders.project_pages(pages, categories, "www.example.com", "/en/").select("page_id")


# --- text functions ---------------------------------------------------------

@query("part_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def part_slugs(table):
    return table("part").select("p_partkey", slug(F.concat_ws("  ", "p_name", "p_brand")).alias("slug"))


@query("author_splits", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN '' ELSE p_name END AS names, p_size % 3 = 1 AS ambiguous FROM part""")
def author_splits(table):
    size = F.col("p_size") % 3
    text = F.when(size == 0, F.concat_ws(" and ", "p_name", "p_type")).when(size == 1, F.concat_ws(", ", "p_name", "p_type")).otherwise(F.col("p_name"))
    return table("part").select("p_partkey", N.split_authors(text).alias("s")).select(
        "p_partkey", F.array_join("s.names", "|").alias("names"), F.col("s.ambiguous").alias("ambiguous"))


@query("repository_keys", "SELECT c_custkey, lower(c_mktsegment || '/' || replace(c_name, '#', '-')) AS repository FROM customer")
def repository_keys(table):
    name = F.replace("c_name", F.lit("#"), F.lit("-"))
    url = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("git+https://github.com/"), "c_mktsegment", F.lit("/"), name, F.lit(".git"))).otherwise(
        F.concat(F.lit("git@github.com:"), "c_mktsegment", F.lit("/"), name))
    return table("customer").select("c_custkey", github_repository(url).alias("repository"))


SPAN = "[A-ZÀ-ÖØ-Þ][\\p{L}\\p{M}\\p{Nd}_À-ÖØ-öø-ÿ''’.-]*(?:\\s+[A-ZÀ-ÖØ-Þ][\\p{L}\\p{M}\\p{Nd}_À-ÖØ-öø-ÿ''’.-]*){1,4}"


@query("capitalised_spans", f"""
SELECT doc_id, len(regexp_extract_all(text, '{SPAN}')) AS spans, md5(array_to_string(regexp_extract_all(text, '{SPAN}'), '|')) AS digest FROM documents""")
def capitalised_spans(table):
    spans = F.regexp_extract_all("text", F.lit(f"({N.FULL_NAME})"), 1)
    return table("documents").select("doc_id", spans.alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("spans"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("event_kinds", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)workshop|orientation|class|lab') THEN 'workshop'
  WHEN regexp_matches(text, '(?i)talk|conversation|in conversation|reading series') THEN 'talk'
  WHEN regexp_matches(text, '(?i)film|screening|animation') THEN 'film' ELSE 'exhibition' END AS kind FROM documents""")
def event_kinds(table):
    return table("documents").select("doc_id", creative.event_kind(F.col("text"), creative.WORKSHOP_EVENTS).alias("kind"))


@query("abstract_texts", "SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[^\\s]+'), ' ')) AS digest FROM documents")
def abstract_texts(table):
    """Each document taken apart into token positions and put together again."""
    tokens = F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)
    indexed = research.inverted_index(table("documents").select("doc_id", "text"), tokens)
    text = F.when(F.col("text").isNotNull(), research.abstract_text(F.col("index")))
    return indexed.select("doc_id", F.md5(text).alias("digest"))


# --- lanes ------------------------------------------------------------------

@query("occurrence_ids", """
SELECT l_returnflag, l_suppkey, occurrence,
       'sbir:' || substr(sha256(l_returnflag || chr(0) || l_suppkey || chr(0) || 'duplicate:' || occurrence), 1, 24) AS id
FROM (SELECT l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_returnflag, l_suppkey) AS occurrence FROM lineitem)""")
def occurrence_ids(table):
    rows = table("lineitem").select("l_returnflag", "l_suppkey").withColumn("pos", F.monotonically_increasing_id())
    found = funded.occurrence_ids(rows, ("l_returnflag", "l_suppkey"), "sbir:", width=1000)
    return found.select("l_returnflag", "l_suppkey", "occurrence", "id")


def _cities(table):
    return table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey < 12").select(
        F.col("n_name").alias("city"), F.col("r_name").alias("scope"))


def _documents(frame, body, ord_column):
    listed = frame.select(F.col(ord_column).alias("ord"), F.lit("2026-01-01T00:00:00Z").alias("observed"), F.lit("raw/x").alias("raw_path"),
                          F.lit("0").alias("raw_sha256"), F.lit("live").alias("origin"), F.to_json(body).alias("text"))
    return P.once(listed, "doc", P.variant(F.col("text"))).drop("text")


def _grants(table):
    rows = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = F.array(
        F.struct(F.col("c_name").alias("full_name"), text_of("c_custkey").alias("profile_id"), (F.col("c_acctbal") > 0).alias("is_contact_pi")),
        F.struct(F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(F.concat(F.lit("Co "), "c_name")).alias("full_name"),
                 F.lit(None).cast("string").alias("profile_id"), F.lit(False).alias("is_contact_pi")))
    body = F.struct(
        F.col("c_custkey").alias("appl_id"), F.lit(2025).alias("fiscal_year"), F.lit("n").alias("project_num"), F.col("c_name").alias("project_title"),
        F.lit("2025-10-01T00:00:00").alias("project_start_date"),
        F.struct(F.col("c_mktsegment").alias("org_name"), F.lower("n_name").alias("org_city"), F.when(F.col("c_acctbal") < 9000, "ny").otherwise("tx").alias("org_state")).alias("organization"),
        people.alias("principal_investigators"))
    return funded.grant_projects(_documents(rows, body, "c_custkey"), _cities(table), ("NY",))


@query("grant_works", """
SELECT 'nih:' || c_custkey AS id, c_name AS title, '2025-10-01' AS work_date, c_mktsegment AS organization, r_name AS geography_scope
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 12 AND c_acctbal < 9000""")
def grant_works(table):
    return _grants(table).works.select("id", "title", "work_date", "organization", "geography_scope")


@query("grant_credits", """
WITH located AS (SELECT * FROM customer WHERE c_nationkey < 12 AND c_acctbal < 9000)
SELECT 'nih:' || c_custkey AS work_id, c_name AS name, 'principal investigator' || CASE WHEN c_acctbal > 0 THEN ' (contact PI)' ELSE '' END AS role,
       c_custkey::VARCHAR AS profile_id FROM located
UNION ALL SELECT 'nih:' || c_custkey, 'Co ' || c_name, 'principal investigator', NULL FROM located WHERE c_mktsegment <> 'BUILDING'""")
def grant_credits(table):
    return _grants(table).credits.select("work_id", "name", "role", F.try_element_at("identifiers", F.lit("nih_profile_id")).alias("profile_id"))


def _scholarly(table):
    """Orders as works; each line is an author at the line's supplier."""
    author = F.struct(
        F.struct(F.concat(F.lit("https://openalex.org/A"), text_of("l_partkey")).alias("id"), F.concat(F.lit("Part "), text_of("l_partkey")).alias("display_name")).alias("author"),
        F.lit("middle").alias("author_position"), F.array(F.struct(F.concat(F.lit("https://openalex.org/I"), text_of("l_suppkey")).alias("id"))).alias("institutions"))
    lines = table("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(author)).alias("authorships"))
    orders = table("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    body = F.struct(
        F.concat(F.lit("https://openalex.org/W"), text_of("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("display_name"),
        F.year("o_orderdate").alias("publication_year"), "authorships")
    institutions = table("supplier").filter("s_nationkey < 8").select(
        F.concat(F.lit("I"), text_of("s_suppkey")).alias("institution_id"), F.col("s_name").alias("institution"),
        F.when(F.col("s_nationkey") < 3, "near").otherwise("far").alias("scope"))
    return research.scholarly_works(_documents(orders, body, "o_orderkey"), institutions, ("near", "far"))


SCHOLARLY_SQL = """
WITH regional AS (
  SELECT l_orderkey, l_partkey, s_name, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN orders ON o_orderkey = l_orderkey WHERE s_nationkey < 8)
"""


@query("scholarly_works", SCHOLARLY_SQL + """
SELECT 'openalex:W' || l_orderkey AS id, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS organization,
       CASE WHEN min(s_nationkey) < 3 THEN 'near' ELSE 'far' END AS geography_scope FROM regional GROUP BY l_orderkey""")
def scholarly_works(table):
    return _scholarly(table).works.select("id", "organization", "geography_scope")


@query("scholarly_credits", SCHOLARLY_SQL + """
SELECT 'openalex:W' || l_orderkey AS work_id, 'Part ' || l_partkey AS name, 'author' AS role, count(DISTINCT s_name) AS institutions FROM regional GROUP BY l_orderkey, l_partkey""")
def scholarly_credits(table):
    named = F.size(F.regexp_extract_all("evidence", F.lit(r"(Supplier#\d+)"), 1)).cast("bigint")
    return _scholarly(table).credits.select("work_id", "name", "role", named.alias("institutions"))


def _activity(table):
    """Events as public activity of accounts that are customers in good standing."""
    repo = F.struct(F.concat(F.lit("org/"), "event_type").alias("name"))
    login = F.concat(F.lit("User-"), text_of("user_id"))
    kind = F.when(F.col("event_type") == "click", "PushEvent").when(F.col("event_type") == "view", "WatchEvent").when(
        F.col("event_type") == "purchase", "ReleaseEvent").otherwise("IssuesEvent")
    payload = F.struct(
        F.md5("props").alias("head"), F.struct(F.get_json_object("props", "$.k").cast("int").alias("number"), F.struct(login.alias("login")).alias("user")).alias("issue"),
        F.struct(F.concat(F.lit("https://example.org/"), text_of("event_id")).alias("html_url"), F.concat(F.lit("v"), text_of("event_id")).alias("tag_name"),
                 F.struct(F.when(F.col("value") > 30, F.lower(login)).otherwise("other").alias("login")).alias("author")).alias("release"))
    body = F.struct(text_of("event_id").alias("id"), kind.alias("type"), F.struct(login.alias("login"), F.when(
        F.col("value") > 90, "Bot").otherwise("User").alias("type")).alias("actor"), repo.alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), payload.alias("payload"))
    people = table("customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("user-"), text_of("c_custkey")).alias("login_key"), F.concat(F.lit("User-"), text_of("c_custkey")).alias("login"), F.col("c_name").alias("name"),
        F.lit("").alias("person_url"), F.lit("near").alias("scope"), F.lit("t").alias("tie"), F.lit("o").alias("origin"))
    return software.event_credits(_documents(table("events"), body, "event_id"), people)


@query("activity_credits", f"""
SELECT event_id, c_name AS name, strftime(ts, '%Y-%m-%d') AS work_date,
       CASE event_type WHEN 'click' THEN '{software.PUSH_ROLE}' WHEN 'purchase' THEN 'release author' ELSE 'issue author' END AS role,
       CASE event_type WHEN 'click' THEN 'https://github.com/org/click/commit/' || md5(props) WHEN 'purchase' THEN 'https://example.org/' || event_id
         ELSE 'https://github.com/org/' || event_type || '/issues/' || json_extract_string(props, '$.k') END AS source_url
FROM events JOIN customer ON c_custkey = user_id
WHERE c_acctbal > 0 AND value <= 90 AND event_type <> 'view' AND (event_type <> 'purchase' OR value > 30)
  AND (event_type IN ('click', 'purchase') OR json_extract_string(props, '$.k') <> '0')""")
def activity_credits(table):
    return _activity(table).select(F.col("ord").alias("event_id"), "name", "work_date", "role", "source_url")


@query("first_and_last_credits", """
SELECT o_custkey AS work_id, arg_min(o_orderpriority, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def first_and_last_credits(table):
    rows = table("orders").select(F.col("o_custkey").alias("work_id"), "o_orderpriority", F.col("o_orderkey").alias("ord"))
    first = common.keep(rows, ["work_id"], "ord", False).select("work_id", F.col("o_orderpriority").alias("first"))
    return first.join(common.keep(rows, ["work_id"], "ord", True).select("work_id", F.col("o_orderpriority").alias("last")), "work_id")


@query("lane_coverage", """
SELECT n_name AS source, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS records,
       (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS contributions FROM nation""")
def lane_coverage(table):
    nations = table("nation").select("n_nationkey", F.col("n_name").alias("source"))
    works = table("supplier").filter("s_acctbal > 5000").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    credits = table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return common.coverage(nations, works, credits)


@query("even_sample", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT o_orderkey AS pos FROM r WHERE idx IN (SELECT round_even(i * ((SELECT max(n) FROM r) - 1) / 57.0, 0)::BIGINT FROM range(58) t(i))""")
def even_sample(table):
    return builders.evenly_spaced(table("orders").select(F.col("o_orderkey").alias("pos")), 58)


@query("repository_priority", """
SELECT p_partkey, row_number() OVER (ORDER BY (p_brand = 'Brand#7')::INT DESC, (p_type = 'ECONOMY')::INT DESC, lpad(p_size::VARCHAR, 3, '0') DESC, p_partkey) AS n FROM part
ORDER BY n LIMIT 55""")
def repository_priority(table):
    repos = table("part").select(
        "p_partkey", F.when(F.col("p_brand") == "Brand#7", "https://pypi.org/project/x").otherwise("").alias("homepage"),
        F.when(F.col("p_type") == "ECONOMY", "a tool").otherwise("a toy").alias("description"), F.lpad(text_of("p_size"), 3, "0").alias("updated_at"),
        F.col("p_partkey").alias("repo_key"))
    top = repos.orderBy(*software.repository_order()).limit(55)
    rank = F.row_number().over(Window.orderBy(*software.repository_order()))
    return top.withColumn("n", rank.cast("bigint")).select("p_partkey", "n")
