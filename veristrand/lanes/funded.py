"""Grants, awards and bulk award files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions.dates import iso_date
from ..functions.text import casefold, sentence, squeeze
from ..operators.paging import CHUNK, number_rows
from .common import Lane, accumulate, identifiers, no_identifiers

# What stands for "nobody", how much abstract is kept, and the identity of an award row.
NOBODY = ("unknown", "not specified", "n/a", "none")
GRANT_TEXT = "NIH RePORTER lists this as a FY{year} project funding record. Abstract: {abstract}"
GRANT_BARE = "NIH RePORTER lists a FY{year} project funding record titled {title}. The record has no abstract text."
GRANT_TIE = "NIH RePORTER organization field lists {org} in {city}, {state} (org_city={city}; org_state={state})."
GRANT_CREDIT = ("NIH RePORTER lists {name} in the principal_investigators field for application {appl_id} "
                "(project {number}, FY{year}).")
AWARD_TIE = ("NSF award record lists performance location {site}, {place}, {state} "
             "(perfCity={place}; perfStateCode={state}).")
AWARD_TEXT = "NSF award abstract: {abstract}"
AWARD_BARE = "NSF records an award titled {title}; no abstract text was returned."
AWARD_LEAD = "NSF award {award} lists {name} as project director/principal investigator (pdPIName)."
AWARD_CO = "NSF award {award} lists {name} in the coPDPI field."
ROW_KIND = "SBIR/STTR {program} {phase} funding award"
ROW_TIE = "SBIR.gov award CSV lists the recipient company address as {city}, {code} (city={city}; state={code})."
ROW_TEXT = ("SBIR.gov lists an {agency}{branch} {phase} {program} award titled {title} to {company}. The downloadable file "
            "does not include abstracts, so this record does not assert project results.")
ROW_CREDIT = ("The SBIR.gov award CSV names {name} in its PI Name field for agency tracking number {number}{job}.")
AWARD_IDENTITY = ("Agency", "Branch", "Company", "Agency Tracking Number", "Contract", "Program", "Phase",
                  "Proposal Award Date", "Award Title")


def _text(doc: Column, *names: str) -> Column:
    """The first of several spellings of a field that holds text."""
    return squeeze(F.coalesce(*[F.nullif(P.field(doc, n), F.lit("")) for n in names]))


def in_region(rows: DataFrame, cities: DataFrame, state: str, states: tuple[str, ...]) -> DataFrame:
    """Rows in one of the states and listed cities, with the city's ``scope``.

    ``rows`` carry ``city`` and ``state``; ``cities(city, scope)`` is a small table.
    """
    listed = cities.select(F.upper("city").alias("city"), "scope").distinct()
    return rows.filter(F.lower(state).isin(*[s.lower() for s in states])).join(listed, "city")


def kept_credits(credits: DataFrame) -> DataFrame:
    """Credits that name somebody, with the folded name as part of the key."""
    named = credits.withColumn("name", squeeze(F.col("name"))).filter(F.col("name") != "")
    return named.withColumn("folded", casefold(F.col("name"))).filter(~F.col("folded").isin(*NOBODY))


CREDIT_KEY = ("work_id", "folded", "role")


def grant_projects(documents: DataFrame, cities: DataFrame, states: tuple[str, ...]) -> Lane:
    """Grant records of organizations in the region, with their investigators.

    ``documents(ord, observed, raw_path, raw_sha256, doc)``, one record each.
    """
    doc = F.col("doc")
    rows = documents.select(
        "ord", "observed", "raw_path", "raw_sha256", "doc", F.upper(_text(doc, "organization.org_city", "organization.city")).alias("city"),
        F.upper(_text(doc, "organization.org_state", "org_state")).alias("state"), _text(doc, "project_title", "title").alias("title"),
        _text(doc, "appl_id", "application_id").alias("appl_id"), _text(doc, "project_num", "project_number").alias("number"),
        _text(doc, "subproject_id").alias("subproject"), _text(doc, "abstract_text", "abstract").alias("abstract"),
        _text(doc, "fiscal_year").alias("year"), _text(doc, "organization.org_name", "organization.name").alias("org"))
    located = in_region(rows, cities, "state", states).filter("title != '' AND appl_id != ''").withColumn(
        "id", F.concat(F.lit("nih:"), "appl_id", F.when(F.col("subproject") != "", F.concat(F.lit(":"), "subproject")).otherwise(""))).withColumn(
        "url", F.coalesce(F.nullif(_text(doc, "project_detail_url"), F.lit("")), F.concat(F.lit("https://reporter.nih.gov/project-details/"), "appl_id")))
    fy, bare = sentence(GRANT_TEXT, abstract=F.col("abstract")), sentence(GRANT_BARE)
    funded = F.when(F.col("org") != "", F.col("org")).otherwise("the funded organization")
    works = located.select(
        "id", "title", F.lit("NIH-funded research project").alias("kind"), F.col("url").alias("source_url"), F.col("observed").alias("observed_at"),
        iso_date(_text(doc, "project_start_date", "award_notice_date")).alias("work_date"), F.col("org").alias("organization"),
        sentence(GRANT_TIE, org=funded).alias("regional_evidence"),
        F.col("scope").alias("geography_scope"), F.when(F.col("abstract") != "", fy).otherwise(bare).alias("description"), "raw_path", "raw_sha256", "ord")
    listed = F.coalesce(P.part(doc, "principal_investigators"), P.part(doc, "principal_investigator"))
    everyone = F.when(P.is_object(listed), F.array(listed)).otherwise(F.from_json(P.canonical(listed), "array<variant>"))
    one = located.select("id", "url", "ord", "appl_id", "number", "year", F.posexplode(everyone).alias("nth", "person"))
    person = F.col("person")
    spelled = squeeze(F.concat_ws(" ", P.field(person, "first_name"), P.field(person, "middle_name"), P.field(person, "last_name")))
    name = F.coalesce(F.try_variant_get(person, "$", "string").cast("string"), F.lit(""))
    full = F.when(P.is_object(person), F.coalesce(F.nullif(_text(person, "full_name", "name"), F.lit("")), spelled)).otherwise(name)
    contact = P.is_present(person, "is_contact_pi") | P.is_present(person, "isContactPi")
    credits = one.select(
        F.col("id").alias("work_id"), full.alias("name"),
        F.when(contact, "principal investigator (contact PI)").otherwise("principal investigator").alias("role"), F.lit("").alias("person_url"),
        identifiers(nih_profile_id=_text(person, "profile_id", "profileId")).alias("identifiers"),
        sentence(GRANT_CREDIT, name=full).alias("evidence"),
        F.col("url").alias("source_url"), F.struct("ord", "nth").alias("ord"))
    return accumulate(works, kept_credits(credits), last=True, credit_key=CREDIT_KEY)


def research_awards(documents: DataFrame, cities: DataFrame, states: tuple[str, ...]) -> Lane:
    """Awards performed in the region, with principal and co-principal investigators."""
    doc = F.col("doc")
    rows = documents.select(
        "ord", "observed", "raw_path", "raw_sha256", "doc", _text(doc, "perfCity").alias("place"), F.upper(_text(doc, "perfCity")).alias("city"),
        F.upper(_text(doc, "perfStateCode")).alias("state"), _text(doc, "id").alias("award"), _text(doc, "title").alias("title"),
        _text(doc, "awardeeName", "awardee").alias("awardee"), _text(doc, "abstractText").alias("abstract"))
    located = in_region(rows, cities, "state", states).filter("award != '' AND title != ''").withColumn("id", F.concat(F.lit("nsf:"), "award")).withColumn(
        "url", F.concat(F.lit("https://api.nsf.gov/services/v1/awards/"), "award", F.lit(".json")))
    site = F.coalesce(F.nullif(_text(doc, "perfLocation"), F.lit("")), F.nullif(F.col("awardee"), F.lit("")), F.lit("the award site"))
    works = located.select(
        "id", "title", F.lit("NSF research award").alias("kind"), F.col("url").alias("source_url"), F.col("observed").alias("observed_at"),
        iso_date(_text(doc, "startDate", "date")).alias("work_date"), F.col("awardee").alias("organization"),
        sentence(AWARD_TIE, site=site).alias("regional_evidence"),
        F.col("scope").alias("geography_scope"),
        F.when(F.col("abstract") != "", sentence(AWARD_TEXT, abstract=F.col("abstract")))
        .otherwise(sentence(AWARD_BARE)).alias("description"),
        "raw_path", "raw_sha256", "ord")
    co = P.part(doc, "coPDPI")
    lead = F.array(F.struct(_text(doc, "pdPIName").alias("name"), F.lit(True).alias("lead")))
    several = F.when(F.schema_of_variant(co) == "STRING", F.split(F.try_variant_get(co, "$", "string"), r"\s*;\s*|\s*\|\s*")).otherwise(
        F.from_json(P.canonical(co), "array<string>"))
    others = F.transform(F.coalesce(several, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(False).alias("lead")))
    people = located.select("id", "url", "ord", "award", "doc", F.posexplode(F.concat(lead, others)).alias("nth", "p"))
    name = squeeze(F.col("p.name"))
    credits = people.select(
        F.col("id").alias("work_id"), name.alias("name"),
        F.when(F.col("p.lead"), "principal investigator").otherwise("co-principal investigator").alias("role"), F.lit("").alias("person_url"),
        F.when(F.col("p.lead"), identifiers(nsf_pi_id=_text(doc, "piId"))).otherwise(no_identifiers()).alias("identifiers"),
        F.when(F.col("p.lead"), sentence(AWARD_LEAD, name=name)).otherwise(sentence(AWARD_CO, name=name)).alias("evidence"),
        F.col("url").alias("source_url"), F.struct("ord", "nth").alias("ord"))
    return accumulate(works, kept_credits(credits), last=True, credit_key=CREDIT_KEY)


def read_award_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a bulk award CSV with ``pos``, their order."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.withColumn("pos", F.monotonically_increasing_id())


def occurrence_ids(rows: DataFrame, identity: tuple[str, ...], prefix: str, width: int = CHUNK) -> DataFrame:
    """Ids that tell identical rows apart by their occurrence in ``pos`` order.

    Occurrences are numbered per chunk of positions, so a row repeated across a
    third of the file is spread over as many tasks as it has chunks.
    """
    keyed = rows.withColumn("_identity", F.concat_ws("\0", *[F.col(f"`{c}`") for c in identity]))
    numbered = number_rows(keyed, F.floor(F.col("pos") / width), [F.col("pos")], name="occurrence", keys=("_identity",))
    text = F.concat("_identity", F.lit("\0duplicate:"), F.col("occurrence").cast("string"))
    return numbered.withColumn("id", F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))).drop("_identity")


def award_rows(rows: DataFrame, cities: DataFrame, states: tuple[str, ...], state_code: str, source_url: str, observed: str,
               raw_path: str = "", raw_sha256: str = "") -> Lane:
    """Bulk award rows of recipients in the region, with the named investigator."""
    c = lambda name: F.col(f"`{name}`")
    kept = [n for n in rows.columns if n not in ("pos", "City", "State")]
    tidy = rows.select("pos", F.upper(squeeze(c("City"))).alias("city"), squeeze(c("State")).alias("state_name"),
                       *[squeeze(c(n)).alias(n) for n in kept])
    located = in_region(tidy, cities, "state_name", states)
    numbered = occurrence_ids(located.filter("`Award Title` != '' AND Company != ''"), AWARD_IDENTITY, "sbir:")
    phase = F.when((c("Phase") != "") & ~F.startswith(F.lower("Phase"), F.lit("phase")), F.concat(F.lit("Phase "), "Phase")).otherwise(c("Phase"))
    number = F.coalesce(F.nullif(c("Agency Tracking Number"), F.lit("")), F.nullif(c("Contract"), F.lit("")), F.lit("no-award-number"))
    branch = F.when(c("Branch") != "", F.concat(F.lit(" / "), "Branch")).otherwise("")
    works = numbered.select(
        "id", c("Award Title").alias("title"),
        F.trim(sentence(ROW_KIND, program=F.when(c("Program") != "", c("Program")).otherwise("award"), phase=phase)).alias("kind"),
        F.lit(source_url).alias("source_url"), F.lit(observed).alias("observed_at"), iso_date(c("Proposal Award Date")).alias("work_date"),
        c("Company").alias("organization"),
        sentence(ROW_TIE, code=F.lit(state_code)).alias("regional_evidence"),
        F.col("scope").alias("geography_scope"),
        sentence(ROW_TEXT, agency=c("Agency"), branch=branch, phase=phase, program=c("Program"), title=c("Award Title"),
                 company=c("Company")).alias("description"),
        F.lit(raw_path).alias("raw_path"), F.lit(raw_sha256).alias("raw_sha256"), F.col("pos").alias("ord"))
    job = F.when(c("PI Title") != "", F.concat(F.lit(" (PI Title: "), c("PI Title"), F.lit(")"))).otherwise("")
    credits = numbered.select(
        F.col("id").alias("work_id"), c("PI Name").alias("name"), F.lit("principal investigator").alias("role"), F.lit("").alias("person_url"),
        no_identifiers().alias("identifiers"),
        sentence(ROW_CREDIT, name=c("PI Name"), number=number, job=job).alias("evidence"),
        F.lit(source_url).alias("source_url"), F.col("pos").alias("ord"))
    return accumulate(works, kept_credits(credits), last=True, credit_key=CREDIT_KEY)
