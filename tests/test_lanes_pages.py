from pyspark.sql import functions as F

from test_lanes_research import rows, values
from veristrand.functions import names as N
from veristrand.lanes import builders as B
from veristrand.lanes import creative as C
from veristrand.sources import pages as H

SITE = B.Site("Example Institute", "near", "senior design project", "The page documents the project.", "A project page.")
VENUE = C.Venue("Example Venue", "The listing names the region.", "near")


def page_frame(spark, *htmls, base="https://example.org/p", **extra):
    data = [(i, f"{base}{i}", html, "2026-01-01T00:00:00Z", "raw/p.html", "0" * 64) for i, html in enumerate(htmls)]
    frame = spark.createDataFrame(data, "ord bigint, url string, html string, observed string, raw_path string, raw_sha256 string")
    for name, value in extra.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame


def test_pages_come_apart_into_links_blocks_and_lines(spark):
    html = ("<title>T &amp; x</title><script>var a='<p>no</p>';</script><style>p{}</style><!-- <a href='/c'>c</a> --><h1>Head</h1>"
            "<p>One<br>two &lt;b&gt;</p><ul><li>Item <a class=x href='/a?x=1&amp;y=2'>La <b>bel</b></a></li></ul><a name=z>none</a><A HREF=\"b\">B</A>")
    page = page_frame(spark, html)
    assert rows(H.page_links(page.withColumn("html", H.visible(F.col("html")))), "href", "label") == [("/a?x=1&y=2", "La bel"), ("b", "B")]
    assert [tuple(r) for r in H.page_blocks(page).orderBy("pos").select("tag", "text").collect()] == [
        ("h1", "Head"), ("p", "One two <b>"), ("li", "Item La bel")]
    assert [r.line for r in H.page_lines(page).orderBy("pos").collect()][1:5] == ["Head", "One", "two <b>", "Item La bel"]
    assert page.select(H.page_title(F.col("html"))).first()[0] == "T & x"
    base = F.lit("https://example.org/dir/page?q#f")
    resolved = values(spark, ["/a", "b", "//x.org/c", "https://y.org", "#top"], lambda v: H.resolve_href(base, v))
    assert resolved == ["https://example.org/a", "https://example.org/dir/b", "https://x.org/c", "https://y.org", "https://example.org/dir/page?q#top"]


def test_inline_team_list_becomes_individual_credits(spark):
    items = B.inline_items(page_frame(spark, "Team Members<br/><span>Riley Fiction,Jordan Sample,eag8276<br>CAD model</span>"), "Team Members")
    assert [r.item for r in items.filter(N.likely_team_member(F.col("item"))).orderBy("nth").collect()] == ["Riley Fiction", "Jordan Sample"]


def test_section_list_stops_at_the_next_heading(spark):
    html = ("<h1>Mock Tank</h1><h2>Team Members</h2><p>Riley Fiction<br />Jordan Sample</p><ul><li>Casey Third</li></ul><h2>Final Rendered Spaceframe</h2>"
            "<p>Not a person credit</p><h2>Supervisors</h2><ul><li>Professor Fiction</li></ul><h3>Abstract</h3><p>Build a prototype.</p>")
    pages = B.described(page_frame(spark, html))
    assert pages.first().description == "Build a prototype."
    lane = B.team_projects(pages, B.section_items(pages, "Team Members"), SITE, "Project page")
    assert rows(lane.credits, "name") == [("Casey Third",), ("Jordan Sample",), ("Riley Fiction",)]
    assert rows(lane.works, "title", "description") == [("Mock Tank", "Build a prototype.")]


def test_category_pages_are_not_projects(spark):
    base = "https://www.example.edu/senior-design-day/"
    urls = [base + "me", base + "mock-tow-tank?x=1", base, base + "a/b", "https://other.edu/senior-design-day/x"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    categories = spark.createDataFrame([(base + "me",)], "url string")
    assert rows(B.project_pages(pages, categories, "www.example.edu", "/senior-design-day/"), "url") == [(base + "mock-tow-tank?x=1",)]


def test_even_sample_spans_the_whole_list(spark):
    links = spark.range(0, 100).select((F.col("id") * 7).alias("pos"))
    picked = [r.pos // 7 for r in B.evenly_spaced(links, 5).orderBy("pos").collect()]
    assert picked == [round(i * 99 / 4) for i in range(5)] and B.evenly_spaced(links, 200).count() == 100


def test_portfolio_cards_and_founders(spark):
    card = lambda name, place: (f'<article class="x portfolio-list-item"><h2 class="portfolio-list-item__heading"><a href="https://example.org/p0">{name}</a></h2>'  # noqa: E731
                                f'<small>{place}</small><p> </p><p>Makes things.</p><a class="badge" href="#">2024</a></article>')
    listing = spark.createDataFrame([(0, card("Old", "Elsewhere")), (1, card("Fictional Co", "Springfield, NY"))], "ord bigint, html string")
    detail = page_frame(spark, '<div class="founder-card"><div><h4>Riley Fiction</h4><p class="founder__title x">CEO</p></div></div><div class="founder-card b"><h4>Jordan Sample</h4></div>')
    site = B.Site("Example Program", "near", "company", "The card lists {location} for this company.")
    lane = B.portfolio(listing, detail, site, ("springfield",))
    work = lane.works.first()
    assert (work.title, work.regional_evidence) == ("Fictional Co — Makes things", "The card lists Springfield, NY for this company.")
    assert rows(lane.credits, "name", "role") == [("Jordan Sample", "Founder"), ("Riley Fiction", "Founder; CEO")]


def test_award_prose_names_projects_not_headings(spark):
    html = ("<p>Riley Fiction and Jordan Sample received the 2024 Student Project of the Year award for “MOCK,” a housing concept for a studio.</p>"
            "<h2>Architecture Students</h2><p>Winning a Merit Award in the Unbuilt category was Dormer, a bridge between houses. It was designed by UB architecture "
            "faculty members Ann Example and Bob Sample of the creative practice X.</p>")
    lane = B.awards(page_frame(spark, html), SITE)
    assert rows(lane.works, "title", "description") == [("Dormer", "a bridge between houses"), ("MOCK", "a housing concept for a studio")]
    assert rows(lane.credits, "name", "role") == [
        ("Ann Example", "architecture co-designer"), ("Bob Sample", "architecture co-designer"),
        ("Jordan Sample", "student architecture project designer"), ("Riley Fiction", "student architecture project designer")]
    assert values(spark, ["Riley Fiction only", "winning team — Ann Example, PhD and Bob Sample; MBA", "x and y"], N.pair_names) == [[], ["Ann Example", "Bob Sample"], []]


def test_adjacent_lines_and_labelled_triples(spark):
    study = "<h1>Cookies notice</h1><h1>widget works</h1><p>short</p><p>" + "A long description of the product and its development. " * 2 + "</p><p>Riley Fiction</p><p>Founder, Widget Works</p><p>Someone else</p>"
    lane = B.case_studies(page_frame(spark, study), SITE, "(?i)cookie|privacy policy")
    assert rows(lane.works, "title", "organization") == [("Widget Works", "Widget Works")] and lane.works.first().description.startswith("A long")
    assert rows(lane.credits, "name", "role") == [("Riley Fiction", "Founder")]
    report = ("<p>Faculty: Early Person</p><p>The awarded are:</p><p>Faculty: Ann Example, professor; and Bob Sample, chair</p><p>Industry partner: Fictional Corp is a maker</p>"
              "<p>Project: Better valves</p><p>Faculty: Lone Person</p><p>Other</p><p>For more information</p><p>Faculty: L P</p><p>Industry partner: X is</p><p>Project: late</p>")
    lane = B.applied_research(page_frame(spark, report), SITE, "The awarded are", "For more information")
    assert rows(lane.works, "title", "organization") == [("Fictional Corp — Better valves", "Fictional Corp")]
    assert rows(lane.credits, "name") == [("Ann Example",), ("Bob Sample",)]


def test_person_names(spark):
    assert values(spark, ["Facebook Casey Example", "Executive Director Casey Example. See", "Casey Example aka X", " Casey Example of Place"], N.person_name) == ["Casey Example"] * 4
    tests = ["Exhibition Artists", "Fictional Regional University", "A Retrospective", "Casey Casey", "DJ Someone", "Ann B Example", "Fictional Name", "Émile Zolá"]
    assert values(spark, tests, lambda n: N.is_person(n, ("exhibition artists",))) == [False] * 6 + [True] * 2
    assert values(spark, tests[:1], N.is_person) == [True]
    assert values(spark, ["Met Ann Example and Bob Sample, then Ann Example."], N.named_people) == [["Met Ann Example", "Bob Sample", "Ann Example"]]
    assert values(spark, ["On Monday, March 4, 2024 we", "June 31, 2024 or 1999", "none"], N.mentioned_date) == ["2024-03-04", "2024", ""]
    assert values(spark, ["A B; C D and E F", "A, B", "Solo Name", ""], lambda v: N.split_authors(v)["names"]) == [["A B", "C D", "E F"], [], ["Solo Name"], []]


def test_film_page_credits_directors_and_panels(spark):
    html = ('<html><head><title>Synthetic Film Program | 2025 Archive</title></head><body><h1>View Lineup</h1><p>"A Useful Short" Fictional Director (Dir), 12 minutes.</p>'
            "<p>Panelists: Director Fictional Director, Producer Imaginary Producer, and Documentary Participant Fictional Subject</p><p>Moderator: Fictional Moderator</p></body></html>")
    alone = "<title>Lone Documentary</title><p>made by Another Director (Co-Dir) of this film, March 4, 2025</p>"
    lane = C.film_listings(page_frame(spark, html, alone), VENUE)
    assert rows(lane.works, "title", "kind") == [("A Useful Short", "film"), ("Lone Documentary", "film"), ("Synthetic Film Program", "talk")]
    assert rows(lane.credits, "name", "role") == [
        ("Another Director", "director"), ("Fictional Director", "director"), ("Fictional Director", "director"), ("Fictional Moderator", "moderator"), ("Fictional Subject", "documentary participant"),
        ("Imaginary Producer", "producer")]


def test_group_credits_and_two_spellings_stay_unresolved(spark):
    html = ("<title>Synthetic Exhibition - Example Site</title><p>Curated by Fictional Community Association. Artist: Fictional Person</p>"
            '<p><a href="/people/fp">Fictional Person</a></p>')
    other = "<title>Prints: Jonathan Marksman</title><p>Artist: Jonathan Marksmann. Curator: Ann Example, Springfield, NY</p>"
    lane = C.credited_pages(page_frame(spark, html, other, kind="exhibition"), VENUE)
    assert rows(lane.credits, "name", "role", "person_url") == [("Fictional Person", "artist", "https://example.org/people/fp")]
    reasons = {r.name: r.reason for r in lane.unresolved.collect()}
    assert reasons["Fictional Community Association"] == C.NOT_A_PERSON
    assert reasons["Jonathan Marksmann / Jonathan Marksman"] == C.TWO_SPELLINGS
    assert values(spark, ["Sound Workshop", "Artist talk", "Short film night", "Show"], lambda v: C.event_kind(v, C.WORKSHOP_EVENTS)) == ["workshop", "talk", "film", "exhibition"]


def test_podcast_guests_need_a_resolved_name(spark, tmp_path):
    item = lambda title, notes, n: (f"<item><title>{title}</title><link>https://example.org/{n}</link><content:encoded><![CDATA[<p>{notes}</p>]]></content:encoded>"  # noqa: E731
                                    f'<guid isPermaLink="false">g{n}</guid><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>')
    (tmp_path / "feed.xml").write_text('<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Show</title>' + "".join([
        item("[Bonus] One", "In this episode our guest is Casey Example, a painter.", 1), item("Two", "An interview with Example Ensemble, which is a band of three.", 2),
        item("Three", "Our host talks with Snake Master. His real name is Robert Fiction today.", 3), item("Episode 4: Dana Sample", "No names here.", 4)]) + "</channel></rss>")
    items = C.read_feed(spark, str(tmp_path / "feed.xml"))
    lane = C.podcast_episodes(items, VENUE, "https://example.org/feed", "2026-01-01T00:00:00Z", titled_guests=True)
    assert rows(lane.works, "title", "work_date") == [("Episode 4: Dana Sample", "2024-03-05"), ("One", "2024-03-05"), ("Three", "2024-03-05"), ("Two", "2024-03-05")]
    assert rows(lane.credits, "name") == [("Casey Example",), ("Dana Sample",), ("Robert Fiction",)]
    assert rows(lane.unresolved, "name", "reason") == [("Example Ensemble", N.GROUP_NOTE)]


def test_report_staff_lines_follow_their_heading(spark):
    text = "Intro\nEARLY PERSON, nobody\nProject Staff\nPLANNING TEAM\nRILEY FICTION, Director of Parks\nnot a line\fDESIGN GROUP\nJORDAN O'SAMPLE, Planner\nProject Partners\nLATE PERSON, partner"
    texts = spark.createDataFrame([("https://example.org/r", "w", text)], "url string, work_id string, text string")
    credits = C.report_staff(texts, "Project Staff", "Project Partners", "Plan")
    assert [(n.casefold(), r) for n, r in rows(credits, "name", "role")] == [
        ("jordan o'sample", "project staff — Design Group: Planner"), ("riley fiction", "project staff — Planning Team: Director of Parks")]
