from pyspark.sql import functions as F

from veristrand.functions import dates, payload, text, urls


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_url_keys_collapse_scheme_host_slashes_and_fragments(spark):
    values = ["HTTPS://WWW.Example.org/A b/?q=1#x", "http://x.org///", "ftp://x", "", None, "http://x.org/p?", "not a url"]
    assert column(spark, values, urls.url_key) == [
        "https://example.org/A b?q=1", "https://x.org", None, "", "", "https://x.org/p", None]


def test_identifier_keys_follow_their_namespace(spark):
    key = lambda ns: (lambda v: urls.identifier_key(F.lit(ns), v))
    assert column(spark, ["https://orcid.org/0000-0001-ABCX/", " 0000-0001-abcx "], key("orcid")) == ["0000-0001-abcx"] * 2
    assert column(spark, ["Straße@Example.org"], key("email")) == ["strasse@example.org"]
    assert column(spark, [" A1 "], key("openalex")) == ["A1"]
    assert column(spark, ["http://www.example.org/me/"], key("profile_url")) == ["https://example.org/me"]


def test_name_keys_fold_marks_case_and_punctuation(spark):
    values = ["Zoë O'Brien-Straße", "ﬁ x_y  Ⅳ", None, "Plain NAME"]
    assert column(spark, values, text.name_key) == ["zoe o brien strasse", "fi x y iv", None, "plain name"]


def test_search_tokens_fold_latin_accents(spark):
    assert column(spark, ["Zoë_B, x"], text.search_tokens) == [["zoe", "b", "x"]]
    assert text.search_fold_text("Zoë") == "zoe"


def test_canonical_json_sorts_keys_and_rejects_duplicates(spark):
    values = ['{"b":1,"a":{"z":"é","y":[1,2]}}', '{"b":1,"b":2}', "not-json"]
    assert column(spark, values, payload.canonical_text) == ['{"a":{"y":[1,2],"z":"é"},"b":1}', None, None]


def test_required_means_present_and_truthy(spark):
    values = ['{"k":"v"}', '{"k":""}', '{"k":0}', '{"k":[]}', '{"k":null}', "{}", '{"k":[1]}']
    present = lambda v: payload.is_present(payload.variant(v), "k")
    assert column(spark, values, present) == [True, False, False, False, False, False, True]


def test_fingerprints_ignore_only_acquisition_time(spark):
    fp = lambda v: payload.comparable(F.lit("p"), payload.variant(v))
    a, b, c, d = column(spark, ['{"x":1,"observed_at":"a"}', '{"observed_at":"b","x":1}', '{"x":2}', '{"x":"1"}'], fp)
    assert a == b and len({a, c, d}) == 3


def test_dates(spark):
    values = ["2024-01-02T03:04:05Z", "01/02/2024", "2024/1/2", "1-2-2024", "nope", "2024-13-02", None, "20240102"]
    assert column(spark, values, dates.iso_date) == ["2024-01-02"] * 4 + ["", "", "", "2024-01-02"]
    values = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "2024-01-02"]
    assert column(spark, values, dates.has_timezone) == [True, True, False, False]


def test_repository_and_account_spellings(spark):
    values = ["git+https://github.com/Org/Repo.git", "git@github.com:Org/Repo.git", "https://github.com/org/repo/issues?x", "none"]
    assert column(spark, values, urls.github_repository) == ["org/repo"] * 3 + [""]
    assert column(spark, ["https://github.com/Ann/", "ann", " http://github.com/ann/x "], urls.github_account) == ["Ann", "ann", "ann"]
