"""Documents are taken apart in their rows and looked at once."""

from pyspark.sql import functions as F

from veristrand.lanes import research


def test_an_index_is_made_without_a_shuffle(spark):
    texts = ["b a b  c a b", "one", "", " ", None, "z z z"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    indexed = research.inverted_index(documents, F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    assert "Exchange" not in indexed._jdf.queryExecution().executedPlan().toString()
    rows = {r.doc_id: r for r in indexed.select("*", research.abstract_text(F.col("index")).alias("back")).collect()}
    assert rows[0]["index"] == {"a": [1, 4], "b": [0, 2, 5], "c": [3]}
    assert rows[2]["index"] == rows[3]["index"] == {} and rows[4]["index"] is None
    assert [rows[i].back for i in (0, 1, 2, 5)] == ["b a b c a b", "one", "", "z z z"]
