"""What a round of comparisons stages on its way is gone when the next step begins."""

from pathlib import Path

from veristrand.llm import jaccard, linking
from veristrand.session import checkpoint_dir


def test_ngrams_of_compared_texts_go_before_their_links_are_joined(spark, monkeypatch):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("staged-*"))
    seen = []

    def components(links, plain=linking.components):
        seen.append({c for f in set(folder.glob("staged-*")) - before for c in spark.read.parquet(str(f)).columns})
        return plain(links)

    monkeypatch.setattr(linking, "components", components)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "quite another text than these")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert seen and all("grams" not in columns for columns in seen)
