"""Literal word search with BM25 relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_words, search_fold_text, search_tokens
from ..session import checkpointed

# BM25 parameters and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def query_phrases(query: str) -> list[list[str]]:
    """One phrase per word; an underscore inside a word makes it several tokens."""
    return [re.findall(r"[^\W_]+", search_fold_text(word)) for word in query_words(query)]


def idf(total: Column, containing: Column) -> Column:
    return F.greatest(F.log((total - containing + 0.5) / (containing + 0.5)), F.lit(IDF_FLOOR))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


# --- index ------------------------------------------------------------------

def postings(parts: DataFrame, key: str = "profile_id", text: str = "text") -> DataFrame:
    """(term, key, tf). Parts of one document may arrive as many rows; counts add up."""
    return (
        parts.select(key, F.explode(search_tokens(F.col(text))).alias("term"))
        .groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    )


def lengths(parts: DataFrame, key: str = "profile_id", text: str = "text") -> DataFrame:
    return parts.groupBy(key).agg(F.sum(F.size(search_tokens(F.col(text)))).alias("length"))


def search_index(index: DataFrame, sizes: DataFrame, total: int, tokens: int, query: str,
                 key: str = "profile_id") -> DataFrame:
    """(key, score) of documents holding every word, from stored postings.

    Only the postings of the query's words are read. Needs words of one token;
    see :func:`search_texts` for words with underscores.
    """
    words = [p[0] for p in query_phrases(query) if len(p) == 1]
    distinct = list(dict.fromkeys(words))
    hits = index.filter(F.col("term").isin(distinct))
    frequency = {
        row.term: row.n for row in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    counts = [F.max(F.when(F.col("term") == word, F.col("tf"))).alias(f"_tf{i}") for i, word in enumerate(distinct)]
    everywhere = [F.col(f"_tf{i}").isNotNull() for i in range(len(distinct))]
    matched = hits.groupBy(key).agg(*counts)
    for condition in everywhere:
        matched = matched.filter(condition)
    average = F.lit(tokens / total if total else 1.0)
    score = sum(
        (
            F.lit(words.count(word)) * idf(F.lit(float(total)), F.lit(float(frequency.get(word, 0))))
            * term_weight(F.col(f"_tf{i}"), F.col("length"), average)
            for i, word in enumerate(distinct)
        ),
        F.lit(0.0),
    )
    return matched.join(sizes, key).select(key, score.alias("score"))


# --- scan -------------------------------------------------------------------

def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    wanted = F.array(*[F.lit(t) for t in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(phrase) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, len(phrase)) == wanted))


def search_texts(parts: DataFrame, query: str, key: str, text: str, one_part: bool = False) -> DataFrame:
    """(key, score) of documents holding every word, from the texts themselves.

    The texts are tokenised once into a narrow table (key, length, one count per
    word), which is written to the checkpoint folder; corpus statistics and
    scores both come from that table.
    """
    phrases = query_phrases(query)
    if not phrases or any(not p for p in phrases):
        return parts.select(key, F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(tuple(p) for p in phrases))
    counted = parts.select(key, search_tokens(F.col(text)).alias("_tokens")).select(
        key, F.size("_tokens").cast("bigint").alias("length"),
        *[_occurrences(F.col("_tokens"), list(p)).cast("bigint").alias(f"_tf{i}") for i, p in enumerate(distinct)])
    names = [f"_tf{i}" for i in range(len(distinct))]
    if not one_part:
        counted = counted.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("length", *names)])
    counted = checkpointed(counted)
    corpus = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"),
        *[F.count_if(F.col(c) > 0).alias(f"df{c}") for c in names]).first()
    matched = counted
    for name in names:
        matched = matched.filter(F.col(name) > 0)
    score = sum(
        (
            F.lit([tuple(p) for p in phrases].count(p))
            * idf(F.lit(float(corpus["n"])), F.lit(float(corpus[f"df_tf{i}"])))
            * term_weight(F.col(f"_tf{i}"), F.col("length"), F.lit(corpus["average"]))
            for i, p in enumerate(distinct)
        ),
        F.lit(0.0),
    )
    return matched.select(key, score.alias("score"))
