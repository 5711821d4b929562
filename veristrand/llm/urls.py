"""URL filter: listed rules first, then logistic regression on character n-grams of host and path."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the character n-grams, and the width of the hashed feature space.
GRAMS, WIDTH = (3, 4, 5), 1 << 16
#: At most so many labelled rows are fitted, an evenly hashed choice of them.
LABELLED_ROWS = 20_000
TRAINING = {"maxIter": 40, "regParam": 0.0005}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, bool]]) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it allows; both null without one.

    A rule is a host and a path, and fits that host and all its subdomains when the path
    begins with the rule's. Of equal rules the last counts.
    """
    listed = sorted(dict(rules).items(), key=lambda rule: (-len(rule[0]), rule[0]))
    rule, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for text, allows in reversed(listed):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, allowed = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(allows)).otherwise(allowed)
    return rule, allowed


def grams(host: Column, path: Column) -> Column:
    """All character n-grams of both parts, each with its edges marked and told apart by a prefix."""
    parts = [F.concat(F.lit("h^"), host, F.lit("$")), F.concat(F.lit("p^"), path, F.lit("$"))]
    found = []
    for part, name in zip(parts, "hp"):
        for size in GRAMS:
            every = F.regexp_extract_all(part, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)
            found.append(F.transform(every, lambda g, name=name: F.concat(F.lit(name), g)))
    return F.concat(*found)


def _features(frame: DataFrame) -> DataFrame:
    hashed = HashingTF(numFeatures=WIDTH, binary=True, inputCol="_llm_grams", outputCol="_llm_features")
    return hashed.transform(frame.withColumn("_llm_grams", grams(F.col("_llm_host"), F.col("_llm_path"))))


def fit(labelled: DataFrame, *, url: str = "url", label: str = "blocked", rows: int = LABELLED_ROWS) -> LogisticRegressionModel | None:
    """Logistic regression fitted by Spark on a small labelled table of ``url`` and ``label`` (1: block).

    At most ``rows`` rows count, chosen by a hash of the url; rows without a label do not. Repeated
    rows count each time; long urls are taken whole. Without a labelled row there is no model (None).
    """
    table = labelled.filter(F.col(label).isNotNull()).select(
        host_of(F.col(url)).alias("_llm_host"), path_of(F.col(url)).alias("_llm_path"),
        F.col(label).cast("double").alias("_llm_label"), F.xxhash64(F.col(url)).alias("_llm_order"))
    if table.isEmpty():
        return None
    chosen = table.orderBy("_llm_order", "_llm_host", "_llm_path", "_llm_label").limit(rows)
    return LogisticRegression(featuresCol="_llm_features", labelCol="_llm_label", **TRAINING).fit(_features(chosen))


def judge(
    pages: DataFrame, model: LogisticRegressionModel | None, rules: list[tuple[str, bool]], *, url: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``block_score`` and ``verdict`` (allow or block).

    The longest rule that fits decides; without one, block from a score of ``threshold`` on.
    A null url, and one without ``://``, has an empty host and path and is judged like any
    other. Without a model all scores are 0; an empty table gives no rows. Columns named like a result are replaced, all
    others pass unchanged. A map over rows; the weights have a fixed size.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "block_score", "verdict")]
    split = pages.select(*kept, host_of(F.col(url)).alias("_llm_host"), path_of(F.col(url)).alias("_llm_path"))
    scored = split.withColumn("_llm_score", F.lit(0.0))
    if model is not None:
        own = model.copy().setFeaturesCol("_llm_features").setProbabilityCol("_llm_probability")
        own = own.setPredictionCol("").setRawPredictionCol("")
        scored = own.transform(_features(split)).withColumn("_llm_score", vector_to_array("_llm_probability")[1])
    rule, allowed = rule_of(F.col("_llm_host"), F.col("_llm_path"), rules)
    blocked = F.when(rule.isNotNull(), ~allowed).otherwise(F.col("_llm_score") >= threshold)
    return scored.select(
        *kept, F.col("_llm_host").alias("host"), F.col("_llm_path").alias("path"), rule.alias("rule"),
        F.col("_llm_score").alias("block_score"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def weights(model: LogisticRegressionModel) -> np.ndarray:
    return np.asarray(model.coefficients.toArray())
