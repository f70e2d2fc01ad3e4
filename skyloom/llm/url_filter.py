"""URL filter: rules for hosts and paths, and a logistic regression for the urls that no rule decides.

The model sees character n-grams of the host and of the path, hashed to a fixed number of buckets. It is trained from a
small labelled table; judging is one column expression, so the scan of the pages stays in the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, functions as F

from skyloom.llm.common import ascii_lower

BUCKETS = 1024
GRAMS = (3, 4)
MAX_LABELLED = 2_000  # rows of the labelled table that training looks at


@dataclass(frozen=True)
class Model:
    """Weights by bucket and the constant; positive scores mean block."""

    weights: tuple[float, ...]
    bias: float


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A rule is ``host/path-start``."""
    checks = []
    for rule, verdict in sorted(set(rules), key=lambda r: (-len(r[0]), r)):
        site, slash, start = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        checks.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*checks) if checks else F.lit(None).cast("struct<rule:string,verdict:string>")


def _grams(text: Column, n: int, mark: str) -> Column:
    """Buckets of the n-grams of a text, with a boundary sign at both ends; ``mark`` keeps host and path apart."""
    framed = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    last = F.length(framed) - (n - 1)
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), framed.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def grams(host: Column, path: Column) -> Column:
    return F.concat(*[_grams(text, n, mark) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS])


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rounds: int = 50, ridge: float = 1e-6) -> Model:
    """Fit on at most ``MAX_LABELLED`` rows with a url and a label, 1 for block (by smallest hash of url and label).

    Without labels the model allows all; with one kind of label it gives that one.
    """
    rows = labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").cast("double").alias("label"))
    rows = rows.where("url IS NOT NULL AND label IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("url", "label"), "url", "label").limit(MAX_LABELLED)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model((0.0,) * BUCKETS, 1.0 if counts.get(1.0) else -1.0)
    found = rows.select("label", grams(url_host(F.col("url")), url_path(F.col("url"))).cast("array<string>").alias("grams")).coalesce(1)
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "grams", "counts")
    table = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counts.transform(found))
    fitted = LogisticRegression(maxIter=rounds, regParam=ridge, standardization=False).fit(table)
    return Model(tuple(map(float, fitted.coefficients)), float(fitted.intercept))


def score(host: Column, path: Column, model: Model) -> Column:
    """Log-odds of block."""
    weights = F.split(F.lit(" ".join(map(repr, model.weights))), " ").cast("array<double>")
    found = grams(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.get(weights, g))
    return F.lit(model.bias) + total / F.greatest(F.size(found), F.lit(1))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block).

    The longest fitting rule decides; where none fits, the model does. A null url, or one without ``://``, has an empty
    host and path, fits no rule and is judged by the constant of the model. Repeated rows are judged each; other columns
    are ignored. Rules are a short list in the plan; a rule given twice with both verdicts counts as allow.
    """
    url = F.col(f"`{url_col}`")
    cut = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    cut = cut.withColumn("match", matched_rule(F.col("host"), F.col("path"), rules))
    guess = F.when(score(F.col("host"), F.col("path"), model) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return cut.select(
        F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"),
        F.when(F.col("match").isNotNull(), F.col("match.verdict")).otherwise(guess).alias("verdict"),
    )
