"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on style features of the text gives the evidence of a document: its log-odds beyond the base rate
of the labels. Labels are also counted per site and per path within the site. Sites are shrunk towards the global rate
and paths towards their site, each as strongly as the spread between groups asks for (method of moments over grouped
sums), so a site with few labels says little and one without labels nothing. Evidence and shrunken rate add up on the
log-odds scale. Scoring adds a column to the documents and looks up two small aggregates; texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.llm.common import stored

MAX_LABELLED = 20_000  # labelled documents that the classifier is fitted on, by smallest hash of the id
MOST_ROUNDS = 25
RIDGE = 1.0
_KINDS = np.zeros(256, np.int64)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b"#$%&*+=<>@\\^_~{}[]/", 4), (b".,;:'\"()-", 5), (b"!?", 6), (b"|", 7), (b" \t\r", 8), (b"\n", 9)):
    _KINDS[list(_chars)] = _kind
_KINDS[128:192] = 10  # later bytes of a character
_KINDS[192:] = 11
SIZE = 14


def style(text: bytes) -> list[float]:
    """Features of a text: shares of kinds of characters, word lengths, repeats."""
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=12) if text else np.zeros(12)
    chars = max(1, len(text) - int(kinds[10]))
    letters = max(1, int(kinds[1] + kinds[2] + kinds[11]))
    words = text.split()
    n = max(1, len(words))
    return [
        float(np.log1p(chars)), kinds[1] / letters, kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, kinds[6] / chars,
        min(1.0, kinds[7] / n), kinds[8] / chars, min(1.0, 10 * kinds[9] / chars), kinds[11] / letters,
        float(np.log1p(len(set(words))) / np.log1p(n)), sum(map(eq, words, words[1:])) / n, min(30.0, chars / n), letters / chars,
    ]


@dataclass(frozen=True)
class Classifier:
    """Log-odds of good, linear in the features, without the base rate."""

    weights: tuple[float, ...]
    bias: float


def evidence(text: Column, model: Classifier) -> Column:
    """Log-odds beyond the base rate, never null: else a filter on it tests it below the joins, and all texts are scored twice."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        found = np.array([style(t.as_py()) for t in texts], np.float64).reshape(-1, SIZE)
        return pa.array(found @ np.array(model.weights) + model.bias)

    return F.coalesce(score(F.coalesce(text, F.lit("")).cast("binary")), F.lit(0.0))


def fitted(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps; labels of one kind, or none, leave no evidence."""
    if len(set(y.tolist())) < 2:
        return Classifier((0.0,) * SIZE, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([RIDGE] * x.shape[1] + [1e-6])
    for _ in range(MOST_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step * min(1.0, 4.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    base = np.log(y.mean() / (1 - y.mean()))
    return Classifier(tuple((w[:-1] / scale).tolist()), float(w[-1] - base - (w[:-1] / scale) @ mean))


def labels_by_id(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``id, good``: one row per labelled id; of several labels the mean is rounded, halves to good. Nulls are no labels."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("good"))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MAX_LABELLED) -> Classifier:
    """``labels`` as from ``labels_by_id``; at most ``most`` of them are used."""
    few = F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).join(few, "id")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([style(t.as_py()) for t in texts], pa.list_(pa.float64()))

    found = rows.select("id", "good", features("text").alias("x")).dropDuplicates(["id"]).orderBy("id").collect()  # bounded by ``most``
    return fitted(np.array([r.x for r in found]).reshape(-1, SIZE), np.array([r.good for r in found], float))


def _strength(groups: DataFrame, rate: Column) -> float:
    """Labels that the prior of a group is worth: from the spread of group rates around ``rate`` beyond chance."""
    n, p = F.col("n"), F.col("good") / F.col("n")
    sums = groups.agg(
        F.sum(n * (p - rate) * (p - rate)).alias("spread"), F.sum(rate * (1 - rate)).alias("chance"), F.sum(n * rate * (1 - rate)).alias("inside"),
        F.sum(n).alias("n"), F.sum(n * n).alias("n2"),
    ).first()
    if not sums["n"]:
        return 1.0
    between = (sums["spread"] - sums["chance"]) / max(sums["n"] - sums["n2"] / sums["n"], 1e-9)
    inside = sums["inside"] / sums["n"]
    return float(min(max(inside / between - 1, 1.0), 1e6)) if between > 0 else 1e6


@dataclass(frozen=True)
class Rates:
    """Global rate of good, and shrunken rates by site and by site and path."""

    rate: float
    sites: DataFrame
    paths: DataFrame


def rates(docs: DataFrame, labels: DataFrame, id_col: str, site: Column, path: Column) -> Rates:
    """Counts labels per site and path (null is a site and a path of its own) and shrinks them."""
    placed = docs.select(F.col(f"`{id_col}`").alias("id"), site.alias("site"), path.alias("path")).dropDuplicates(["id"])
    paths = placed.join(labels, "id").groupBy("site", "path").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    paths = stored(paths)
    sites = paths.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = sites.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    a = _strength(sites, F.lit(rate))
    sites = stored(sites.select("site", ((F.col("good") + a * rate) / (F.col("n") + a)).alias("site_rate")))
    known = paths.join(sites, paths["site"].eqNullSafe(sites["site"])).select(paths["site"], "path", "good", "n", "site_rate")
    b = _strength(known, F.col("site_rate"))
    shrunken = known.select("site", "path", ((F.col("good") + b * F.col("site_rate")) / (F.col("n") + b)).alias("path_rate"))
    return Rates(rate, sites, stored(shrunken))  # stored: its size is known, and small ones are sent to the texts


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, site: Column, path: Column, label_col: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``docs`` as the struct ``row``, with ``evidence``, ``site_rate``, ``path_rate``, ``probability``."""
    known = stored(labels_by_id(labels, id_col, label_col))
    model, groups = train(docs, known, id_col, text_col), rates(docs, known, id_col, site, path)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), site.alias("s"), path.alias("p"), evidence(F.col(f"`{text_col}`"), model).alias("evidence"))
    sites, paths = groups.sites.withColumnRenamed("site", "s1"), groups.paths.withColumnsRenamed({"site": "s2", "path": "p2"})
    joined = rows.join(sites, F.col("s").eqNullSafe(F.col("s1")), "left").join(paths, F.col("s").eqNullSafe(F.col("s2")) & F.col("p").eqNullSafe(F.col("p2")), "left")
    site_rate = F.coalesce("site_rate", F.lit(groups.rate))
    path_rate = F.coalesce("path_rate", site_rate)
    odds = F.col("evidence") + F.log(path_rate / (1 - path_rate))
    return joined.select("row", "evidence", site_rate.alias("site_rate"), path_rate.alias("path_rate"), (1 / (1 + F.exp(-odds))).alias("probability"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", least: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``evidence``, ``site_rate``, ``path_rate``, ``probability``, ``keep``.

    ``labels`` has ``id_col`` and ``label_col`` (1 good, 0 not). Null text counts as empty; a null site or path is a group
    of its own; rows without an id are scored but carry no label. Repeated rows are scored each. Without labels every
    document has probability one half and stays. Other columns are ignored; an empty table gives an empty result.
    """
    found = scored(docs, labels, id_col, text_col, F.col(f"`{site_col}`"), F.col(f"`{path_col}`"), label_col, [id_col])
    return found.select(F.col("row")[id_col].alias(id_col), "evidence", "site_rate", "path_rate", "probability", (F.col("probability") >= least).alias("keep"))


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang",
    label_col: str = "quality", least: float = 0.5,
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_scores`` keeps."""
    found = scored(docs, labels, id_col, text_col, F.col(f"`{site_col}`"), F.col(f"`{path_col}`"), label_col, docs.columns)
    return found.where(F.col("probability") >= least).select("row.*")
