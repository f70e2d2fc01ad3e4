"""Mixing to target weights with soft membership.

A naive Bayes classifier over hashed byte trigrams, trained on labelled documents, gives each document a posterior over
domains. Document rates are then fitted by projected gradient least squares: the expected tokens of each domain (rate x
tokens x posterior, summed over all documents) shall match the targets, with rates between 0 and a largest rate.

A step needs the totals of all documents, one number per domain, and then changes each rate by its own posterior only.
So a rate follows from the short history of steps: a pass over the table gives new totals, no rate is ever stored or
shuffled, and a lost task is simply computed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyloom.llm.common import stored

BUCKETS = 4096
MAX_LABELLED = 5_000  # labelled documents that the classifier is fitted on, by smallest hash of the id
EVIDENCE = 50.0  # trigrams that a text counts for at most: keeps memberships soft
TOLERANCE, MOST_ROUNDS = 1e-4, 40


def trigram_counts(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (b[:-2] * 40503 + b[1:-1] * 7919 + b[2:] * 131) >> 2
    return np.bincount(code & (BUCKETS - 1), minlength=BUCKETS)


@dataclass(frozen=True)
class Domains:
    """Names, log shares of trigram buckets by domain, log priors, and which have labelled documents."""

    names: tuple[str, ...]
    shares: np.ndarray
    priors: np.ndarray
    labelled: np.ndarray

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.names)))
        for i, text in enumerate(texts):
            counts = trigram_counts(text)
            n = max(1, int(counts.sum()))
            z = self.priors + self.shares @ counts * (min(n, EVIDENCE) / n)
            e = np.exp(z - z.max())
            out[i] = e / e.sum()
        return out


def train(docs: DataFrame, labelled_ids: DataFrame, names: list[str], id_col: str, text_col: str, domain_col: str, most: int = MAX_LABELLED) -> Domains:
    """``labelled_ids`` has a column ``id``; the domain of a labelled document stands in ``domain_col``.

    Trigrams are counted by the tasks; a bounded table of domain x bucket comes back. Without labelled documents of a
    domain it is judged by an even distribution.
    """
    few = F.broadcast(labelled_ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most))
    domain = F.col(f"`{domain_col}`").cast("string")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), domain.alias("domain"), text.alias("text")).join(few, "id").where(F.col("domain").isin(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {name: np.zeros(BUCKETS + 1, np.int64) for name in names}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[name][:BUCKETS] += trigram_counts(text.as_py())
                seen[name][BUCKETS] += 1  # documents
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["domain", "bucket", "n"])

    counted = rows.select("domain", "text").mapInArrow(run, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(names), BUCKETS + 1))
    for r in counted.collect():
        table[names.index(r["domain"]), r["bucket"]] = r["n"]
    shares = np.log(table[:, :BUCKETS] + 0.5) - np.log(table[:, :BUCKETS].sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return Domains(tuple(names), shares, np.log(table[:, BUCKETS] + 1) - np.log(table[:, BUCKETS].sum() + len(names)), table[:, BUCKETS] > 0)


def memberships(text: Column, model: Domains) -> Column:
    """Posterior over the domains, in their order."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def judge(texts: pa.Array) -> pa.Array:
        found = model.posteriors([t.as_py() for t in texts])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    return judge(F.coalesce(text, F.lit("")).cast("binary"))


def token_size(text: Column) -> Column:
    """White-space words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r\x0b\x0c]+"), lambda w: w != "")).cast("long")


@dataclass(frozen=True)
class Fit:
    """The steps that turn posteriors into rates, the targets, and the totals they reach."""

    steps: tuple[tuple[float, ...], ...]
    most_rate: float
    targets: tuple[float, ...]
    totals: tuple[float, ...]

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        return rates_after(posteriors, self.steps, self.most_rate)

    @property
    def shortfall(self) -> tuple[float, ...]:
        """Expected tokens that each domain lacks of its target (below 0: has beyond it)."""
        return tuple(t - n if t else 0.0 for t, n in zip(self.targets, self.totals))

    @property
    def met(self) -> bool:
        """Whether all targets are reached within the tolerance."""
        return max(map(abs, self.shortfall), default=0.0) <= TOLERANCE * sum(self.targets)


def rates_after(posteriors: np.ndarray, steps, most_rate: float) -> np.ndarray:
    """Accelerated projected gradient from rate 1: each step moves from a point ahead by posterior . step."""
    now = before = np.full(len(posteriors), min(1.0, most_rate))
    for k, step in enumerate(steps):
        ahead = now + k / (k + 3) * (now - before)
        now, before = np.clip(ahead - posteriors @ np.asarray(step), 0.0, most_rate), now
    return now


def _totals(table: DataFrame, size: int, steps, most_rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens by domain after the steps: at the rates, and at the point ahead of the next step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            tokens = batch.column(0).to_numpy().astype(float)
            p = batch.column(1).flatten().to_numpy().reshape(-1, size)
            now = rates_after(p, steps, most_rate)
            k = len(steps)
            ahead = now + (k / (k + 3) * (now - rates_after(p, steps[:-1], most_rate)) if k else 0)
            sums += np.stack([(now * tokens) @ p, (ahead * tokens) @ p])
        yield pa.record_batch([pa.array(np.arange(2 * size)), pa.array(sums.ravel())], names=["k", "v"])

    rows = table.select("tokens", "posterior").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(2 * size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out[:size], out[size:]


def fit_rates(
    table: DataFrame, weights: dict[str, float], most_rate: float = 1.0, total: float | None = None, labelled: np.ndarray | None = None,
    least_share: float = 0.0,
) -> Fit:
    """``table``: stored ``tokens`` and ``posterior``. Domains without labelled documents are absent: their soft residue
    gets no target, and they leave their weight to the others.

    ``total`` defaults to the most tokens that keep every present domain within ``most_rate`` times what it has.
    ``least_share`` of all tokens, if given, is the least default total. A domain too
    scarce for its target is taken as far as least squares allow; ``Fit.shortfall`` says by how much it is missed.
    """
    size = len(weights)
    has, _ = _totals(table, size, (), 1.0)
    present = has > 0
    if labelled is not None:
        present &= labelled
    w = np.array(list(weights.values()), float) * present
    if not w.sum():
        return Fit((), most_rate, (0.0,) * size, (0.0,) * size)
    w = w / w.sum()
    if total is None:
        total = max(most_rate * min(h / x for h, x in zip(has, w) if x > 0), min(1.0, most_rate) * least_share * has.sum())
    wanted = w * total
    scale = np.where(present, has, 1.0)
    steps: list[tuple[float, ...]] = []
    now, ahead = _totals(table, size, (), most_rate)
    for _ in range(MOST_ROUNDS):
        if np.abs(now - wanted)[present].max() <= TOLERANCE * wanted.sum():
            break
        # with errors weighed by 1 / has, no direction of the normal matrix is longer than 1
        steps.append(tuple(np.where(present, (ahead - wanted) / scale, 0.0).tolist()))
        now, ahead = _totals(table, size, tuple(steps), most_rate)
    return Fit(tuple(steps), most_rate, tuple(wanted.tolist()), tuple(now.tolist()))


def _copies(rate: Column, key: Column) -> Column:
    """Whole copies whose expectation over keys is the rate."""
    share = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + (share < rate - F.floor(rate)).cast("long")).cast("int")


def _rate(posterior: Column, fit: Fit) -> Column:
    @F.arrow_udf(T.DoubleType())
    def rate(rows: pa.Array) -> pa.Array:
        return pa.array(fit.rates(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)) if len(rows) else np.zeros(0))

    return rate(posterior)


def _fitted(docs, labels, weights, id_col, text_col, domain_col, most_rate, total, least_share):
    names = list(weights)
    ids = labels.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL")
    model = train(docs, ids, names, id_col, text_col, domain_col)
    text = F.col(f"`{text_col}`")
    table = stored(docs.select(F.col(f"`{id_col}`").alias("id"), token_size(text).alias("tokens"), memberships(text, model).alias("posterior")))
    return names, model, table, fit_rates(table, weights, most_rate, total, model.labelled, least_share)


def mixing_rates(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
    most_rate: float = 1.0, total: float | None = None, least_share: float = 0.0,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``tokens``, ``domain`` (most probable), ``posterior``, ``rate``, ``copies``.

    Null and empty texts have no tokens and the posterior of the priors. Repeated rows are rated alike; null ids are
    allowed; a null domain carries no label. Other columns are ignored; an empty table gives an empty result.
    """
    names, _, table, fit = _fitted(docs, labels, weights, id_col, text_col, domain_col, most_rate, total, least_share)
    best = F.get(F.array(*map(F.lit, names)), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    rated = table.select("id", "tokens", best.alias("domain"), "posterior", _rate(F.col("posterior"), fit).alias("rate"))
    return rated.select(F.col("id").alias(id_col), "tokens", "domain", "posterior", "rate", _copies(F.col("rate"), F.col("id")).alias("copies"))


def mixing_report(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
    most_rate: float = 1.0, total: float | None = None, least_share: float = 0.0,
) -> DataFrame:
    """``domain, target, total, shortfall, met``: what ``mixing_rates`` of the same arguments aims at and reaches."""
    names, _, _, fit = _fitted(docs, labels, weights, id_col, text_col, domain_col, most_rate, total, least_share)
    rows = [(n, float(t), float(r), float(s), fit.met) for n, t, r, s in zip(names, fit.targets, fit.totals, fit.shortfall)]
    return docs.sparkSession.createDataFrame(rows, "domain string, target double, total double, shortfall double, met boolean")


def mixed(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang",
    most_rate: float = 1.0, total: float | None = None, least_share: float = 0.0,
) -> DataFrame:
    """The rows of ``docs``, all columns, as many times as ``mixing_rates`` has copies of them (at most once by default)."""
    _, model, _, fit = _fitted(docs, labels, weights, id_col, text_col, domain_col, most_rate, total, least_share)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rated = docs.select(row, F.col(f"`{id_col}`").alias("id"), _rate(memberships(F.col(f"`{text_col}`"), model), fit).alias("rate"))
    drawn = rated.select("row", _copies(F.col("rate"), F.col("id")).alias("copies"))
    if most_rate <= 1:
        return drawn.where("copies > 0").select("row.*")
    return drawn.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
