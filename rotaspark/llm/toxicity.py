"""Toxicity by a factorization machine over hashed terms.

Terms are words and the starts of longer words, hashed; a text is the set of its terms. The machine adds a weight per
term and, for every pair of terms, the product of their factor vectors, so a pair can count for more, or less, than its
terms do alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import staged
from rotaspark.llm.pretokens import span_hashes
from rotaspark.llm.wordhash import alnum_mask, code_points, lower_ascii, word_bounds

HASH_BITS = 20
STARTS = (4, 5)
#: Bounds of the gradient fit: labelled documents, and terms that the machine knows. Terms are counted on all labels.
TRAIN_ROWS = 20_000
TERMS = 4096
FACTORS = 8
#: So many labels, some 40 MB, are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
FOLDS, HELD_FOLD = 4, 2
CUT = 0.3


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text; none for NULL or empty texts."""
    points = lower_ascii(code_points(text))
    begin, end = word_bounds(alnum_mask(points))
    if not begin.size:
        return np.empty(0, np.int32)
    found = [span_hashes(points, begin, end)]
    for n in STARTS:
        longer = begin[end - begin > n]
        found.append(span_hashes(points, longer, longer + n) + np.uint64(n))
    return np.unique((np.concatenate(found) >> np.uint64(64 - HASH_BITS)).astype(np.int32))


class FactorizationMachine:
    """Weights and factors of the known terms; `fit` is stochastic gradient descent with per-parameter step sizes."""

    def __init__(self, known: np.ndarray, factors: int = FACTORS, seed: int = 7) -> None:
        self.place = np.full(1 << HASH_BITS, -1, np.int32)
        self.place[known] = np.arange(known.size, dtype=np.int32)
        draw = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(known.size)
        self.factors = draw.normal(0, 0.01, (known.size, factors))

    def places(self, found: np.ndarray) -> np.ndarray:
        at = self.place[found]
        return at[at >= 0]

    def raw(self, at: np.ndarray) -> float:
        v = self.factors[at]
        return float(self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.places(found)), -30, 30))))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs=8, batch=64, least_steps=1500, rate=0.1, decay=1e-3, seed=7) -> None:
        share = np.clip(labels.mean() if labels.size else 0.0, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        draw, n = np.random.default_rng(seed), len(rows)
        steps = [np.full(1, 1e-2), np.full(self.weights.size, 1e-2), np.full(self.factors.shape, 1e-2)]
        for _ in range(max(epochs, -(-least_steps * batch // max(n, 1))) if n else 0):
            order = draw.permutation(n)
            for a in range(0, n, batch):
                chosen = order[a : a + batch]
                sizes = np.array([rows[i].size for i in chosen])
                at = np.concatenate([rows[i] for i in chosen]).astype(np.int64)
                row = np.repeat(np.arange(chosen.size), sizes)
                v = self.factors[at]
                total = np.zeros((chosen.size, v.shape[1]))
                np.add.at(total, row, v)
                linear = np.bincount(row, self.weights[at], chosen.size)
                squares = np.bincount(row, (v * v).sum(axis=1), chosen.size)
                raw = self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]) / chosen.size
                self.bias -= rate * self._scaled(steps[0], np.array([error.sum()]), slice(None))[0]
                seen, inverse = np.unique(at, return_inverse=True)
                grad = np.bincount(inverse, error[row], seen.size) + decay * self.weights[seen] / chosen.size
                self.weights[seen] -= rate * self._scaled(steps[1], grad, seen)
                pull = error[row, None] * (total[row] - v)
                grad = np.zeros((seen.size, v.shape[1]))
                np.add.at(grad, inverse, pull)
                grad += decay * self.factors[seen] / chosen.size
                self.factors[seen] -= rate * self._scaled(steps[2], grad, seen)

    @staticmethod
    def _scaled(steps: np.ndarray, grad: np.ndarray, at) -> np.ndarray:
        steps[at] += grad * grad
        return grad / np.sqrt(steps[at])


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, n_terms: int = TERMS) -> FactorizationMachine:
    """Fits the machine on labelled documents outside the held-out fold.

    Terms are chosen by chi-squared over all of them, counted in Spark. The gradient fit sees at most `rows`: those of
    smallest hash, so the choice follows the ids alone; the driver gets n_terms terms and these rows' places in them.
    A document with several labels is toxic if one says so; NULL labels and ids teach nothing. Without any labelled row
    every text gets the score of the bias alone.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"))
    last = known.select(place.alias("p")).orderBy("p").limit(rows).agg(F.max("p").alias("p")).first()["p"]
    fits = F.lit(False) if last is None else place <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["d"]).alias("d"))
    known = known.withColumn("fits", fits)
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([terms(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), found], ["doc_id", "toxic", "fits", "terms"])

    data = staged(texts.mapInArrow(run, "doc_id long, toxic int, fits boolean, terms array<int>"), "toxic-terms")
    sums = data.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = float(sums["n"] or 0), float(sums["p"] or 0)
    counts = data.select("toxic", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("p")).where("n >= 3")
    q, s = F.col("n"), F.col("p")
    chi = n * F.pow(s * n - q * p, 2) / (q * (n - q + 1) * (p + 1) * (n - p + 1))
    best = counts.select("term", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(n_terms).collect()
    machine = FactorizationMachine(np.array([r["term"] for r in best], np.int64))
    known_at = machine.place

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = (known_at[np.array(t, np.int64)] for t in batch.column(2).to_pylist())
            cells = pa.array([r[r >= 0].astype("<i4").tobytes() for r in rows_], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["doc_id", "toxic", "places"])

    fitted = data.where("fits").select("doc_id", "toxic", "terms").mapInArrow(keep, "doc_id long, toxic int, places binary").orderBy("doc_id", "places").collect()
    machine.fit([np.frombuffer(r["places"], "<i4") for r in fitted], np.array([r["toxic"] for r in fitted], float))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from CUT on) of every whole text.

    Only the text makes a score; NULL and empty texts get that of the bias. A NULL doc_id is not held out. Repeated
    rows get repeated results, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [machine.score(terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
