"""Toxicity: a cumulative-link (proportional odds) regression over sparse word features.

Grades are ordered: 0 clean, 1 toxic, 2 severely toxic.  One weight vector is
shared by both thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1; expected severity is the sum of P(grade > k).

Labels say only whether a document is toxic.  Of the toxic ones, those whose three
most telling features together speak more clearly than the median's are grade 2,
the others grade 1; so a grade does not grow with the number of words.

Training uses a bounded sample of labelled rows (``sample_bound``, expected
number at most, drawn by a hash of doc_id).  The features of a document are its
distinct words (runs of letters, lower case), and beginnings of four to seven
letters that one, two or three of them share; nothing tells its length.
Those kept are the ``max_features`` that speak most clearly for toxic documents
in the sample.  The feature counts are a Spark
aggregation; only kept features and the sample's sparse rows (both bounded) reach
the driver, where the few thousand weights are fitted.  Every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

SAMPLE_BOUND, MAX_FEATURES, MIN_DOCUMENTS = 12_000, 4096, 3
#: Least z-score of a feature's log odds for it to be kept.
MIN_Z = 3.0
#: Telling features that decide the grade of a toxic document.
STRONGEST = 3
#: Least P(grade > 0) of a document that is toxic: below one half, as toxic documents are far fewer than clean ones in the sample.
REJECT_AT = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> set[str]:
    """Words as they are, and beginnings as ``begin*`` to ``begin***`` by how many words have them."""
    words = set(_WORD.findall(text.lower()))
    begins = Counter(w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k)
    return words | {b + "*" * k for b, n in begins.items() for k in range(1, min(n, 3) + 1)}


@dataclass
class OrdinalModel:
    """Weights of words and the thresholds between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, float] = (8.0, 12.0)

    def __post_init__(self):
        self.begins = {w.rstrip("*") for w in self.weights if w.endswith("*")}

    def above(self, text: str) -> np.ndarray:
        """P(grade > 0), P(grade > 1); the same features as ``features_of``, without those that have no weight."""
        words = set(_WORD.findall(text.lower()))
        if not words:
            return np.zeros(2)
        known = self.begins
        begins = Counter(b for w in words for b in (w[:4], w[:5], w[:6], w[:7]) if b in known and len(b) < len(w))
        # a short word repeats in its own slices, but those are no shorter than it
        found = words | {b + "*" * k for b, n in begins.items() for k in range(1, min(n, 3) + 1)}
        x = sum(map(self.weights.__getitem__, self.weights.keys() & found))
        return 1 / (1 + np.exp(np.array(self.thresholds) - x))


def loss_and_gradient(w: np.ndarray, t: np.ndarray, doc: np.ndarray, feat: np.ndarray, grades: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and its gradient by the weights and by theta_0 and the root of the step to theta_1."""
    n = len(grades)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -35, 35)))
    x = np.bincount(doc, w[feat], n)
    theta = np.array([t[0], t[0] + t[1] ** 2 + 1e-3])
    p = sigmoid(x[:, None] - theta)  # P(grade > k)
    slope = p * (1 - p)
    prob = np.where(grades == 0, 1 - p[:, 0], np.where(grades == 1, p[:, 0] - p[:, 1], p[:, 1])).clip(1e-12)
    # derivative of the log probability by (x - theta_k)
    g0 = np.where(grades == 0, -slope[:, 0], np.where(grades == 1, slope[:, 0], 0)) / prob
    g1 = np.where(grades == 1, -slope[:, 1], np.where(grades == 2, slope[:, 1], 0)) / prob
    gx = (g0 + g1) / n
    gradient = np.concatenate([-np.bincount(feat, gx[doc], len(w)) + l2 * w, [np.sum(gx), np.sum(g1) / n * 2 * t[1]]])
    return float(-np.log(prob).mean() + l2 * (w**2).sum() / 2), gradient


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, l2: float = 2e-4, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, tuple[float, float]]:
    """Maximum likelihood of a three-grade proportional odds model by Adam on the whole sample; rows hold feature numbers."""
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    doc, feat = np.repeat(np.arange(n), size), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    w, t = np.zeros(n_features), np.array([2.0, 1.0])  # theta_0, and the root of the step to theta_1
    state = [np.zeros(n_features + 2) for _ in range(2)]
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(w, t, doc, feat, grades, l2)
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[:-2], t - move[-2:]
    return w, (float(t[0]), float(t[0] + t[1] ** 2 + 1e-3))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([list(features_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))], ["toxic", "words"])


def sample_of(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, toxic): labelled ids, at most ``bound`` expected; an id with several labels is toxic if any says so."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, bound / max(1, known.count()))
    return known.filter(F.crc32(F.concat(F.lit("sample "), F.col("doc_id").cast("string"))) < F.lit(int(share * 2**32)))


def train(docs: DataFrame, labels: DataFrame, sample_bound: int = SAMPLE_BOUND, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit on (doc_id, text) and (doc_id, toxic); without toxic or without clean examples nothing is toxic."""
    sample = docs.join(F.broadcast(sample_of(labels, sample_bound)), "doc_id")  # bounded by sample_bound
    words = sample.select("toxic", "text").mapInArrow(_words, "toxic int, words array<string>").cache()
    try:
        totals = {r["toxic"]: r["count"] for r in words.groupBy("toxic").count().collect()}
        toxic, clean = sum(n for k, n in totals.items() if k), totals.get(0, 0)
        if not toxic or not clean:
            return OrdinalModel()
        half = F.lit(0.5)
        odds = lambda n, total: F.log((n + half) / (F.lit(total) - n + half))
        counts = words.select((F.col("toxic") > 0).alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
        z = (odds(F.col("t"), toxic) - odds(F.col("c"), clean)) / F.sqrt(1 / (F.col("t") + half) + 1 / (F.col("c") + half))
        best = counts.filter((F.col("t") + F.col("c") >= MIN_DOCUMENTS) & (z >= MIN_Z)).select("word", z.alias("z")).orderBy(F.desc("z"), "word").limit(max_features).collect()
        vocabulary, telling = [r["word"] for r in best], np.array([r["z"] for r in best])
        number = {w: i for i, w in enumerate(vocabulary)}
        kept = words.select("toxic", F.array_intersect("words", F.lit(vocabulary) if vocabulary else F.array().cast("array<string>")).alias("words"))
        rows = kept.groupBy((F.col("toxic") > 0).alias("toxic"), F.array_sort("words").alias("words")).count().collect()
    finally:
        words.unpersist()
    per_doc = [(np.array([number[w] for w in r["words"]], np.int64), bool(r["toxic"])) for r in sorted(rows, key=lambda r: (r["toxic"], r["words"])) for _ in range(r["count"])]
    strength = np.array([np.sort(telling[f])[-STRONGEST:].sum() for f, _ in per_doc])
    toxic_rows = np.array([t for _, t in per_doc])
    grades = np.where(toxic_rows, 1 + (strength > np.median(strength[toxic_rows])), 0)
    weights, thresholds = fit_cumulative_link([f for f, _ in per_doc], grades, len(vocabulary))
    return OrdinalModel(dict(zip(vocabulary, weights.tolist())), thresholds)


def _score(model: OrdinalModel, reject_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = np.array([model.above(t) for t in b.column("text").to_pylist()]).reshape(-1, 2)
            grade = np.where(p[:, 0] < reject_at, 0, np.where(p[:, 1] >= 0.5, 2, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(grade, pa.int32()), pa.array(p[:, 0] >= reject_at)], ["doc_id", "severity", "p_toxic", "grade", "rejected"])

    return run


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """One row for each document: doc_id, severity (expected grade), p_toxic, grade, rejected.

    Null and empty texts, and others without a word, are clean; repeated rows are
    scored each; an empty input gives an empty result; other columns are ignored.
    """
    return documents(docs, id_col, text_col).mapInArrow(_score(model, reject_at), "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def rejection(model: OrdinalModel, reject_at: float = REJECT_AT):
    """A function of a text column: true where the text is toxic; null is not."""

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: bool(model.above(t)[0] >= reject_at))

    return rejected


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT, **training) -> DataFrame:
    """Train on the labelled documents and score all."""
    model = train(documents(docs, id_col, text_col), labels, **training)
    return score(docs, model, id_col, text_col, reject_at)
