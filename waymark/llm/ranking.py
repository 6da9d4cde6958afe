"""Quality scores by Bradley-Terry pairwise ranking, cut at a score quantile.

Every document is a vector of surface features.  Preference pairs set a labelled good document above
a labelled bad one; the weights minimise the logistic loss of the pairs' feature differences (the
Bradley-Terry likelihood).  The cut is a quantile of the training scores: the level that separates the
training labels best.  Scores are then put on 0..1 so that the cut lies at ``CUT``.

The fit sees a bounded sample, ``SAMPLE_ROWS`` labelled rows with the smallest hashes; scoring sees
every whole text.

Defined cases: a null text counts as empty, and an empty text has the features of no words; long texts
are scored whole; equal texts have equal scores, and repeated rows a row each; of labels that contradict
the larger counts, and rows or labels without a doc_id or quality don't train; without labels of both
kinds all documents score alike, above the cut; of quantiles that separate the labels equally well the
lowest is the cut; an empty table gives an empty result; columns called ``score`` or ``predicted`` are
replaced, others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import slices

SAMPLE_ROWS = 6000
OPPONENTS = 8
CUT = 0.3
FOLDS = 5

UPPER = bytes(range(65, 91))
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
CLIP = 6.0
#: log1p(rate * SPREAD) tells small rates apart and keeps large ones bounded.
SPREAD = 50.0

FEATURES = ("words", "word_length", "symbols", "capitals", "digits", "exclamations", "stops", "distinct_words", "distinct_pairs", "repeated_lines", "line_ends")


def features(text: str) -> list[float]:
    """Surface features of a whole text; an empty text has those of no words."""
    data = text.encode()
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    gone = lambda chars: (len(data) - len(data.translate(None, chars)))
    rate = lambda x: math.log1p(SPREAD * x)
    lines = [x for x in data.split(b"\n") if x]
    return [
        math.log1p(len(words)),
        math.log1p(size / n),
        rate(gone(SYMBOLS) / n),
        rate(gone(UPPER) / size),
        rate(gone(DIGITS) / size),
        rate(data.count(b"!") / n),
        rate(data.count(b".") / n),
        rate(1 - len(set(words)) / n) if words else 0.0,
        rate(1 - len(set(zip(words, words[1:]))) / (len(words) - 1)) if len(words) > 1 else 0.0,
        rate(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        rate(len(lines) / n),
    ]


class Ranking(NamedTuple):
    """A fitted model: standardised features times weights, less the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1, rising with the raw score, ``CUT`` at the cut."""
        z = self.raw(x) - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = 60, ridge: float = 1e-3) -> Ranking:
    """Fit weights to preference pairs (each document meets ``OPPONENTS`` of the other label).

    With labels of one kind only there are no pairs: every document then scores alike, above the cut.
    """
    width = len(FEATURES)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), -1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    good, bad = z[y == 1], z[y == 0]
    rng = np.random.default_rng(seed)
    winners = np.concatenate([np.repeat(np.arange(len(good)), OPPONENTS), rng.integers(0, len(good), len(bad) * OPPONENTS)])
    losers = np.concatenate([rng.integers(0, len(bad), len(good) * OPPONENTS), np.repeat(np.arange(len(bad)), OPPONENTS)])
    d = good[winners] - bad[losers]
    w = np.zeros(width)
    for _ in range(rounds):  # Newton steps on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width), d.T @ p / len(d) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    # Errors of each class if the k lowest scores are rejected; both classes count alike.
    ones = y[order] == 1
    lost = np.concatenate([[0], np.cumsum(ones)]) / len(good)
    passed = 1 - np.concatenate([[0], np.cumsum(~ones)]) / len(bad)
    level = int(np.argmin(lost + passed))
    lo, hi = raw[order[max(level - 1, 0)]], raw[order[min(level, len(raw) - 1)]]
    return Ranking(mean, scale, w, float((lo + hi) / 2))


def held_out(doc_id) -> F.Column:
    """Rows whose crc32(doc_id as text) is divisible by ``FOLDS``; a missing doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and features of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, features array<double>")


def fit_on_labels(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ranking:
    """Fit on at most ``rows`` labelled documents that are not held out.

    Rows without doc_id or label are passed over; of labels that contradict, the larger counts, and of
    rows with one doc_id, one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    got = feature_rows(texts).join(F.broadcast(sample), "doc_id").select("features", "quality").toArrow()
    x = np.array(got.column("features").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got.column("quality").to_numpy())


def score_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """``docs`` with columns score and predicted; all other columns pass through."""
    names = docs.columns
    at = names.index("text")
    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")
    keep = [i for i, c in enumerate(names) if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, at, 8 << 20):
                piece = batch.slice(lo, hi - lo)
                x = np.array([features(t or "") for t in piece.column(at).to_pylist()])
                score = model.score(x)
                columns = [piece.column(i) for i in keep] + [pa.array(score), pa.array((score >= CUT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(names[i] for i in keep), "score", "predicted"])

    return docs.mapInArrow(run, schema)


def rank_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; a null text counts as empty."""
    model = fit_on_labels(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
