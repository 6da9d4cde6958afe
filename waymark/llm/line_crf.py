"""Quality rules: a linear-chain CRF labels lines as content or boilerplate; content share decides.

The lines of a document with at least one word are a sequence.  Viterbi decoding under emission weights
on line features and transition weights marks each line, and a document is kept if content lines hold
at least ``SHARE`` of its words and the base rules let it pass.

The weights are trained here, by maximum conditional likelihood (forward-backward), on a bounded sample
of labelled documents.  Lines have weak labels (``weak_labels``): all lines of a bad document are
boilerplate, and so is a line of a good one that stands among different neighbours in ``TEMPLATE``
sample documents or more (a footer, a licence line); copies of a document, where the neighbours are
copies too, make no line a template.  So labels change inside documents and all four transitions are
learned.

Defined cases: a null, empty or blank text has no lines and no words, so it fails the base rules, with a
content share of 0; long texts are decoded whole, and trained on whole, in pieces of ``PIECE_LINES``
lines; of equal label scores content wins; repeated rows give one row each; rows without a doc_id
are judged like others but never trained on; labels without a doc_id or quality are passed over, of
contradicting ones the larger counts; without labels of both kinds every line is content; an empty
table gives an empty result; other columns of the tables are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import slices

#: Labelled rows to train on at most (those with the least hashes); all of their lines are used.
SAMPLE_ROWS = 2000
#: Documents whose different neighbours make a line a template.
TEMPLATE = 3
#: Lines of a sequence in training (a longer document is several), and of a batch, padding included.
PIECE_LINES = 128
BATCH_LINES = 25_600
SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
CONTENT, BOILERPLATE = 1, 0

#: Words of notices, as they begin.
NOTICE = re.compile(rb"\b(?:licen[cs]|copyright|rights reserved|privacy|cookie|subscri|terms of)", re.I)

FEATURES = ("bias", "words", "word_length", "symbols", "capitals", "digits", "exclamations", "ending", "repeats_line", "repeats_words", "short", "notice", "first", "last")


def line_features(line: bytes, seen: set[bytes]) -> tuple[list[float], int] | None:
    """Features and word count of a line; None without words. ``seen`` gathers the lines before it."""
    words = line.split()
    if not words:
        return None
    n, size = len(words), len(line)
    again = line in seen
    seen.add(line)
    gone = lambda chars: size - len(line.translate(None, chars))
    rate = lambda x: math.log1p(20 * x)
    return [
        1.0, math.log1p(n) / 4, min(size / n, 30) / 10, rate(gone(b"#*$%&|<>") / n), rate(gone(UPPER) / size), rate(gone(DIGITS) / size), rate(line.count(b"!") / n),
        float(words[-1][-1:] in b".?!"), float(again), rate(1 - len(set(words)) / n) if n > 4 else 0.0, float(n < 16), float(size < 300 and NOTICE.search(line) is not None), 0.0, 0.0,
    ], n


def document_lines(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and word counts of the lines with words."""
    seen: set[bytes] = set()
    found = [x for x in (line_features(line, seen) for line in text.encode().split(b"\n")) if x]
    if found:
        found[0][0][-2] = found[-1][0][-1] = 1.0
    return [f for f, _ in found], [n for _, n in found]


def line_keys(text: str) -> list[int]:
    """A hash of each line with words."""
    return [xxhash.xxh64_intdigest(line) - (1 << 63) for line in text.encode().split(b"\n") if line.split()]


def weak_labels(keys: list[np.ndarray], quality: list[int]) -> list[np.ndarray]:
    """Labels of the lines of each document, given the lines' hashes and the documents' quality."""
    around: dict[int, set[tuple[int, int]]] = {}
    for own in keys:
        line = own.tolist()
        seen: set[int] = set()
        for k, before, after in zip(line, [0, *line], [*line[1:], 0]):
            if k not in seen:  # once per document
                seen.add(k)
                around.setdefault(k, set()).add((before, after))
    template = {k for k, places in around.items() if len(places) >= TEMPLATE}
    return [np.array([CONTENT if q > 0 and k not in template else BOILERPLATE for k in own.tolist()], dtype=np.int64) for own, q in zip(keys, quality)]


class Chain(NamedTuple):
    """emission: label x feature; transition: from x to; start: label."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def viterbi(scores: np.ndarray, chain: Chain) -> list[int]:
    """Best labels of a sequence of emission scores (lines x 2); ties go to content."""
    (a00, a01), (a10, a11) = chain.transition.tolist()
    rows = scores.tolist()
    s0, s1 = rows[0][0] + chain.start[0], rows[0][1] + chain.start[1]
    back = []
    for e0, e1 in rows[1:]:
        b0 = s1 + a10 >= s0 + a00
        b1 = s1 + a11 >= s0 + a01
        s0, s1 = (s1 + a10 if b0 else s0 + a00) + e0, (s1 + a11 if b1 else s0 + a01) + e1
        back.append((b0, b1))
    label = int(s1 >= s0)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def content_share(features: list[list[float]], words: list[int], chain: Chain) -> float:
    """Share of the words in content lines; 0 without words."""
    if not features:
        return 0.0
    labels = viterbi(np.array(features) @ chain.emission.T, chain)
    return sum(n for n, label in zip(words, labels) if label == CONTENT) / sum(words)


def train(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Maximise the mean conditional likelihood of the lines' labels, by Adam on all sequences.

    Without lines of both labels every line counts as content.
    """
    width = len(FEATURES)
    pieces = [(x[i : i + PIECE_LINES], y[i : i + PIECE_LINES]) for x, y in zip(sequences, labels) for i in range(0, len(x), PIECE_LINES)]
    total_lines = sum(len(y) for _, y in pieces)
    if not 0 < sum(int(y.sum()) for _, y in pieces) < total_lines:
        emission = np.zeros((2, width))
        emission[CONTENT, 0] = 1.0
        return Chain(emission, np.zeros((2, 2)), np.zeros(2))
    pieces.sort(key=lambda p: len(p[1]))
    batches = []
    hi = 0
    while hi < len(pieces):
        lo = hi
        while hi < len(pieces) and (hi == lo or (hi + 1 - lo) * len(pieces[hi][1]) <= BATCH_LINES):
            hi += 1
        own = pieces[lo:hi]
        size = np.array([len(y) for _, y in own])
        x, truth = np.zeros((len(own), size.max(), width)), np.zeros((len(own), size.max(), 2))
        for k, (f, y) in enumerate(own):
            x[k, : len(y)] = f
            truth[k, np.arange(len(y)), y] = 1.0
        steps = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        batches.append((x, np.arange(size.max()) < size[:, None], truth, steps))
    theta = np.zeros(2 * width + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = np.zeros_like(theta)
        emission, transition, start = theta[: 2 * width].reshape(2, width), theta[2 * width : 2 * width + 4].reshape(2, 2), theta[-2:]
        for x, live, truth, steps in batches:
            e = x @ emission.T
            longest = e.shape[1]
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0] + start
            for t in range(1, longest):
                a = np.logaddexp(alpha[:, t - 1, 0, None] + transition[0], alpha[:, t - 1, 1, None] + transition[1]) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], a, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                after = e[:, t + 1] + beta[:, t + 1]
                b = np.logaddexp(transition[:, 0] + after[:, 0, None], transition[:, 1] + after[:, 1, None])
                beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
            total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            diff = truth - np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
            grad[: 2 * width] += np.einsum("ntl,ntf->lf", diff, x).ravel()
            grad[-2:] += diff[:, 0].sum(0)
            if longest > 1:
                both = np.exp(alpha[:, :-1, :, None] + transition + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
                grad[2 * width : 2 * width + 4] += (steps - both.sum((0, 1))).ravel()
        grad = grad / total_lines - ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Chain(theta[: 2 * width].reshape(2, width), theta[2 * width : 2 * width + 4].reshape(2, 2), theta[-2:])


def train_on_labels(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    """Train on at most ``rows`` labelled documents, one row per doc_id; their lines' features come to the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t or "" for t in batch.column(1).to_pylist()]
            flat = [[x for f in document_lines(t)[0] for x in f] for t in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(flat, pa.list_(pa.float32())), pa.array(map(line_keys, found), pa.list_(pa.int64()))], names=["doc_id", "lines", "keys"])

    rows_ = texts.mapInArrow(run, "doc_id bigint, lines array<float>, keys array<bigint>").join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("lines", "keys", "quality").toArrow()
    lines, keys, quality = rows_.column(0), rows_.column(1), rows_.column(2).to_pylist()
    features = [x.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(FEATURES)) for x in lines]
    return train(features, weak_labels([x.values.to_numpy(zero_copy_only=False) for x in keys], quality))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    k = len(number)
    if k > 2_000_000:  # three numbers no longer fit one integer
        _, code = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        windows = code[:-1].astype(np.int64) * k + ids[2:]
    else:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def apply_rules(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share and kept of every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, 1, 8 << 20):
                piece = batch.slice(lo, hi - lo)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                counts = [base_counts(t) for t in texts]
                failed = [c[0] < MIN_WORDS or 100 * c[4] > 50 * c[0] for c in counts]
                shares = [content_share(*document_lines(t), chain) for t in texts]
                kept = [not f and s >= share for f, s in zip(failed, shares)]
                columns = [piece.column(0).cast(pa.int64()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(failed, pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "content_share", "kept"])

    schema = ", ".join(["doc_id bigint", *(f"{n} bigint" for n in names), "base_failed boolean", "content_share double", "kept boolean"])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def line_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels' sample and apply the rules to every row of ``docs``."""
    return apply_rules(docs, train_on_labels(docs, labels))
