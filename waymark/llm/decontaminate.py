"""Benchmark passages inside documents: q-gram lemma filtering, then banded alignment.

A passage of m characters that occurs in a text with at most k edits shares at least
m + 1 - q (k + 1) q-grams with it, and they lie on diagonals (text place less passage place) that
differ by k at most.  So the shared q-grams are counted in overlapping diagonal bands; a band is
2 (k + 1) diagonals wide and begins every k + 1 diagonals, so each possible match lies wholly in one.
Bands that meet the bound are aligned, restricted to the band, and kept if k edits suffice.

Texts are compared in lower case with white space runs as one space.  The edit budget k of a passage is
``EDIT_RATE`` of its characters, ``MOST_EDITS`` at most, and never so many that the bound asks for no
q-gram; a passage shorter than q must occur as it is.

The passages are the small side: they reach the executors in blocks of ``BLOCK_CHARS`` characters, each
a pass over all documents, so their number has no limit; documents are never exchanged.  A worker
builds a block's index once.  Memory stays bounded whatever the texts and passages: where q-grams are
frequent (a long run of one character), their occurrences are counted for fewer passages at a time, and
for a single passage in steps, never more than ``PAIRS`` at once.

Defined cases: a null text or passage is empty; an empty passage is found nowhere; a passage with a null
item_id is reported under a null item_id; of passages with one item_id the best match is reported; of
matches the one with the fewest edits, then the first; repeated documents are reported each; an empty
benchmark finds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import mix64, slices

Q = 10
#: Edits per passage character, and at most.
EDIT_RATE = 0.07
MOST_EDITS = 100
#: Characters of passages in one pass over the documents; bytes of text in one array pass.
BLOCK_CHARS = 8 << 20
PASS_BYTES = 1 << 20
#: Characters of text searched at once; pairs of text and passage places counted at once; cells of an
#: alignment's rows; bits of the filter.
WINDOW = 1 << 21
PAIRS = 1 << 20
CELLS = 1 << 18
FILTER_BITS = 20

BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of an array of code points."""
    if len(x) < q:
        return np.empty(0, np.uint64)
    h = np.zeros(len(x) - q + 1, np.uint64)
    for i in range(q):
        h *= BASE
        h += x[i : i + len(h)]
    return mix64(h)


class Passages(NamedTuple):
    """An index of the q-grams of a block of passages."""

    item: list[int | None]
    chars: np.ndarray  # of all passages, one after the other
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    filter: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    of: np.ndarray  # per occurrence of a gram, ascending within it
    place: np.ndarray


def edits_allowed(m: int, q: int, rate: float) -> int:
    """The edit budget of a passage: its rate, but never so many that the bound asks for no q-gram."""
    return max(0, min(int(rate * m), MOST_EDITS, (m - q) // q)) if m >= q else 0


def index_passages(items: list[tuple[int | None, str]], q: int = Q, rate: float = EDIT_RATE) -> Passages:
    """Passages shorter than q have no grams: find() looks for them as they are."""
    kept = [(i, codes(t)) for i, t in items if t]
    size = np.array([len(x) for _, x in kept], dtype=np.int64)
    edits = np.array([edits_allowed(int(m), q, rate) for m in size], dtype=np.int64)
    grams = np.maximum(size - q + 1, 0)
    h = np.concatenate([gram_hashes(x, q) for _, x in kept] or [np.empty(0, np.uint64)])
    by = np.argsort(h, kind="stable").astype(np.int32)
    gram, first = np.unique(h[by], return_index=True)
    of = np.repeat(np.arange(len(kept), dtype=np.int32), grams)
    place = (np.arange(len(h)) - np.repeat(np.cumsum(grams) - grams, grams)).astype(np.int32)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    chars = np.concatenate([x for _, x in kept] or [np.empty(0, np.uint32)])
    return Passages([i for i, _ in kept], chars, np.cumsum(size) - size, size, edits, np.maximum(1, size + 1 - q * (edits + 1)), seen, gram, np.append(first, len(h)).astype(np.int64), of[by], place[by])


def gram_places(x: np.ndarray, p: Passages, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text whose q-gram some passage has, and the gram's number."""
    at_, k_ = [], []
    for lo in range(0, max(len(x) - q + 1, 0) if len(p.gram) else 0, PASS_BYTES):
        h = gram_hashes(x[lo : lo + PASS_BYTES + q - 1], q)
        at = np.flatnonzero(p.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        k = np.searchsorted(p.gram, h[at])
        k[k == len(p.gram)] = 0
        good = p.gram[k] == h[at]
        at_.append(lo + at[good])
        k_.append(k[good].astype(np.int32))
    return np.concatenate([*at_, np.empty(0, np.int64)]), np.concatenate([*k_, np.empty(0, np.int32)])


def shared_bands(x: np.ndarray, p: Passages, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage, first diagonal) of each band of the text that meets the q-gram bound, passage by passage."""
    at, k = gram_places(x, p, q)
    if not len(at):
        return
    # A band's number; diagonals are counted from the longest passage's length on, so none is negative.
    base = int(p.size.max())
    width = np.int64(len(x) + 2 * base + 2)

    def pairs(at: np.ndarray, lo: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        of = p.of[entry].astype(np.int64)
        return of, (np.repeat(at, times) - p.place[entry] + base) // (p.edits[of] + 1)

    def within(at: np.ndarray, k: np.ndarray, p0: int, p1: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bands of the passages from p0 to p1, given the places of their grams."""
        lo, hi = p.first[k], p.first[k + 1]
        if p0 or p1 < len(p.size):  # the occurrences of a gram are in the order of passages
            unique, inverse = np.unique(k, return_inverse=True)
            cuts = [(a + np.searchsorted(p.of[a:z], (p0, p1))).tolist() for a, z in zip(p.first[unique].tolist(), p.first[unique + 1].tolist())]
            lo, hi = (np.array(c, dtype=np.int64)[inverse] for c in zip(*cuts))
            some = hi > lo
            at, k, lo, hi = at[some], k[some], lo[some], hi[some]
        times = hi - lo
        total = int(times.sum())
        if total <= PAIRS:
            of, band = pairs(at, lo, times)
            keys, counts = np.unique(np.concatenate([of * width + band, of * width + band - 1]), return_counts=True)
            of, band = keys // width, keys % width
            keep = (counts >= p.bound[of]) & (band < width - 1)
            yield of[keep], band[keep] * (p.edits[of[keep]] + 1) - base
        elif p1 - p0 > 1:
            middle = (p0 + p1) // 2
            yield from within(at, k, p0, middle)
            yield from within(at, k, middle, p1)
        else:
            step = int(p.edits[p0]) + 1
            counts = np.zeros((len(x) + base) // step + 2, np.int64)
            by = np.argsort(k, kind="stable")
            grams = np.append(np.flatnonzero(np.diff(k[by], prepend=-1)), len(k))
            usual = np.ones(len(k), bool)
            for g in np.flatnonzero(np.diff(grams) * times[by[grams[:-1]]] > PAIRS).tolist():
                # A gram that is frequent on both sides: count its text places below each band's ends.
                own = by[grams[g] : grams[g + 1]]
                usual[own] = False
                below = np.concatenate([[0], np.cumsum(np.bincount(at[own], minlength=len(x)))])
                first = np.arange(len(counts)) * step - base
                for place in p.place[lo[own[0]] : hi[own[0]]].tolist():
                    counts += below[np.clip(first + place + 2 * step, 0, len(x))] - below[np.clip(first + place, 0, len(x))]
            at, lo, times = at[usual], lo[usual], times[usual]
            ends = np.cumsum(times)
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - times[i] + PAIRS, "right")))
                band = np.bincount(pairs(at[i:j], lo[i:j], times[i:j])[1], minlength=len(counts))
                counts += band
                counts[:-1] += band[1:]
                i = j
            found = np.flatnonzero(counts >= p.bound[p0])
            yield np.full(len(found), p0), found * step - base

    yield from within(at, k, 0, len(p.size))


def align(x: np.ndarray, p: Passages, of: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each passage within its band, and the text place where that alignment ends.

    All bands advance together, one passage character per step; columns are diagonals.
    """
    if not len(of):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = int(2 * (p.edits[of].max() + 1))
    column = np.arange(width)
    inside = column < 2 * (p.edits[of] + 1)[:, None]
    far = 1 << 20
    base = diagonal[:, None] + column
    cost = np.where(inside, 0, far)
    edits, end = np.full(len(of), far), np.zeros(len(of), np.int64)
    last = {int(n): np.flatnonzero(p.size[of] == n) for n in np.unique(p.size[of])}
    char = p.start[of]
    for j in range(max(last)):
        where = base + j
        text = x[np.clip(where, 0, len(x) - 1)]
        own = p.chars[np.minimum(char + j, len(p.chars) - 1)][:, None]
        new = cost + ((text != own) | (where < 0) | (where >= len(x)))
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        new = np.minimum.accumulate(new - column, axis=1) + column
        cost = np.where(inside, new, far)
        if (done := last.get(j + 1)) is not None:
            best = cost[done].argmin(1)
            edits[done] = cost[done, best]
            end[done] = diagonal[done] + best + j + 1
    return edits, end


def find(texts: list[str], p: Passages, q: int = Q) -> list[tuple[int, int | None, int, int]]:
    """(text number, item_id, edits, end place in the normal form) of the passages in some texts.

    One row per text and item, the match with the fewest edits, then the first.
    """
    gap = int(p.edits.max(initial=0)) + q
    best: dict[tuple[int, int], tuple[int, int]] = {}  # text number and passage
    x = codes(("\0" * gap).join(texts) + "\0" * gap)
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + gap
    start = np.cumsum(sizes) - sizes
    overlap = int(p.size.max(initial=0)) + 2 * (int(p.edits.max(initial=0)) + 1)

    def candidates() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bands of the whole text, which is gone through in windows that overlap by the longest passage."""
        for lo in range(0, len(x), WINDOW):
            for of, diagonal in shared_bands(x[lo : lo + WINDOW + overlap], p, q):
                yield of, diagonal + lo

    for of, diagonal in candidates():
        # Bands of like passages together, a passage's bands in the order of the text.
        by = np.argsort(p.size[of], kind="stable")
        of, diagonal = of[by], diagonal[by]
        text_of = np.searchsorted(start, np.maximum(diagonal, 0), "right") - 1
        lo = 0
        while lo < len(of):
            hi = min(len(of), lo + max(1, CELLS // int(2 * (p.edits[of[lo:]].max() + 1))))
            a, d, t0 = of[lo:hi], diagonal[lo:hi], text_of[lo:hi]
            lo = hi
            # A band that lies in one text, where the passage was already found without an edit, can't do better.
            inside = (d >= start[t0]) & (d + p.size[a] + 2 * (p.edits[a] + 1) <= start[t0] + sizes[t0])
            open_ = np.array([not i or best.get((t, n), (1, 0))[0] > 0 for i, t, n in zip(inside.tolist(), t0.tolist(), a.tolist())], dtype=bool)
            a, d = a[open_], d[open_]
            edits, end = align(x, p, a, d)
            for n in np.flatnonzero(edits <= p.edits[a]).tolist():
                t = int(np.searchsorted(start, max(end[n] - 1, 0), "right")) - 1
                key, value = (t, int(a[n])), (int(edits[n]), int(end[n] - start[t]))
                if key not in best or value < best[key]:
                    best[key] = value
    for n in np.flatnonzero(p.size < q).tolist():  # no q-gram to count: these must occur as they are
        item = p.chars[p.start[n] : p.start[n] + p.size[n]].tobytes().decode("utf-32-le", "surrogatepass")
        for t, text in enumerate(texts):
            if (at := text.find(item)) >= 0:
                best[t, n] = (0, at + len(item))
    rows: dict[tuple[int, int | None], tuple[int, int]] = {}
    for (t, n), value in best.items():
        key = (t, p.item[n])
        rows[key] = min(value, rows.get(key, value))
    return sorted(((t, i, e, z) for (t, i), (e, z) in rows.items()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))


Block = list[tuple[int | None, str]]


def passage_blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[Block]:
    """The passages (item_id, text in normal form) in blocks of bounded size; empty ones are passed over."""
    block: Block = []
    held = 0
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if block and held + len(text) > limit and (row["item_id"] is None or row["item_id"] != block[-1][0]):
            yield block
            block, held = [], 0
        if text:
            block.append((row["item_id"], text))
            held += len(text)
    yield block


_indexes: dict[int, Passages] = {}


def worker_index(number: int, block: Callable[[], Block]) -> Passages:
    """A block's index, built once per Python worker and kept until another block is asked for."""
    if number not in _indexes:
        _indexes.clear()
        _indexes[number] = index_passages(block())
    return _indexes[number]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, ends_at for each passage found in each row of ``docs``.

    Passages with one item_id share a block; only those without one may be reported once per block.
    """
    schema = "doc_id bigint, item_id bigint, edits int, ends_at bigint"
    context = docs.sparkSession.sparkContext

    def finder(block: Numbered):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = worker_index(block.id, lambda: block.value)
                for lo, hi in slices(batch, 1, PASS_BYTES):
                    piece = batch.slice(lo, hi - lo)
                    ids = piece.column(0).to_pylist()
                    rows = [(ids[t], i, e, z) for t, i, e, z in find([normal(t or "") for t in piece.column(1).to_pylist()], p)]
                    columns = list(zip(*rows)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "edits", "ends_at"])

        return run

    found = None
    for block in passage_blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(finder(numbered(context, block)), schema)
        found = part if found is None else found.unionAll(part)
    return found


class Numbered:
    """A broadcast block with a number that workers know it by."""

    def __init__(self, number: int, held) -> None:
        self.id, self.held = number, held

    @property
    def value(self) -> Block:
        return self.held.value


def numbered(context, block: Block) -> Numbered:
    return Numbered(uuid.uuid4().int, context.broadcast(block))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; columns are unchanged."""
    at = docs.columns.index("text")
    context = docs.sparkSession.sparkContext

    def dropper(block: Numbered):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = worker_index(block.id, lambda: block.value)
                for lo, hi in slices(batch, at, PASS_BYTES):
                    piece = batch.slice(lo, hi - lo)
                    keep = np.ones(piece.num_rows, bool)
                    keep[[t for t, *_ in find([normal(t or "") for t in piece.column(at).to_pylist()], p)]] = False
                    yield piece.filter(pa.array(keep))

        return run

    for block in passage_blocks(benchmark):
        docs = docs.mapInArrow(dropper(numbered(context, block)), docs.schema)
    return docs
