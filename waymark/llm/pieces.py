"""SentencePiece encoding by a batched numpy Viterbi, and decoding.

A text is the best-scoring sequence of pieces: the sum of the pieces' scores is the largest, and of
equal sums the one with the longer last piece wins, word by word from the end.  Words (with the
spaces before them) are independent, since no piece goes past one.  Unseen words of one length advance
together: the hashes of all their substrings of each length probe the sorted keys of the pieces of
that length, and for each end the maximum over the lengths stores score and backpointer.

The vocabulary may have been made by merging (BPE): its scores, the negative ranks, are then used as
the scores they are, which is what the library's lattice search does if told that the same pieces are a
unigram model; it is not the order of merges.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.common import slices

SPACE = "▁"
#: Words that a worker remembers, and their characters, at most.
CACHE_WORDS = 300_000
CACHE_CHARS = 8 << 20
#: Words of more characters (text without spaces) are decoded one by one, in segments of so many.
LONG_WORD, SEGMENT = 1024, 1 << 16
#: Fixed values of the format: piece types, and how much an unknown character costs.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Pieces, scores and flags of a model file, with the encoder's and decoder's tables."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        for number, value in model:
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
        normaliser = dict(fields(dict(model).get(3, b"")))
        if normaliser.get(2):
            raise ValueError("only models that leave characters as they are can be used")
        if normaliser.get(4, 1):
            raise ValueError("models that drop extra spaces can't be used")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        usable = [(p, s, i) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (NORMAL, USER_DEFINED) and p]
        low = min((s for _, s, i in usable if self.types[i] == NORMAL), default=0.0)
        high = max((s for _, s, i in usable if self.types[i] == NORMAL), default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        usable = [(p, len(p.encode()) * high - 0.1 if self.types[i] == USER_DEFINED else s, i) for p, s, i in usable]
        self.longest = max(len(p) for p, _, _ in usable)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by length: sorted keys, scores, ids
        for n in range(1, self.longest + 1):
            own = [x for x in usable if len(x[0]) == n]
            chars = np.array([[ord(c) for c in p] for p, _, _ in own], dtype=np.uint64).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for i in range(n):
                h = h * BASE + chars[:, i]
            by = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces have one key")
            self.tables.append((h[by], np.array([x[1] for x in own])[by], np.array([x[2] for x in own], dtype=np.int64)[by]))
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        # A line end that no piece holds parts words too.
        self.line_ends = not any("\n" in p for p, _, _ in usable)
        self.runs = any(len(p) > 1 and not p.strip(SPACE) for p, _, _ in usable)
        if any(SPACE in p[1:] and p.strip(SPACE) for p, _, _ in usable):
            raise ValueError("pieces that hold a space after other characters can't be used")
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else (" ⁇ " if t == UNKNOWN else p.replace(SPACE, " ")).encode() for p, t in zip(self.pieces, self.types)]
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {"": b""}
        self.chars = {SPACE: 0, "": 0}

    # --- Viterbi ---

    def viterbi(self, words: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each row of ``words`` (code points; all of one length)."""
        n, size = words.shape
        spans = min(size, self.longest)
        score = np.full((spans, n, size), -np.inf)  # [length - 1, word, start]
        ids = np.full((spans, n, size), -1, np.int64)
        h = np.zeros((n, size), np.uint64)
        for k in range(spans):
            width = size - k
            h = h[:, :width] * BASE + words[:, k:]
            keys, scores, own = self.tables[k]
            if not len(keys):
                continue
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = keys[at] == h
            score[k, :, :width][hit] = scores[at[hit]]
            ids[k, :, :width][hit] = own[at[hit]]
        lone = ids[0] < 0
        score[0][lone] = self.unknown_score
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            reach = range(min(end, spans), 0, -1)  # longer pieces first: they win ties
            options = np.stack([best[:, end - k] + score[k - 1, :, end - k] for k in reach], axis=1)
            pick = options.argmax(1)
            best[:, end] = options[np.arange(n), pick]
            back[:, end] = min(end, spans) - pick
        # Walk all words back together.
        out = np.full((n, size), -2, np.int64)
        end = np.full(n, size)
        live = np.arange(n)
        while len(live):
            k = back[live, end[live]]
            start = end[live] - k
            out[live, start] = ids[k - 1, live, start]
            end[live] = start
            live = live[start > 0]
        return [row[row > -2] for row in out] if (out < -1).any() else list(out)

    def long_viterbi(self, word: str) -> np.ndarray:
        """Piece ids of one word of any length, as ``viterbi`` gives them, in memory for a few bytes a character.

        Substring hashes of a segment of starts probe the keys together; the hits, which are few, then go
        forward start by start.  Of equal sums the longer piece was there first.
        """
        chars = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n = len(chars)
        best = np.full(n + 1, -np.inf)
        best[0] = 0.0
        back, own = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        for lo in range(0, n, SEGMENT):
            hi = min(lo + SEGMENT, n)
            some = chars[lo : hi + self.longest].astype(np.uint64)
            h = np.zeros(len(some), np.uint64)
            starts, sizes, scores, ids = [], [], [], []
            for k in range(min(self.longest, n - lo)):
                width = min(hi - lo, len(some) - k)
                h = h[:width] * BASE + some[k : k + width]
                keys, score, names = self.tables[k]
                hit = np.empty(0, np.int64)
                if len(keys):
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    hit = np.flatnonzero(keys[at] == h)
                    starts.append(hit)
                    sizes.append(np.full(len(hit), k + 1))
                    scores.append(score[at[hit]])
                    ids.append(names[at[hit]])
                if k == 0:
                    lone = np.setdiff1d(np.arange(width), hit)
                    starts.append(lone)
                    sizes.append(np.ones(len(lone), np.int64))
                    scores.append(np.full(len(lone), self.unknown_score))
                    ids.append(np.full(len(lone), -1))
            start, size, score, name = (np.concatenate(x) for x in (starts, sizes, scores, ids))
            order = np.lexsort((size, start))
            reach = best[lo : hi + self.longest + 1].tolist()
            for i, k, s, p in zip(start[order].tolist(), size[order].tolist(), score[order].tolist(), name[order].tolist()):
                total = reach[i] + s
                if total > reach[i + k]:
                    reach[i + k] = total
                    back[lo + i + k], own[lo + i + k] = k, p
            best[lo : hi + self.longest + 1] = reach
        out = []
        end = n
        while end:
            out.append(own[end])
            end -= back[end]
        return np.array(out[::-1], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words as they are, spaces already replaced."""
        result: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                result[i] = self.packed(self.long_viterbi(w), w)
            elif w:
                by_size.setdefault(len(w), []).append(i)
        for size, own in by_size.items():
            step = max(1, (1 << 20) // (size * min(size, self.longest)))
            for lo in range(0, len(own), step):
                some = own[lo : lo + step]
                chars = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(-1, size)
                for i, ids in zip(some, self.viterbi(chars.astype(np.uint64))):
                    result[i] = self.packed(ids, words[i])
        return result

    def packed(self, ids: np.ndarray, word: str) -> bytes:
        """Unknown characters become their bytes if the model has byte pieces, else one unknown."""
        if (ids < 0).any():
            full, at, joined = [], 0, False
            for i in ids.tolist():
                if i >= 0:
                    full.append(i)
                    at += len(self.pieces[i])
                    joined = False
                    continue
                if self.byte_ids:
                    full.extend(self.byte_ids[b] for b in word[at].encode())
                elif not joined:
                    full.append(self.unknown)
                    joined = True
                at += 1
            return np.array(full, dtype=self.dtype).tobytes()
        return ids.astype(self.dtype).tobytes()

    # --- texts ---

    def _learn(self, memory: dict[str, bytes], wanted: set[str], before: str) -> None:
        missing = wanted.difference(memory)
        if not missing:
            return
        chars = sum(map(len, missing))
        if len(memory) + len(missing) > CACHE_WORDS or self.chars[before] + chars > CACHE_CHARS:
            memory.clear()
            self.bare.setdefault("", b"")
            missing, chars, self.chars[before] = wanted, sum(map(len, wanted)), 0
        self.chars[before] += chars
        new = list(missing)
        memory.update(zip(new, self.encode_words([before + w for w in new])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; an empty text has none."""
        plans: list[list[list[str]] | None] = []
        slow: dict[int, list[str]] = {}
        spaced: set[str] = set()
        bare: set[str] = {""}
        for i, text in enumerate(texts):
            plan = [line.split(" ") for line in text.split("\n")] if self.line_ends and text else None
            if not text or SPACE in text or not self.line_ends or self.runs and ("  " in text or text[:1] == " "):
                plan = None
                if text:
                    whole = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
                    slow[i] = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", whole)
                    bare.update(slow[i])
            else:
                for n, ws in enumerate(plan):
                    (spaced if n == 0 and self.dummy_prefix else bare).add(ws[0])
                    spaced.update(ws[1:])
            plans.append(plan)
        self._learn(self.spaced, spaced, SPACE)
        self._learn(self.bare, bare, "")
        out = []
        line_end = np.array([self.byte_ids[10]] if self.byte_ids else [self.unknown], dtype=self.dtype).tobytes()
        get_spaced, get_bare = self.spaced.__getitem__, self.bare.__getitem__
        for i, plan in enumerate(plans):
            if plan is None:
                out.append(b"".join(map(get_bare, slow.get(i, ()))))
                continue
            parts = []
            for n, ws in enumerate(plan):
                parts.append(line_end if n else b"")
                parts.append((get_spaced if n == 0 and self.dummy_prefix else get_bare)(ws[0]))
                parts.extend(map(get_spaced, ws[1:]))
            out.append(b"".join(parts))
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, self.dtype).tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def worker_model(path: str) -> PieceModel:
    """One model per Python worker: what it has learned serves the worker's later tasks too."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), round_trip (decoding gives the text back) of every row.

    A null text counts as empty: no ids, and it decodes to the empty text.  A text that holds the
    space mark U+2581 decodes with spaces in its place, so its round trip is false.  Long texts are
    encoded whole, in little memory also without any space.  Repeated rows give a row each, rows
    without a doc_id one with a null; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(model_path)
        for batch in batches:
            for lo, hi in slices(batch, 1, 4 << 20):
                piece = batch.slice(lo, hi - lo)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                packed = model.encode(texts)
                size = np.array([len(b) // model.dtype.itemsize for b in packed], dtype=np.int64)
                ids = np.frombuffer(b"".join(packed), model.dtype).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids))
                same = [model.decode(b) == t for b, t in zip(packed, texts)]
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(size), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")
