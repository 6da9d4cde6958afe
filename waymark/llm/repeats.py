"""Removal of byte strings that also occur in an earlier document, by prefix-free parsing.

Definition: a byte of a document goes if it lies in a string of ``LENGTH`` (50) bytes that also starts
in a document with a smaller doc_id.  Strings are judged on the input; matches never cross documents.

Method, on two levels.
* Documents.  A rolling hash over ``GRAM`` bytes triggers phrases, cut so that each 50-byte string lies
  inside one.  Where a phrase is known from an earlier document, all its strings go without being looked
  at; the parse says in which document each phrase occurs first.
* Strings of the phrases that are left.  Those that two documents may share meet in a task, as
  stretches of text.  There the stretches are parsed again, by triggers of ``WINDOW`` bytes, into a
  dictionary of distinct phrases, prefix-free since each ends with its only trigger, and a parse.  The
  suffixes of the dictionary and the suffixes of the parse are sorted, and both orders combine into the
  order of all strings of the task: by the dictionary suffix first, and by the parse suffix that follows
  it where it has less than 50 bytes.  Equal strings are neighbours in this order; they are compared
  byte by byte wherever the orders don't say so already.

Distribution.  Strings are dealt by their minimiser, the least rolling hash among their 31 grams, so
equal strings meet in one task and neighbouring ones travel as one stretch.  A first exchange carries
only 5 bytes per minimiser and finds the ones that occur more than once; a minimiser that occurs in one
document alone sends nothing further.  Strings of a minimiser that occurs very often (``HOT_RUNS``)
are dealt one by one, by a hash of all their bytes, since one task can't hold them.  Blocks of documents
summarise themselves before each exchange, so a passage in a third of all documents costs a row per
block, not per document.  The text is exchanged once, by block, and this exchange serves all three
passes.  Blocks and tasks have bounded bytes, whatever the session's setting; the rows between them
grow with blocks times tasks, so for very large inputs ``BLOCK_BYTES`` and ``BUCKET_BYTES`` are raised
with the executors' memory.

Defined cases: a null text counts as empty (and comes back empty); a null doc_id is smaller than any
other; rows with one doc_id, equal rows included, don't touch each other; long texts are blocks of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import mix64, partitions

LENGTH = 50
GRAM = 20
#: One trigger in so many places, on average.
PHRASE = 256
#: UTF-8 bytes of a block of documents (more if one document is longer), and of one pass of arrays.
BLOCK_BYTES = 2 << 20
PASS_BYTES = 1 << 20
#: Places whose hashes are computed at once, so that the arrays between stay in a core's cache.
CACHED = 1 << 14
#: UTF-8 bytes of text for each task that sorts strings.
BUCKET_BYTES = 4 << 20
#: Occurrences (runs of strings, estimated by powers of two) from which a minimiser's strings are dealt one by one.
HOT_RUNS = 8192
#: Bytes of a trigger in the second parse, and one trigger in so many places.
WINDOW, PIECE = 8, 32
#: Most strings in one stretch of text; its length then fits a byte.
STRETCH = 128
NULL_DOC = -(1 << 63)

BASE = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1
#: A minimiser's signature: so many bits, one for "in two documents of the block", four for the power of
#: two of its runs.
SIGN_BITS = 35


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The polynomial hash (modulo 2^64) of the ``GRAM`` bytes from each place on."""
    out = np.empty(max(len(data) - GRAM + 1, 0), np.uint64)
    for lo in range(0, len(out), CACHED):
        b = data[lo : lo + CACHED + GRAM - 1].astype(np.uint64)
        b += np.uint64(1)
        two = b[:-1] * np.uint64(BASE)
        two += b[1:]
        four = two[:-2] * np.uint64(pow(BASE, 2, 1 << 64))
        four += two[2:]
        eight = four[:-4] * np.uint64(pow(BASE, 4, 1 << 64))
        eight += four[4:]
        sixteen = eight[:-8] * np.uint64(pow(BASE, 8, 1 << 64))
        sixteen += eight[8:]
        all_ = out[lo : lo + CACHED]
        np.multiply(sixteen[: len(all_)], np.uint64(pow(BASE, 4, 1 << 64)), out=all_)
        all_ += four[16 : 16 + len(all_)]
    return out


def window_minima(h: np.ndarray) -> np.ndarray:
    """The minimiser of each 50-byte string: the least hash of its grams."""
    w = LENGTH - GRAM + 1
    out = np.empty(max(len(h) - w + 1, 0), np.uint64)
    for lo in range(0, len(out), CACHED):
        m, span = h[lo : lo + CACHED + w - 1], 1
        while span * 2 <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        rest = w - span
        out[lo : lo + CACHED] = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    return out


def one_in(n: int, h: np.ndarray) -> np.ndarray:
    """Which hashes are multiples of n."""
    return h & np.uint64(n - 1) == 0 if n & (n - 1) == 0 else h % np.uint64(n) == 0


class Block(NamedTuple):
    """The parse of a block: documents in order, phrases, and runs of strings with one minimiser."""

    order: list[int]
    doc: np.ndarray
    data: bytes
    start: np.ndarray
    end: np.ndarray
    phrase_at: np.ndarray
    phrase_hash: np.ndarray  # n x 2: 128 bits; zeros for phrases without a whole string
    phrase_doc: np.ndarray
    run_at: np.ndarray
    run_n: np.ndarray
    run_doc: np.ndarray
    run_phrase: np.ndarray
    run_key: np.ndarray


def parse_block(doc_id: pa.ChunkedArray, text: pa.ChunkedArray) -> Block:
    ids = [NULL_DOC if d is None else d for d in doc_id.to_pylist()]
    texts = [(t or "").encode() for t in text.to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    data = b"".join([texts[i] for i in order])
    doc = np.array([ids[i] for i in order], dtype=np.int64)
    size = np.array([len(texts[i]) for i in order], dtype=np.int64)
    end = np.cumsum(size)
    start = end - size
    buffer = np.frombuffer(data, np.uint8)
    triggers, run_at, run_n, run_key = [start[size >= LENGTH]], [], [], []
    for lo in range(0, max(len(buffer) - LENGTH + 1, 0), PASS_BYTES):
        piece = buffer[lo : lo + PASS_BYTES + LENGTH - 1]
        h = gram_hashes(piece)
        m = window_minima(h)
        n = len(m)
        # A string is whole if it ends in the document where it starts.
        room = np.zeros(n + 1, np.int64)
        first, last = np.searchsorted(end, lo, "right"), np.searchsorted(start, lo + n, "left")
        a = np.clip(start[first:last] - lo, 0, n)
        z = np.clip(end[first:last] - LENGTH + 1 - lo, a, n)
        np.add.at(room, a, 1)
        np.add.at(room, z, -1)
        whole = np.cumsum(room[:-1]) > 0
        trigger = one_in(PHRASE, h[:n])
        trigger &= whole
        cut = trigger | ~whole
        cut[0] = True
        cut[1:] |= m[1:] != m[:-1]
        cut[a[a < n]] = True
        at = np.flatnonzero(cut)
        length = np.diff(np.append(at, n))
        good = whole[at]
        at, length = at[good], length[good]
        parts = -(-length // STRETCH)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run_at.append(lo + np.repeat(at, parts) + k * STRETCH)
        run_n.append(np.minimum(np.repeat(length, parts) - k * STRETCH, STRETCH))
        run_key.append(mix64(m[np.repeat(at, parts)]))
        triggers.append(lo + np.flatnonzero(trigger))
    empty = np.empty(0, np.int64)
    at = np.concatenate(run_at or [empty]).astype(np.int64)
    phrase_at = np.unique(np.concatenate(triggers)).astype(np.int64)
    phrase_doc = np.searchsorted(start, phrase_at, "right") - 1
    stop = end[phrase_doc] if len(phrase_at) else empty
    if len(phrase_at) > 1:
        stop[:-1] = np.minimum(stop[:-1], phrase_at[1:] + LENGTH - 1)
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join([digest(data[a:z]) if z - a >= LENGTH else bytes(16) for a, z in zip(phrase_at.tolist(), stop.tolist())]), "<u8").reshape(-1, 2)
    return Block(
        order, doc, data, start, end, phrase_at, hashes, phrase_doc,
        at, np.concatenate(run_n or [empty]).astype(np.int64), np.searchsorted(start, at, "right") - 1, np.searchsorted(phrase_at, at, "right") - 1, np.concatenate(run_key or [empty]).astype(np.uint64),
    )


class Summary(NamedTuple):
    """What a block says of itself: distinct minimisers (by task, then key) and phrases."""

    keys: np.ndarray
    many: np.ndarray  # the minimiser occurs in two documents of the block
    runs: np.ndarray  # the power of two of its runs
    of_run: np.ndarray
    bucket: np.ndarray
    phrases: np.ndarray  # n x 2
    phrase_least: np.ndarray
    of_phrase: np.ndarray


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of an n x 2 array in order, and the place of each row among them."""
    by = np.lexsort((x[:, 1], x[:, 0]))
    new = np.ones(len(x), bool)
    new[1:] = (x[by[1:]] != x[by[:-1]]).any(1)
    place = np.empty(len(x), np.int64)
    place[by] = np.cumsum(new) - 1
    return x[by[new]], place


def summarise(b: Block, buckets: int) -> Summary:
    keys, of_run, times = np.unique(b.run_key, return_inverse=True, return_counts=True)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((keys, bucket))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    of_run = place[of_run] if len(by) else of_run
    least, most = np.full(len(by), np.iinfo(np.int64).max), np.full(len(by), NULL_DOC)
    docs = b.doc[b.run_doc] if len(b.run_doc) else np.empty(0, np.int64)
    np.minimum.at(least, of_run, docs)
    np.maximum.at(most, of_run, docs)
    phrases, of_phrase = distinct_rows(b.phrase_hash)
    phrase_least = np.full(len(phrases), np.iinfo(np.int64).max)
    np.minimum.at(phrase_least, of_phrase, b.doc[b.phrase_doc] if len(b.phrase_doc) else np.empty(0, np.int64))
    runs = np.minimum(np.log2(np.maximum(times[by], 1)).astype(np.int64), 15)
    return Summary(keys[by], least < most, runs, of_run, bucket[by], phrases, phrase_least, of_phrase)


def five_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


SAID = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("minimisers", pa.binary()), ("phrases", pa.binary())])
NOTE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("earlier", pa.binary()), ("found", pa.binary())])
SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("stretches", pa.binary())])
DDL = {"said": "block bigint, bucket int, minimisers binary, phrases binary", "note": "block bigint, bucket int, shared binary, hot binary, earlier binary, found binary", "sent": "block bigint, bucket int, stretches binary"}


def packed_phrases(phrases: np.ndarray, least: np.ndarray) -> bytes:
    return np.ascontiguousarray(phrases.astype("<u8")).tobytes() + least.astype("<i8").tobytes()


def unpacked_phrases(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 24
    return np.frombuffer(b, "<u8", 2 * n).reshape(n, 2), np.frombuffer(b, "<i8", n, 16 * n)


def say(b: Block, block: int, buckets: int) -> pa.Table:
    """First pass: the block's minimisers and phrases, one row per task they go to."""
    s = summarise(b, buckets)
    low = np.uint64((1 << SIGN_BITS) - 1)
    sign = ((s.keys // np.uint64(buckets)) & low) | (s.many.astype(np.uint64) << np.uint64(SIGN_BITS)) | (s.runs.astype(np.uint64) << np.uint64(SIGN_BITS + 1))
    cuts = np.searchsorted(s.bucket, np.arange(buckets + 1))
    real = s.phrases.any(1)
    ph, least = s.phrases[real], s.phrase_least[real]
    to = (ph[:, 0] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    ph, least, pcuts = ph[by], least[by], np.searchsorted(to[by], np.arange(buckets + 1))
    rows = [(block, k, five_bytes(sign[cuts[k] : cuts[k + 1]]), packed_phrases(ph[pcuts[k] : pcuts[k + 1]], least[pcuts[k] : pcuts[k + 1]])) for k in np.unique(np.concatenate([s.bucket, to])).tolist()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, SAID)], schema=SAID)


def answer(said: pa.Table) -> pa.Table:
    """For each block of one task: which minimisers other blocks have too, which are hot, and phrases known earlier."""
    blocks, bucket = said.column("block").to_pylist(), said.column("bucket")[0].as_py()
    signs = [from_five(x) for x in said.column("minimisers").to_pylist()]
    sizes = np.array([len(x) for x in signs])
    sign = np.concatenate(signs)
    runs = np.left_shift(1, (sign >> np.uint64(SIGN_BITS + 1)).astype(np.int64))
    _, inverse, count = np.unique(sign & np.uint64((1 << SIGN_BITS) - 1), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    hot = (np.bincount(inverse, weights=runs, minlength=len(count)) >= HOT_RUNS)[inverse] if len(count) else shared
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    halves = [unpacked_phrases(x) for x in said.column("phrases").to_pylist()]
    phrase, least = np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
    names, of = distinct_rows(phrase)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, of, least)
    news = first[of] < least
    pcuts = np.concatenate([[0], np.cumsum([len(x[0]) for x in halves])]).astype(np.int64)
    rows = []
    for i, block in enumerate(blocks):
        bits, warm = shared[cuts[i] : cuts[i + 1]], hot[cuts[i] : cuts[i + 1]]
        own = slice(pcuts[i], pcuts[i + 1])
        new = news[own]
        if bits.any() or warm.any() or new.any():
            rows.append((block, bucket, np.packbits(bits).tobytes(), np.packbits(warm).tobytes(), packed_phrases(phrase[own][new], first[of][own][new]), None))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, NOTE)], schema=NOTE)


class Judged(NamedTuple):
    """A block with the answers applied: runs that go with their phrase, and strings still to be sorted."""

    gone: np.ndarray
    at: np.ndarray  # of each open run (a single string, where its minimiser is hot): place, strings, document
    n: np.ndarray
    doc: np.ndarray
    stretch: np.ndarray  # the number of its stretch in its task
    to: np.ndarray
    sent: dict[int, list[tuple[bytes, int, int]]]


def judge(b: Block, buckets: int, notes: pa.Table) -> Judged:
    s = summarise(b, buckets)
    shared, first = s.many.copy(), s.phrase_least.copy()
    hot = (1 << s.runs) >= HOT_RUNS
    cuts = np.searchsorted(s.bucket, np.arange(buckets + 1))
    found = []
    for bucket, bits, warm, earlier in zip(*(notes.column(c).to_pylist() for c in ("bucket", "shared", "hot", "earlier"))):
        if bits is None:
            continue
        own, n = slice(cuts[bucket], cuts[bucket + 1]), cuts[bucket + 1] - cuts[bucket]
        shared[own] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        hot[own] |= np.unpackbits(np.frombuffer(warm, np.uint8), count=n).astype(bool)
        found.append(unpacked_phrases(earlier))
    if found:
        known, least = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        _, place = distinct_rows(np.concatenate([s.phrases, known]))  # every known phrase is one of the block's
        first[place[len(s.phrases) :]] = least
    if not len(b.run_at):
        none = np.empty(0, np.int64)
        return Judged(none.astype(bool), none, none, none, none, none, {})
    run_doc = b.doc[b.run_doc]
    of = s.of_phrase[b.run_phrase]
    gone = (first[of] < run_doc) & s.phrases[of].any(1)
    open_ = shared[s.of_run] & ~gone
    whole, single = np.flatnonzero(open_ & ~hot[s.of_run]), np.flatnonzero(open_ & hot[s.of_run])
    times = b.run_n[single]
    each = np.repeat(b.run_at[single], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, n = np.concatenate([b.run_at[whole], each]), np.concatenate([b.run_n[whole], np.ones(len(each), np.int64)])
    doc = np.concatenate([run_doc[whole], np.repeat(run_doc[single], times)])
    data, digest = b.data, xxhash.xxh3_64_intdigest
    to = np.concatenate([s.bucket[s.of_run[whole]], np.array([digest(data[i : i + LENGTH]) % buckets for i in each.tolist()], dtype=np.int64)])
    sent: dict[int, list[tuple[bytes, int, int]]] = {}
    numbers: dict[bytes, int] = {}
    stretch = np.empty(len(at), np.int64)
    for i, (a, k, bucket, d) in enumerate(zip(at.tolist(), n.tolist(), to.tolist(), doc.tolist())):
        string = data[a : a + k + LENGTH - 1]
        own = sent.setdefault(bucket, [])
        number = numbers.get(string)
        if number is None:
            numbers[string] = number = len(own)
            own.append((string, d, d))
        else:
            _, least, most = own[number]
            own[number] = (string, min(least, d), max(most, d))
        stretch[i] = number
    return Judged(gone, at, n, doc, stretch, to, sent)


def send(j: Judged, block: int) -> pa.Table:
    """Second pass: the block's distinct stretches, one row per task."""
    rows = []
    for bucket, own in sorted(j.sent.items()):
        strings, least, most = zip(*own)
        head = np.array([len(own)], "<u4").tobytes() + np.array([len(x) for x in strings], np.uint8).tobytes()
        rows.append((block, bucket, head + np.array(least, "<i8").tobytes() + np.array(most, "<i8").tobytes() + b"".join(strings)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 3, SENT)], schema=SENT)


FOUND = np.dtype([("stretch", "<u4"), ("offset", "u1"), ("n", "u1"), ("first", "<i8")])


def ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each key, from 1; equal ones have one rank."""
    by = np.argsort(key)
    new = np.ones(len(by), bool)
    new[1:] = key[by[1:]] != key[by[:-1]]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def eight_at(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The eight bytes from ``k`` after each place on, as a number."""
    return word[np.minimum(at + k, len(word) - 1)]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts as they do."""
    return np.ndarray(max(len(data) - 7, 0), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


#: The first so many bytes of a number of eight.
HEAD = np.array([WRAP ^ (WRAP >> 8 * n) for n in range(9)], dtype=np.uint64)


def ranked_strings(word: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The rank of the bytes from each place on, to 50 of them and as far as there is room; equal ones have one
    rank, ranks begin at 1.  Each round sorts by some more bytes what is still tied, in one key: the rank so far,
    the bytes, and how many they are (a string that ends comes first).
    """
    n = len(at)
    room = np.minimum(room, LENGTH)
    rank, tied, k, width = np.ones(n, np.int64), np.arange(n), 0, 7
    while len(tied):
        old, here = rank[tied], np.clip(room[tied] - k, 0, width)
        key = (eight_at(word, at[tied], k) & HEAD[here]) >> np.uint64(64 - 8 * width)
        if k:
            key |= old.astype(np.uint64) << np.uint64(8 * width)
        key = key << np.uint64(4) | here.astype(np.uint64)
        by = np.argsort(key)
        tied, old, key = tied[by], old[by], key[by]
        place = np.arange(len(by))
        new, other = np.ones(len(by) + 1, bool), np.zeros(len(by), bool)
        new[1:-1] = key[1:] != key[:-1]
        other[1:] = old[1:] != old[:-1]
        rank[tied] = old + np.maximum.accumulate(np.where(new[:-1], place, 0)) - np.maximum.accumulate(np.where(other, place, 0))
        tied = tied[~(new[:-1] & new[1:]) & (here[by] == width)]
        k, width = k + width, (60 - n.bit_length()) // 8
    return rank


def corpus_order(text: bytes, word: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings at ``at`` in which equal ones are neighbours, and a key: equal keys say that two
    are equal.  ``text`` is stretches one after the other, of ``length`` each; ``word`` is its ``eights``.
    """
    end = np.cumsum(length)
    start = end - length
    # The parse: a phrase runs from a trigger, or its stretch's start, to the end of the next trigger.
    total = int(length.sum())
    trigger = np.concatenate([one_in(PIECE, mix64(word[lo : min(lo + CACHED, total)])) for lo in range(0, total, CACHED)] or [np.empty(0, bool)])
    begin = np.unique(np.concatenate([start, np.flatnonzero(trigger)]))
    of = np.searchsorted(start, begin, "right") - 1
    begin = begin[(begin == start[of]) | (begin + WINDOW <= end[of])]
    of = np.searchsorted(start, begin, "right") - 1
    last = np.append(of[1:] != of[:-1], True)
    stop = np.where(last, end[of], np.append(begin[1:], 0) + WINDOW)
    # The dictionary: distinct phrases, one after the other.
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(text[a:z], len(names)) for a, z in zip(begin.tolist(), stop.tolist())], dtype=np.int64)
    dictionary = np.frombuffer(b"".join(names) + bytes(WINDOW), np.uint8)
    size = np.array([len(p) for p in names], dtype=np.int64)
    place = np.cumsum(size) - size
    # Its suffixes in order, to 50 bytes: the phrases themselves, and those where a string asked for begins.
    begins = np.zeros(total, np.int32)
    begins[begin] = 1
    phrase = np.cumsum(begins, dtype=np.int32)[at] - 1
    offset = at - begin[phrase]
    asked = np.zeros(int(size.sum()), bool)
    asked[place] = True
    asked[place[name[phrase]] + offset] = True
    suffix = np.flatnonzero(asked)
    rank = np.zeros(len(asked), np.int64)
    rank[suffix] = ranked_strings(eights(dictionary), suffix, np.repeat(place + size, size)[suffix] - suffix)
    # The suffixes of the parse in order: by their first phrase, then by twice as many phrases each time,
    # until a stretch, or 50 bytes, have no more.
    follow = rank[place[name]]
    most = int(np.bincount(of).max()) if len(of) else 0
    for step in (1, 2, 4, 8, 16, 32):
        if step >= most:
            break
        after = np.zeros(len(follow), np.int64)
        same = of[step:] == of[:-step]
        after[:-step][same] = follow[step:][same]
        follow = ranked(follow * (follow.max() + 1) + after)
    behind = np.zeros(len(follow), np.int64)
    behind[:-1][~last[:-1]] = follow[1:][~last[:-1]]
    # Both orders together.
    short = size[name[phrase]] - offset < LENGTH
    key = rank[place[name[phrase]] + offset] * (len(follow) + 2) + np.where(short, behind[phrase], 0)
    return np.argsort(key), key


def sort_suffixes(sent: pa.Table) -> pa.Table:
    """Put one task's strings in order; say which strings have an earlier document."""
    blocks, bucket = sent.column("block").to_pylist(), sent.column("bucket")[0].as_py()
    lengths, least, most, texts, counts = [], [], [], [], []
    for x in sent.column("stretches").to_pylist():
        n = int(np.frombuffer(x, "<u4", 1)[0])
        counts.append(n)
        lengths.append(np.frombuffer(x, np.uint8, n, 4))
        least.append(np.frombuffer(x, "<i8", n, 4 + n))
        most.append(np.frombuffer(x, "<i8", n, 4 + 9 * n))
        texts.append(x[4 + 17 * n :])
    text = b"".join(texts)
    length, low, high = np.concatenate(lengths).astype(np.int64), np.concatenate(least), np.concatenate(most)
    word = eights(np.frombuffer(text + bytes(WINDOW), np.uint8))
    windows = length - (LENGTH - 1)
    of = np.repeat(np.arange(len(length)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(length) - length, windows) + offset
    suffix, key = corpus_order(text, word, length, at)
    new = np.zeros(len(suffix), bool)
    new[:1] = True
    cut = np.flatnonzero(np.diff(key[suffix])) + 1
    for k in (0, 8, 16, 24, 32, 40, 42):
        differ = eight_at(word, at[suffix[cut]], k) != eight_at(word, at[suffix[cut - 1]], k)
        new[cut[differ]] = True
        cut = cut[~differ]
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(low[of[suffix]], np.flatnonzero(new))[group]
    earliest = np.empty(len(suffix), np.int64)
    earliest[suffix] = first
    hit = earliest < high[of]
    # Neighbouring hits of one stretch with one earliest document travel together.
    at = np.flatnonzero(hit)
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]]) | (earliest[at[1:]] != earliest[at[:-1]])
    lead = at[cut]
    out = np.empty(len(lead), FOUND)
    base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.searchsorted(base, of[lead], "right") - 1
    out["stretch"], out["offset"], out["first"] = of[lead] - base[owner], offset[lead], earliest[lead]
    out["n"] = np.diff(np.append(np.flatnonzero(cut), len(at)))
    cuts = np.searchsorted(owner, np.arange(len(blocks) + 1))
    rows = [(block, bucket, None, None, None, out[cuts[i] : cuts[i + 1]].tobytes()) for i, block in enumerate(blocks) if cuts[i + 1] > cuts[i]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, NOTE)], schema=NOTE)


def removed_bytes(b: Block, j: Judged, notes: pa.Table) -> np.ndarray:
    """Third pass: the bytes of the block that go."""
    step = np.zeros(len(b.data) + 1, np.int64)

    def mark(at: np.ndarray, n: np.ndarray) -> None:
        np.add.at(step, at, 1)
        np.add.at(step, at + n + LENGTH - 1, -1)

    mark(b.run_at[j.gone], b.run_n[j.gone])
    for bucket, found in zip(notes.column("bucket").to_pylist(), notes.column("found").to_pylist()):
        if found is None:
            continue
        hits = np.frombuffer(found, FOUND)
        here = np.flatnonzero(j.to == bucket)
        number = j.stretch[here]
        by = np.argsort(number, kind="stable")
        here, number = here[by], number[by]
        lo, hi = np.searchsorted(number, hits["stretch"], "left"), np.searchsorted(number, hits["stretch"], "right")
        times = hi - lo
        k = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hit = np.repeat(hits, times)
        run = here[k]
        later = hit["first"] < j.doc[run]
        mark(j.at[run[later]] + hit["offset"][later], hit["n"][later].astype(np.int64))
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text cut, and n_bytes, n_removed, n_spans, kept_sha256 added; one row per row.

    Columns with the names of the added ones are replaced, others pass through.  If a cut parts a
    character, the text drops its remaining bytes; the checksum is of all kept bytes.
    """
    spark = docs.sparkSession
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    names = [c for c in docs.columns if c not in added]
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(2 * n, -(-total // BUCKET_BYTES))
    block = "__block"
    while block in names:
        block += "_"
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias(block), *names).repartition(n, block)
    out_schema = docs.select(*names).schema
    for name, kind in zip(added, ("long", "long", "long", "string")):
        out_schema = out_schema.add(name, kind)

    def parse(t: pa.Table) -> Block:
        return parse_block(t.column("doc_id"), t.column("text"))

    def first(t: pa.Table) -> pa.Table:
        return say(parse(t), t.column(block)[0].as_py(), buckets)

    def second(t: pa.Table, notes: pa.Table) -> pa.Table:
        if not t.num_rows:
            return SENT.empty_table()
        return send(judge(parse(t), buckets, notes), t.column(block)[0].as_py())

    def third(t: pa.Table, notes: pa.Table) -> pa.Table:
        b = parse(t)
        mask = removed_bytes(b, judge(b, buckets, notes), notes)
        data = np.frombuffer(b.data, np.uint8)
        kept, rows = [None] * len(b.order), [None] * len(b.order)
        for i, a, z in zip(b.order, b.start.tolist(), b.end.tolist()):
            m = mask[a:z]
            rest = data[a:z][~m].tobytes()
            spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
            kept[i] = rest.decode("utf-8", "ignore")
            rows[i] = (z - a, int(m.sum()), spans, hashlib.sha256(rest).hexdigest())
        columns = [pa.array(kept, pa.string()) if c == "text" else t.column(c) for c in names]
        extra = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.Table.from_arrays([*columns, *extra], names=[*names, *added])

    notes = keyed.groupBy(block).applyInArrow(first, DDL["said"]).groupBy("bucket").applyInArrow(answer, DDL["note"])
    sent = keyed.groupBy(block).cogroup(notes.groupBy("block")).applyInArrow(second, DDL["sent"])
    found = sent.groupBy("bucket").applyInArrow(sort_suffixes, DDL["note"])
    return keyed.groupBy(block).cogroup(notes.unionByName(found).groupBy("block")).applyInArrow(third, out_schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
