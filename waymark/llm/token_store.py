"""Token ids in binary shards, addressed by a minimal perfect hash index.

File format (Parquet files are only the container, so any Hadoop file system will do)
  ``shards``: one row per shard, at most ``SHARD_IDS`` ids unless a single document is longer.
    part, seq   place of the shard; (part, seq) ascending is doc_id ascending
    width       bytes per id: 2 if every id of the vocabulary fits, else 4
    counts      little-endian uint32 per document: its number of ids
    keys        the doc_id of each document (for building the index)
    payload     the raw ids, little-endian, one document after the other
  ``index``: one row per key bucket.
    buckets     how many buckets the keys were dealt to (an empty one has no row)
    bits        the levels of the hash: packed bits, one array per level
    fingerprints  uint32 per slot, from a second hash of the key
    first       uint32 per slot + 1: where the key's places begin (a repeated key has several)
    places      part, seq, offset, count of each place

The index is a multi-level (collision-peeling) minimal perfect hash: at each level a key keeps its
bit if no other key hits it, the rest go on to the next level; the rank of the key's bit is its slot.
A lookup therefore costs a few bit tests, one rank and one fingerprint test, whatever the size.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import mix64, partitions, scratch_path, slices

SHARD_IDS = 1 << 20
KEYS_PER_BUCKET = 50_000
GAMMA = 2.0
#: The bucket of the rows without a doc_id, and the key that stands for them in it.
NULL_BUCKET, NULL_KEY = -1, 0
#: Bytes of text encoded at once: the more, the more often a word is met again.
ENCODE_BYTES = 4 << 20
#: Words and pre-tokens whose ids a worker remembers, and their characters at most.
CACHE_WORDS = 700_000
CACHE_PRETOKENS = 700_000
CACHE_CHARS = 16 << 20
#: Marks that the pattern always parts from the letters before them when nothing follows; letters with at
#: most one of them behind need no pattern.
MARKS = frozenset(".,;:!?")

# The pre-tokenisation pattern of the byte-level BPE vocabulary.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_byte_bpe(path: str) -> bool:
    """Whether a tokenizer's file is a byte-level BPE with the pattern above and nothing around it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = made.get("normalizer") is None and made.get("truncation") is None and made.get("padding") is None
    bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and bare and model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


#: What ``words`` gives for a piece that isn't in it (None is a piece without ids of its own).
UNSEEN = object()


class FastEncoder:
    """Encode whole texts with a ``tokenizers`` file, remembering the ids of words.

    A byte-level BPE never merges across pre-tokens, and a single space between two visible
    characters always starts one.  Texts are therefore cut at such spaces, all at once, each distinct
    piece is encoded by the library once, and the packed ids are put in its places.  Texts with other white space around
    a space are cut by the full pattern, and texts with a special token's string go to the library
    whole.  Both memories are bounded, in two generations, so that common ones survive when the rare
    are dropped.
    """

    def __init__(self, path: str, dtype: np.dtype | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = is_byte_bpe(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(dtype or ("<u2" if size <= 1 << 16 else "<u4"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PRETOKENS)
        self.words: dict[str, bytes | None] = {}  # a piece, without the space before it
        self.older_words: dict[str, bytes | None] = {}
        # The model alone: it takes text in its alphabet of bytes, and cuts nothing.
        self.model, self.alphabet = Tokenizer(self.tokenizer.model), byte_alphabet()
        # Which tokens begin with a space or a line end, and which one is nothing more.
        self.begins = {lead: np.zeros(size, bool) for lead in " \n"}
        self.single = {lead: -1 for lead in " \n"}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            for lead in " \n":
                if token[:1] == self.alphabet[ord(lead)]:
                    self.begins[lead][i] = True
                    self.single[lead] = i if len(token) == 1 else self.single[lead]
        self.pretokens: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.word_chars = self.pretoken_chars = 0

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def _cut(self, piece: str) -> list[str]:
        """Pre-tokens of " " + piece, or of a line's first piece."""
        return self.pattern.findall(piece if piece[0] == "\n" else " " + piece)

    def _recall(self, wanted: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens."""
        if len(self.pretokens) > CACHE_PRETOKENS or self.pretoken_chars > CACHE_CHARS:
            self.older, self.pretokens, self.pretoken_chars = self.pretokens, {}, 0
        known, older = self.pretokens, self.older
        unseen = wanted.difference(known)
        self.pretoken_chars += sum(map(len, unseen))
        known.update((p, older[p]) for p in unseen.intersection(older))
        unseen.difference_update(older)
        plain = [p for p in unseen if p[0] == " " and p[1:].isalpha()]
        known.update(zip(plain, self._together([p[1:] for p in plain], " ")))
        new = list(unseen.difference(plain))
        known.update(zip(new, (self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return known

    def _together(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of lead + word for words of letters, many from one call of the model.

        Each begins where a token begins with the lead.  A merge over a border, or of a line end with letters
        (which the pattern parts), would show as fewer such tokens, or as others: then the library cuts.
        """
        out: list[bytes] = []
        for i in range(0, len(words), 1024):
            some = words[i : i + 1024]
            text = lead + lead.join(some)
            shown = text.replace(lead, self.alphabet[ord(lead)]) if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
            ids = np.asarray(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype=self.dtype)
            begin = np.flatnonzero(self.begins[lead][ids])
            if len(begin) == len(some) and (lead == " " or (ids[begin] == self.single[lead]).all()):
                cuts, packed = (np.append(begin, len(ids)) * self.dtype.itemsize).tolist(), ids.tobytes()
                out += map(packed.__getitem__, map(slice, cuts[:-1], cuts[1:]))
            else:
                out += [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast([lead + w for w in some], add_special_tokens=False)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Ids of unseen pieces; None for those that touch other white space."""
        words = self.words
        plain, marked, lines, rest = [], [], [], []
        for w in pieces:
            if w.isalpha():
                plain.append(w)
            elif w[-1:] in MARKS and w[:-1].isalpha():
                marked.append(w)
            elif w[:1] == "\n" and w[1:].isalpha():
                lines.append(w)
            else:
                rest.append(w)
        words.update(zip(plain, self._together(plain, " ")))
        words.update(zip(lines, self._together([w[1:] for w in lines], "\n")))
        cut = {}
        for w in rest:
            odd = not w or w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1].isspace())
            cut[w] = None if odd else self._cut(w)
        known = self._recall(set(chain(MARKS, chain.from_iterable(ps for ps in cut.values() if ps))))
        words.update((w, ps and b"".join([known[p] for p in ps])) for w, ps in cut.items())
        older = self.older_words
        before = {b: words.get(b) or older.get(b) for b in {w[:-1] for w in marked}}
        new = [b for b, ids in before.items() if ids is None]
        before.update(zip(new, self._together(new, " ")))
        words.update((w, before[w[:-1]] + known[w[-1]]) for w in marked)

    def _ids(self, pieces: list[str]) -> list[bytes | None]:
        """Packed ids of distinct pieces."""
        found = list(map(self.words.get, pieces, repeat(UNSEEN)))
        places = [i for i, ids in enumerate(found) if ids is UNSEEN]
        if not places:
            return found
        missing = list(map(pieces.__getitem__, places))
        fresh = sum(map(len, missing))
        if len(self.words) + len(missing) > CACHE_WORDS or self.word_chars + fresh > CACHE_CHARS:
            self.older_words, self.words, self.word_chars = self.words, {}, 0
            missing, fresh = pieces, sum(map(len, pieces))
        self.word_chars += fresh
        if self.older_words:
            older = list(map(self.older_words.get, missing, repeat(UNSEEN)))
            self.words.update((w, ids) for w, ids in zip(missing, older) if ids is not UNSEEN)
            missing = [w for w, ids in zip(missing, older) if ids is UNSEEN]
        self._learn(missing)
        for i in places:
            found[i] = self.words[pieces[i]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; empty texts give none."""
        if not self.known:
            return [self._pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if not texts:
            return []
        # A line end begins a piece of its own, which then has no space before it.
        raw = np.frombuffer((" " + " ".join(texts).replace("\n", " \n")).encode(), np.uint8)
        space = raw == ord(" ")
        at = np.flatnonzero(space)
        offsets = np.append(at, len(raw)) - np.arange(len(at) + 1)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw[~space])).dictionary_encode()
        packed = pa.array(self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        _, places, body = packed.buffers()
        place, body = np.frombuffer(places, np.int64, len(packed) + 1, 8 * packed.offset), memoryview(body or b"")
        odd = np.append(0, np.cumsum(packed.is_null().to_numpy(zero_copy_only=False)))
        # The first piece of each text has no space before it; the rest of its pieces follow.
        first = np.cumsum([0, *(t.count(" ") + t.count("\n") + 1 for t in texts)])
        start, stop = place[first[:-1] + 1].tolist(), place[first[1:]].tolist()
        touched = (odd[first[1:]] > odd[first[:-1] + 1]).tolist()
        out, slow = [], []
        for i, (text, a, z, odd_) in enumerate(zip(texts, start, stop, touched)):
            head = text[: min(k for k in (text.find(" "), text.find("\n"), len(text)) if k >= 0)] if text else ""
            if not text:
                out.append(b"")
            elif any(s in text for s in self.special):
                out.append(self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids))
            elif odd_ or not head or head[-1].isspace():  # a piece that touches other white space has no ids of its own
                slow.append((i, self.pattern.findall(text)))
                out.append(b"")
            else:
                slow.append((i, self.pattern.findall(head)))
                out.append(bytes(body[a:z]))
        known = self._recall({p for _, ps in slow for p in ps})
        for i, ps in slow:
            out[i] = b"".join([known[p] for p in ps]) + out[i]
        return out


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> FastEncoder:
    """One encoder per Python worker: what it has learned serves the worker's later tasks too."""
    return FastEncoder(path)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write shards and index under ``path``.

    Null and empty texts give only the end id.  Rows are stored in ascending doc_id order, rows
    without a doc_id first; rows that share a doc_id lie side by side and are all reachable by it.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.asarray([end_id], dtype=encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        keys: list[int | None] = []
        bodies: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            counts = np.array([len(b) // width for b in bodies], dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([width], pa.int32()), pa.array([int(counts.sum())], pa.int64()),
                    pa.array([counts.tobytes()], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([b"".join(bodies)], pa.binary()),
                ],
                names=["part", "seq", "width", "n_ids", "counts", "keys", "payload"],
            )

        for batch in batches:
            for lo, hi in slices(batch, 1, ENCODE_BYTES):
                piece = batch.slice(lo, hi - lo)
                for key, body in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist())):
                    body += end
                    if bodies and held + len(body) // width > shard_ids:
                        yield shard()
                        seq, keys, bodies, held = seq + 1, [], [], 0
                    keys.append(key)
                    bodies.append(body)
                    held += len(body) // width
        if bodies:
            yield shard()

    schema = "part int, seq int, width int, n_ids bigint, counts binary, keys array<bigint>, payload binary"
    ordered.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(f"{path}/shards")
    build_index(spark.read.schema(schema).parquet(f"{path}/shards")).write.option("compression", "zstd").parquet(f"{path}/index")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/shards")


# --- the index -------------------------------------------------------------------------------------


def build_mph(keys: np.ndarray, gamma: float = GAMMA) -> list[np.ndarray]:
    """Levels of boolean arrays for distinct uint64 ``keys``."""
    levels, left = [], keys
    while len(left):
        size = max(64, int(gamma * len(left)))
        at = mph_at(left, len(levels), size)
        hit = np.bincount(at, minlength=size) == 1
        levels.append(hit)
        left = left[~hit[at]]
    return levels


def mph_at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def mph_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for keys that no level accepts."""
    slots = np.full(len(keys), -1, dtype=np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, hit in enumerate(levels):
        at = mph_at(keys[open_], level, len(hit))
        ranks = np.cumsum(hit)
        good = hit[at]
        slots[open_[good]] = base + ranks[at[good]] - 1
        open_, base = open_[~good], base + int(ranks[-1])
    return slots


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


PLACES = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("offset", pa.int64()), ("n", pa.int64())])
INDEX = "bucket bigint, buckets bigint, bits array<binary>, sizes array<bigint>, fingerprints binary, first binary, part binary, seq binary, offset binary, n binary"


def build_index(shards: DataFrame) -> DataFrame:
    """One index row per key bucket; the number of buckets follows the number of documents."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, counts, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "counts", "keys"))):
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                k = pa.array(keys, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [k, pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seq, np.int32)), pa.array(np.cumsum(n) - n), pa.array(n)], schema=PLACES
                )

    def build(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        doc = pc.fill_null(table.column("doc_id"), NULL_KEY).to_numpy()
        order = np.lexsort((table.column("offset").to_numpy(), table.column("seq").to_numpy(), table.column("part").to_numpy(), doc))
        doc = doc[order].astype(np.int64)
        keys, starts = np.unique(doc.view(np.uint64), return_index=True)
        ends = np.append(np.sort(starts)[1:], len(doc))[np.argsort(np.argsort(starts))] if len(starts) else starts
        levels = build_mph(keys)
        slots = mph_slots(levels, keys)
        by_slot = np.argsort(slots)
        sizes = (ends - starts)[by_slot]
        gather = np.concatenate([np.arange(s, s + z) for s, z in zip(starts[by_slot], sizes)]) if len(sizes) else np.empty(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
        col = lambda name, kind: table.column(name).to_numpy()[order][gather].astype(kind).tobytes()
        return pa.table(
            {
                "bucket": pa.array([bucket], pa.int64()),
                "buckets": pa.array([buckets], pa.int64()),
                "bits": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
                "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
                "fingerprints": pa.array([fingerprints(keys)[by_slot].astype("<u4").tobytes()], pa.binary()),
                "first": pa.array([first.tobytes()], pa.binary()),
                "part": pa.array([col("part", "<i4")], pa.binary()),
                "seq": pa.array([col("seq", "<i4")], pa.binary()),
                "offset": pa.array([col("offset", "<i8")], pa.binary()),
                "n": pa.array([col("n", "<u4")], pa.binary()),
            }
        )

    n_docs = shards.select(F.sum(F.size("keys"))).first()[0] or 0
    buckets = max(1, -(-n_docs // KEYS_PER_BUCKET))
    found = shards.select("part", "seq", "counts", "keys").mapInArrow(places, "doc_id bigint, part int, seq int, offset bigint, n bigint")
    return found.withColumn("bucket", key_bucket(F.col("doc_id"), buckets)).groupBy("bucket").applyInArrow(build, INDEX)


def key_bucket(key, buckets: int):
    return F.when(key.isNull(), F.lit(NULL_BUCKET).cast("bigint")).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))


def locate(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Places of the documents asked for: doc_id, part, seq, offset, n.

    ``keys`` has a column doc_id (null asks for the rows without one).  A key that is not stored
    gives no row, except that one in 2^32 unknown keys passes its slot's fingerprint.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    buckets = index.agg(F.max("buckets")).first()[0] or 1
    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().withColumn("bucket", key_bucket(F.col("doc_id"), buckets))

    def look(asked_: pa.Table, stored: pa.Table) -> pa.Table:
        if not stored.num_rows or not asked_.num_rows:
            return PLACES.empty_table()
        row = stored.slice(0, 1).to_pylist()[0]
        missing = row["bucket"] == NULL_BUCKET
        doc = pc.fill_null(asked_.column("doc_id"), NULL_KEY).to_numpy().astype(np.int64)
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(row["bits"], row["sizes"])]
        slots = mph_slots(levels, doc.view(np.uint64))
        marks = np.frombuffer(row["fingerprints"], "<u4")
        good = slots >= 0
        good[good] = marks[slots[good]] == fingerprints(doc.view(np.uint64)[good])
        doc, slots = doc[good], slots[good]
        first = np.frombuffer(row["first"], "<u4").astype(np.int64)
        size = first[slots + 1] - first[slots]
        at = np.repeat(first[slots] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        part, seq, offset, n = (np.frombuffer(row[c], k)[at] for c, k in (("part", "<i4"), ("seq", "<i4"), ("offset", "<i8"), ("n", "<u4")))
        found = np.repeat(doc, size)
        return pa.Table.from_arrays([pa.nulls(len(found), pa.int64()) if missing else pa.array(found), pa.array(part), pa.array(seq), pa.array(offset), pa.array(n.astype(np.int64))], schema=PLACES)

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, "doc_id bigint, part int, seq int, offset bigint, n bigint")


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The raw ids of the documents asked for: doc_id, ids array<int>. Only their shards are read from."""
    places = locate(spark, path, keys).groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id", "offset", "n")).alias("places"))
    joined = read_shards(spark, path).select("part", "seq", "width", "payload").join(places, ["part", "seq"]).select("width", "payload", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, payload, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(payload, f"<u{width}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["doc_id"] for x in found], pa.int64()), pa.array([ids[x["offset"] : x["offset"] + x["n"]].astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return joined.mapInArrow(cut, "doc_id bigint, ids array<int>")


def record_digests(shards: DataFrame) -> DataFrame:
    """What the payloads hold, read back: part, seq, offset, ids_crc32 of the ids as uint32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, width, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(5))):
                n = np.frombuffer(counts, "<u4").astype(np.int64)
                at = np.cumsum(n) - n
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * s : 4 * (s + z)]) for s, z in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), seq, np.int32)), pa.array(at), pa.array(crc, pa.int64())], names=["part", "seq", "offset", "ids_crc32"]
                )

    return shards.select("part", "seq", "width", "counts", "payload").mapInArrow(read, "part int, seq int, offset bigint, ids_crc32 bigint")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard, over two levels so that no task orders all shards: part, seq, base."""
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_ids").alias("n_ids"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_base"))
    return sizes.join(parts, "part").select("part", "seq", (F.col("part_base") + before(Window.partitionBy("part").orderBy("seq"))).alias("base"))


def store_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a store, look every doc_id up in its index, and digest the ids found there.

    Returns doc_id, start, n_tokens, ids_crc32; one row per input row.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_store(docs, path, tokenizer_path, end_id)
    shards = read_shards(spark, path)
    read = record_digests(shards).join(shard_starts(shards), ["part", "seq"])
    found = locate(spark, path, docs.select("doc_id"))
    return found.join(read, ["part", "seq", "offset"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")
