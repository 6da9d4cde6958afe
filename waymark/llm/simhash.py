"""SimHash near-duplicates, linked by a self-join of a binary trie.

Fingerprints are joined, not documents: exact copies and documents with one fingerprint meet in a
group-by first.  For a budget of b differing bits the 64 bits are cut into b + 2 pieces; two
fingerprints within the budget agree on at least two pieces, so for each choice of two pieces those
that agree there are dealt to one task.  Inside a task the fingerprints, with the chosen pieces in
front, are a binary trie: a sorted array in which a node is a range.  Node pairs are traversed
together from the root, bit by bit; a pair of different branches costs one bit, and a pair over its
budget is pruned with everything below it.  Each task returns a spanning forest of its links, so a
dense group gives no more rows than it has members.

Defined cases: null, empty and blank texts have no words and fingerprint zero, and are copies of each
other; long texts are taken whole; equal texts have equal fingerprints, and repeated rows a row each;
a group is named by its least doc_id, and rows without one never name a group that has one; an empty
table gives an empty result; other columns pass through or are not looked at.

The near-duplicate stage asks for more than the trie join can give: texts of a shingle similarity of 0.8
differ in 10 of 64 bits on average, too many for a budget.  So it takes candidates from the trie join
of word fingerprints, which few edits change, and from bands of least hashes besides, and verifies
each candidate on the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import discard, materialize, mix64, partitions, parts_for, slices
from waymark.llm.graph import connected_components

SEED = 42
#: Node pairs with so few leaf pairs are compared directly; rows dealt to one task of the join.
LEAF_PAIRS = 64
TASK_ROWS = 1 << 21

# --- fingerprints ----------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z lower-cased; words are parted by space, tab, line and page breaks."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; fewer words than ``width`` form one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The 64 bits set in over half of the hashes (by weight); 0 if there are none."""
    ones = np.zeros(64)
    total = 0.0
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        if weights is None:
            ones += bits.sum(0, dtype=np.int64)
            total += len(bits)
        else:
            ones += weights[i : i + 65_536] @ bits
            total += weights[i : i + 65_536].sum()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def simhash(text: str, width: int = 3) -> int:
    return majority(shingle_hashes(words_of(text), width))


def profile(words: list[bytes], shingles: np.ndarray) -> tuple[int, ...]:
    """Fingerprints for linking near copies: one over words, weighted by the root of their counts,
    whose bits few edits change; and four over the distinct five-word shingles, which together
    estimate similarity.
    """
    distinct, counts = np.unique(np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64), return_counts=True)
    wide = [majority(mix64(shingles + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for k in range(1, 5)]
    return (majority(distinct, np.sqrt(counts)), *wide)


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (bigint) of ``docs`` (doc_id, text).

    A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi in slices(batch, 2, 4 << 20):
                rows += [simhash(text, width) for text in batch.column(2).slice(lo, hi - lo).to_pylist()]
            fps = np.array(rows, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


# --- the join --------------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def pieces(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the budget + 2 pieces of 64 bits, from the top."""
    n = budget + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(64 - b, b - a) for a, b in zip(cuts, cuts[1:])]


def layouts(budget: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """For each choice of two pieces: their mask, their width together, all pieces with these in front."""
    all_ = pieces(budget)
    out = []
    for front in combinations(all_, 2):
        mask = sum(((1 << w) - 1) << s for s, w in front)
        out.append((mask, sum(w for _, w in front), [*front, *(p for p in all_ if p not in front)]))
    return out


def rearranged(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, left = np.zeros(len(fp), np.uint64), 64
    for shift, width in order:
        left -= width
        out |= ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out


def _products(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges, range pair by range pair."""
    n = a_n * b_n
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(b_n, n)
    return np.repeat(a_lo, n) + k // width, np.repeat(b_lo, n) + k % width


def trie_self_join(keys: np.ndarray, lead: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of the sorted distinct ``keys`` that agree on the first ``lead`` bits and
    differ in ``budget`` bits at most."""
    found_i: list[np.ndarray] = []
    found_j: list[np.ndarray] = []
    head = keys >> np.uint64(64 - lead)
    cuts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    lo, hi = cuts[:-1], cuts[1:]
    own = hi - lo > 1
    # The frontier: pairs of nodes (ranges) of one depth, with the bits they differ in so far.
    a0, a1 = lo[own], hi[own]
    b0, b1, err = a0, a1, np.zeros(own.sum(), np.int64)
    for bit in range(63 - lead, -1, -1):
        small = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if small.any():
            i, j = _products(a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small])
            good = i < j
            i, j = i[good], j[good]
            near = popcount(keys[i] ^ keys[j]) <= budget
            found_i.append(i[near])
            found_j.append(j[near])
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_ = a0 == b0
        other = ~self_
        nxt = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), tuple(x[other] for x in (am, a1, b0, bm, err + 1))]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*nxt))
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, err = (x[live] for x in (a0, a1, b0, b1, err))
    if len(a0):  # every bit is used up: the ranges are single keys
        found_i.append(a0)
        found_j.append(b0)
    empty = np.empty(0, np.int64)
    return np.concatenate(found_i or [empty]), np.concatenate(found_j or [empty])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component, for links i-j among n nodes."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
    return label


def trie_links(points: DataFrame, budget: int) -> DataFrame:
    """Spanning links src, dst (ids) among ``points`` (id, fp; each fp once) by the trie self-join."""
    ways = layouts(budget)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    turns = F.explode(F.array(*(F.struct(F.lit(r).alias("way"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("bigint")).alias("part")) for r, (mask, _, _) in enumerate(ways))))
    dealt = points.select("id", "fp", turns.alias("t")).select("id", "fp", "t.way", "t.part")
    # Parts of a bounded number of rows, whatever the session's setting.
    spark = points.sparkSession
    dealt = dealt.repartition(parts_for(spark, points.count() * len(ways), TASK_ROWS), "way", "part").select("way", "id", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        way_of = table.column("way").to_numpy()
        ids, fps = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        for way, (_, lead, order) in enumerate(ways):
            at = np.flatnonzero(way_of == way)
            if len(at) < 2:
                continue
            keys, first = np.unique(rearranged(fps[at], order), return_index=True)
            i, j = trie_self_join(keys, lead, budget)
            own, label = ids[at][first], forest(len(keys), i, j)
            linked = np.flatnonzero(label != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(own[linked], pa.int64()), pa.array(own[label[linked]], pa.int64())], names=["src", "dst"])

    return dealt.mapInArrow(join, "src bigint, dst bigint")


# --- operators -------------------------------------------------------------------------------------


def simhash_components(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) for every row.

    Null and empty texts have fingerprint zero.  Rows without a doc_id take part, but never name a
    component that has a doc_id; a component of only such rows has a null component_id.
    """
    marked = materialize(fingerprinted(docs, width).select("doc_id", "fp"), "simhash")
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = trie_links(points.select(F.col("fp").alias("id"), "fp"), budget)
    roots = connected_components(links)
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The least similarity (Jaccard, of the sets of five-word shingles) of near copies.
SIMILARITY = 0.8
#: Bits in which the word fingerprints of candidates may differ.
WORD_BITS = 5
#: Least hashes of the shingles: two sets of similarity s agree on all ROWS of a band with chance
#: s ** ROWS; at 0.8 all BANDS differ for 1.3 pairs in ten million.
BANDS, ROWS = 30, 4
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: A pair of large sets is not compared if their 256 bits differ in more: six deviations above the
#: mean at similarity 0.8.  Sets under SMALL_SET are always compared.
LOOSE_BITS, SMALL_SET = 73, 64
#: Members of a band compared with each other in one go; a larger band is several goes.
BAND_BLOCK = 1000
#: Shingles of a family's sets in one go of their comparison, bytes of sets dealt to one task of it, and
#: sets and columns of one matrix.
FAMILY_BLOCK, FAMILY_BYTES, TILE, COLUMNS = 1 << 19, 1 << 24, 256, 4096
#: Bits of the filter on rows whose shingles are asked for, and of its blocks; more rows than this only
#: make it coarse.
FILTER_BITS, FILTER_BLOCK = 26, 16


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes; none for an empty set."""
    if not len(distinct):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    base = distinct ^ (distinct >> np.uint64(32))
    for i in range(0, len(base), 2048):
        np.minimum(least, (base[i : i + 2048, None] * FACTORS).min(0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix64(keys + column)
    return keys


def set_id(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def near_profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, id (of the set of five-word shingles), n (its size), fp, s1 to s4 and bands of ``docs``."""
    names = ["id", "fp", "s1", "s2", "s3", "s4"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, bands = [], [], []
            for lo, hi in slices(batch, 2, 4 << 20):
                for text in batch.column(2).slice(lo, hi - lo).to_pylist():
                    words = words_of(text)
                    distinct = np.unique(shingle_hashes(words, 5))
                    rows.append((set_id(distinct), *profile(words, distinct)))
                    sizes.append(len(distinct))
                    bands.append(band_keys(distinct).view(np.int64))
            ints = np.array(rows, dtype=np.uint64).view(np.int64).reshape(-1, len(names))
            columns = [pa.array(np.ascontiguousarray(ints[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *columns, pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", *names, "n", "bands"])

    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, ", ".join(["doc_id bigint, text_hash bigint", *(f"{n} bigint" for n in names), "n int, bands array<bigint>"]))


def _may_be_near(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The distinct pairs a < b of ``pairs`` (src, dst) that sizes and wide fingerprints don't rule out."""
    sides = ["n", "s1", "s2", "s3", "s4"]
    pairs = pairs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(points.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in sides)), end)
    bits = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in sides[1:])
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return pairs.where((small >= large * F.lit(SIMILARITY) - 1e-6) & ((small < SMALL_SET) | (bits <= LOOSE_BITS))).select("a", "b")


def row_filter(places: DataFrame) -> np.ndarray:
    """A map of 2 ** FILTER_BITS bits with those of ``places`` (place: int) set; it is put together by the
    executors, so the driver gets the map, whose size is fixed, and no list of rows."""
    size = 1 << FILTER_BLOCK

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        blocks = bits.reshape(-1, size // 8)
        found = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([blocks[b].tobytes() for b in found.tolist()], pa.binary())], names=["block", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    got = places.mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(unite, "block int, bits binary").toArrow()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8).reshape(-1, size // 8)
    for block, bits in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def in_filter(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[places >> 3] >> (7 - (places & 7)) & 1)


def place_of(*columns) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("place")


def shingle_sets(wanted: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """id, shingles (a sorted set, as bytes) of the ids of ``wanted``, and of a few others.

    The sets are made again from the texts, of the rows that stand for the points asked for; a bit map
    over hashes leaves out nearly all others before anything is exchanged.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(row_filter(points.join(wanted, "id", "left_semi").select("best.doc_id", "best.text_hash").select(place_of("doc_id", "text_hash"))))
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")).select(place_of("doc_id", "text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text give its set once per task
        for batch in batches:
            found = in_filter(bitmap.value, batch.column(0).to_numpy())
            for i in range(0, len(found), 64):
                sets = [np.unique(shingle_hashes(words_of(t), 5)) for t in batch.column(1).take(pa.array(found[i : i + 64])).to_pylist()]
                new = {k: x for k, x in zip(map(set_id, sets), sets) if k not in seen}
                seen.update(new)
                ids = np.array(list(new), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in new.values()], pa.binary())], names=["id", "shingles"])

    sets = materialize(source.mapInArrow(run, "id bigint, shingles binary"), "simhash-sets")
    bitmap.destroy()
    return sets


def verified(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b: ids) whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as src, dst."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["src", "dst"])

    sets = shingle_sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), points, docs)
    # The pairs, narrow rows, are the hashed side of the first join, so that no wide row is sorted for it.
    both = pairs.select("a", "b").hint("shuffle_hash").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    near = materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "src bigint, dst bigint"), "simhash-links")
    discard(sets)
    return near


def common_counts(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many elements each of the first ``n`` sets has in common with each of the others, or with each of
    all if there are no others."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # an element of one set only is in no intersection of two
    kept = shared[at]
    rows, at = rows[kept], (np.cumsum(shared) - 1)[at[kept]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    rest = slice(n, None) if n < len(sets) else slice(None)
    both = np.zeros((n, len(sets) - rest.indices(len(sets))[0]))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        width = int(at[b - 1]) - lo + 1
        has = np.zeros((len(sets), width), np.float32)
        has[rows[a:b], at[a:b] - lo] = 1
        both += has[:n] @ has[rest].T
    return both


def near_sets(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """A label for each set: equal if links of Jaccard similarity 0.8 or more join them, of all pairs or, with
    ``split``, of those of a set before and one after that place.  The label is a set's index.

    Sets are taken in the order of their sizes, ``TILE`` by ``TILE``; tiles too different in size are passed over.
    """
    size = np.array([len(x) for x in sets])
    sides = [np.arange(len(sets))] if split is None else [np.arange(split), np.arange(split, len(sets))]
    tiles = [[side[lo : lo + TILE] for lo in range(0, len(side), TILE)] for side in (x[np.argsort(size[x], kind="stable")] for x in sides)]
    src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, p in enumerate(tiles[0]):
        for q in tiles[0][k:] if split is None else tiles[1]:
            least, most = max(size[p[0]], size[q[0]]), min(size[p[-1]], size[q[-1]])
            if 5 * most < 4 * least:
                continue
            both = common_counts([sets[x] for x in (p if q is p else np.concatenate([p, q]))], len(p))
            i, j = np.nonzero(9 * both >= 4 * (size[p][:, None] + size[q][None, :]))
            label = forest(len(p) + len(q), i, j + len(p))
            linked = np.flatnonzero(label != np.arange(len(label)))
            own = np.concatenate([p, q])
            src.append(own[linked])
            dst.append(own[label[linked]])
    return forest(len(sets), np.concatenate(src), np.concatenate(dst))


def family_links(families: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """Spanning links src, dst of all pairs in a family (``families``: id, family) whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more.

    Every set is sent to its family's task, where all are compared at once; no pair is a row.  The sets
    of a large family are dealt to blocks, and each two blocks are a task's work of their own.
    """
    spark = docs.sparkSession
    sets = shingle_sets(families.select("id"), points, docs)
    sized = materialize(families.join(points.select("id", "n"), "id"), "simhash-families")
    blocks = F.ceil(F.sum("n") / FAMILY_BLOCK)
    large = materialize(sized.groupBy("family").agg(blocks.alias("blocks"), F.sum("n").alias("total")), "simhash-family-sizes")
    total = large.agg(F.sum(F.col("blocks") * F.col("total")) * 8).first()[0] or 0
    many = large.where("blocks > 1").select("family", "blocks")
    placed = sized.join(many, "family", "left").select("id", "family", F.coalesce("blocks", F.lit(1).cast("bigint")).alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    work = placed.join(sets, "id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    work = work.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        family, i, j, block, own = (table.column(c).to_numpy() for c in ("family", "i", "j", "block", "id"))
        held = table.column("shingles")
        order = np.lexsort((own, block, j, i, family))
        family, i, j, block, own = (x[order] for x in (family, i, j, block, own))
        new = np.concatenate([[True], (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip(cuts, cuts[1:]):
            # A set may come twice, made by two tasks.
            at = a + np.unique(own[a:b], return_index=True)[1]
            at = at[np.argsort(block[at], kind="stable")]
            split = int((block[at] == i[a]).sum()) if i[a] != j[a] else None
            label = near_sets([np.frombuffer(held[x].as_buffer(), np.uint64) for x in order[at].tolist()], split)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(own[at[linked]]), pa.array(own[at[label[linked]]])], names=["src", "dst"])

    dealt = work.repartition(parts_for(spark, total, FAMILY_BYTES), "family", "i", "j")
    near = materialize(dealt.mapInArrow(run, "src bigint, dst bigint"), "simhash-links")
    discard(sets, sized, large)
    return near


def band_members(points: DataFrame) -> DataFrame:
    """key, id, leader of the bands' keys that two points or more have; the leader is one of them, and
    one with a small hash, so that bands of like members have one leader."""
    spread = points.select(F.explode("bands").alias("key"), "id")
    lead = spread.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    lead = materialize(lead.select("key", F.col("first.id").alias("leader")), "simhash-leaders")
    # Most keys are of one point: a map of the others leaves them out before they are exchanged again.
    bitmap = points.sparkSession.sparkContext.broadcast(row_filter(lead.select(place_of("key"))))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = in_filter(bitmap.value, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(found)) for i in (1, 2)], names=["key", "id"])

    kept = spread.select(place_of("key"), "key", "id").mapInArrow(shared, "key bigint, id bigint")
    members = materialize(kept.join(lead, "key").select("key", "id", "leader"), "simhash-bands")
    bitmap.destroy()
    discard(lead)
    return members


def band_pairs(members: DataFrame) -> DataFrame:
    """src, dst (ids): spanning links of the pairs of ``members`` (key, id, root, n, s1 to s4) with one key and
    two roots that sizes and wide fingerprints don't rule out: no more than there are members.

    The members of a large band are dealt to blocks of some ``BAND_BLOCK`` members, and each two blocks
    are a task's work of their own.
    """
    sides = ["s1", "s2", "s3", "s4"]
    blocks = F.ceil(F.col("size") / BAND_BLOCK)
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(mixed.select("key", F.col("n").alias("size")), "simhash-mixed")
    found = members.withColumnRenamed("n", "count").join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    work = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    work = work.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root", "count", *sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = lambda c: table.column(c).to_numpy()
        order = np.lexsort((col("j"), col("i"), col("key")))
        key, gi, gj, block, own, root, n = (col(c)[order] for c in ("key", "i", "j", "block", "id", "root", "count"))
        bits = [col(c)[order].view(np.uint64) for c in sides]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        one = gi[first] == gj[first]

        def near(lo: int, hi: int, p: np.ndarray, q: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Spanning links of the pairs p, q of rows lo to hi."""
            small, large = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
            good = (p < q) & (within | (block[p] != block[q])) & (root[p] != root[q]) & (small >= large * SIMILARITY - 1e-6)
            p, q, small = p[good], q[good], small[good]
            good = (small < SMALL_SET) | (sum(popcount(s[p] ^ s[q]) for s in bits) <= LOOSE_BITS)
            label = forest(hi - lo, p[good] - lo, q[good] - lo)
            linked = np.flatnonzero(label != np.arange(hi - lo))
            return lo + linked, lo + label[linked]

        step = np.cumsum(size * size) >> 20
        for s in np.unique(step):
            at = np.flatnonzero(step == s)
            a, e = int(first[at[0]]), int(first[at[-1]] + size[at[-1]])
            if len(at) == 1 and e - a > BAND_BLOCK:  # two blocks: row by row
                links = []
                for lo in range(a, e, 256):
                    p, q = np.meshgrid(np.arange(lo, min(lo + 256, e)), np.arange(lo, e), indexing="ij")
                    links.append(near(a, e, p.ravel(), q.ravel(), np.full(p.size, one[at[0]])))
                src, dst = map(np.concatenate, zip(*links))
                label = forest(e - a, src - a, dst - a)
                src = np.flatnonzero(label != np.arange(e - a))
                src, dst = a + src, a + label[src]
            else:
                src, dst = near(a, e, *_products(first[at], size[at], first[at], size[at]), np.repeat(one[at], size[at] ** 2))
            yield pa.RecordBatch.from_arrays([pa.array(own[src]), pa.array(own[dst])], names=["src", "dst"])

    dealt = work.repartition(partitions(members.sparkSession), "key", "i", "j")
    return dealt.mapInArrow(run, "src bigint, dst bigint")


def near_groups(docs: DataFrame, word_bits: int = WORD_BITS) -> tuple[DataFrame, DataFrame]:
    """The profiles of all rows, and id, best (row), root of their distinct sets of shingles.

    Points of one root are connected by links of Jaccard similarity 0.8 or more, each verified.  Links
    are sought in two rounds: those of the trie join of word fingerprints, of points to the leader of
    their fingerprint, and of each band's members to its leader; then among all pairs in a band that are
    not connected yet and may be near.  These pairs are never rows: a band gives a spanning forest of them,
    the trees are put together to families, and all sets of a family are compared with each other.
    Joins look up written tables, so that adaptive execution can deal the rows of a frequent key to
    several tasks.
    """
    marked = materialize(near_profiles(docs), "simhash-profile")
    sides = ["s1", "s2", "s3", "s4"]
    # One point per distinct set: exact copies, however many, are one row from here on.
    least = F.min(F.struct("doc_id", "text_hash", "fp", "n", *sides, "bands"))
    best = marked.groupBy("id").agg(least.alias("m")).select("id", F.struct("m.doc_id", "m.text_hash").alias("best"), *(f"m.{c}" for c in ("fp", "n", *sides, "bands")))
    points = materialize(best, "simhash-points")
    heads = materialize(points.groupBy("fp").agg(F.min("id").alias("head"), F.count("*").alias("n")), "simhash-heads")
    members = band_members(points)
    links = trie_links(heads.select(F.col("head").alias("id"), "fp"), word_bits)
    links = links.union(points.select("id", "fp").join(heads.where("n > 1").select("fp", "head"), "fp").select("id", "head"))
    asked = materialize(_may_be_near(links.union(members.select("id", "leader")), points), "simhash-pairs")
    first = verified(asked, points, docs)
    roots = materialize(connected_components(first), "simhash-roots")
    rooted = members.select("key", "id").join(roots, members.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_ = materialize(rooted.join(points.select("id", "n", *sides), "id"), "simhash-open")
    more = materialize(band_pairs(open_), "simhash-pairs")
    discard(asked, first, members, open_)
    families = materialize(connected_components(more).select(F.col("node").alias("id"), F.col("root").alias("family")), "simhash-families")
    second = family_links(families, points, docs)
    roots = connected_components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(second))
    return marked, points.join(roots, points.id == roots.node, "left").select("id", "best", F.coalesce("root", "id").alias("root"))


def drop_near_duplicates(docs: DataFrame, word_bits: int = WORD_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least doc_id.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more (see ``near_groups``); groups are the connected components.  Rows without a doc_id sort first;
    of repeated rows one stays.  Columns are unchanged, whatever their names.
    """
    marked, rooted = near_groups(docs, word_bits)
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.text_hash")
    copies = marked.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = kept.join(copies, kept.doc_id.eqNullSafe(copies.doc_id) & (kept.text_hash == copies.text_hash)).select(kept.doc_id, kept.text_hash, "n")
    # The input's columns travel in one struct, so that no name of theirs can clash.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    hashed = row.select("row", F.col("row.doc_id").alias("own_id"), F.xxhash64("row.text").alias("own_hash"))
    found = hashed.join(kept, hashed.own_id.eqNullSafe(kept.doc_id) & (hashed.own_hash == kept.text_hash))
    single = found.where("n = 1").select("row.*")
    repeated = found.where("n > 1").groupBy("own_id", "own_hash").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
