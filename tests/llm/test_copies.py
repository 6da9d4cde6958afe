import hashlib
import random

import numpy as np
import pytest
import xxhash

from waymark.llm import common, graph, repeats, simhash

DOCS = "doc_id bigint, text string"


def brute_pairs(keys, budget):
    return {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if bin(int(keys[i]) ^ int(keys[j])).count("1") <= budget}


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5])
def test_trie_join_is_complete(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64) * np.uint64(2)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 7)), replace=False))) for b in base for _ in range(12)]
    fps = np.unique(np.array([*base, *near], dtype=np.uint64))
    found = set()
    for _, lead, order in simhash.layouts(budget):
        keys = simhash.rearranged(fps, order)
        by = np.argsort(keys)
        i, j = simhash.trie_self_join(keys[by], lead, budget)
        found |= {tuple(sorted((int(by[a]), int(by[b])))) for a, b in zip(i, j)}
    assert found == brute_pairs(fps, budget)


def test_fingerprint_definition():
    text = "The cat SAT on the\tmat, the Cat sat on THE mat"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(text) == want
    assert simhash.simhash("") == simhash.simhash(" \n") == 0
    assert simhash.simhash("Two words") == xxhash.xxh64_intdigest(b"two words", 42)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 25)] + [(100, k) for k in range(101, 200)] + [(7, 7), (300, 300), (0, 1)]
    rng = random.Random(2)
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(26)}, **{i: 100 for i in range(100, 200)}, 300: 300}
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_rows_of_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT_ROWS", 50)
    rows = [(7, i) for i in range(1000)] + [(None, -1), (8, -2), (9, -3), (9, -3)]
    lookup = spark.createDataFrame([(7, "x", 1000), (8, None, 1), (9, "z", 2), (10, "w", 0)], "k int, x string, n bigint")
    got = common.attach(spark.createDataFrame(rows, "k int, v int"), lookup, "k", 1004).collect()
    assert sorted((str(r.k), r.v, str(r.x)) for r in got) == sorted((str(k), v, {7: "x", 9: "z"}.get(k, "None")) for k, v in rows)
    assert len({r["__salt"] for r in got}) == 20


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_simhash_components(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, None), (201, ""), (202, "  "), (None, rows[3][1]), (5, rows[5][1])]
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    fps = [simhash.simhash(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_pairs(fps, 2):
        root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    want = sorted((str(d), f"{fps[k]:016x}", least.get(find(k))) for k, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_leave_one(spark):
    rng = random.Random(8)
    base = words(rng, 300)
    edited = list(base)
    edited[50] = "changed"
    rows = [(1, " ".join(base), "a"), (2, " ".join(edited), "b"), (3, " ".join(base), "c"), (3, " ".join(base), "c"), (4, " ".join(words(rng, 300)), "d"), (5, " ".join(base[:150] + words(rng, 150)), "e"), (6, None, None), (7, "", None)]
    got = simhash.drop_near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, fp string, __id int, row int"))
    assert got.columns == ["doc_id", "text", "fp", "__id", "row"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6]


def brute_repeats(rows):
    first = {}
    texts = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for (doc, _), (d, b) in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        gone = gone[:-1]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((str(doc), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_order_of_strings_is_that_of_the_corpus():
    rng = random.Random(9)
    for alphabet in ("ab", "abcdefgh \0", "a"):
        base = "".join(rng.choice(alphabet) for _ in range(600)).encode()
        stretches = []
        for _ in range(60):
            k = rng.randint(0, 500)
            own = base[k : k + rng.randint(50, 177)]
            if rng.random() < 0.3:
                own = own[:20] + b"XY" + own[20:]
            if len(own) >= 50:
                stretches.append(own[:177])
        text, length = b"".join(stretches), np.array([len(x) for x in stretches])
        start = np.cumsum(length) - length
        at = np.concatenate([np.arange(s, s + n - 49) for s, n in zip(start, length)])
        word = repeats.eights(np.frombuffer(text + bytes(8), np.uint8))
        order, key = repeats.corpus_order(text, word, length, at)
        strings = [text[i : i + 50] for i in at[order].tolist()]
        assert strings == sorted(strings)
        same = np.diff(key[order]) == 0
        assert all(x == y for x, y, z in zip(strings, strings[1:], same) if z)
        assert alphabet != "ab" or same.sum() > 50


def test_only_tied_strings_are_sorted_further(monkeypatch):
    rng, seen, one = random.Random(4), [], repeats.eight_at
    monkeypatch.setattr(repeats, "eight_at", lambda word, at, k: seen.append((k, len(at))) or one(word, at, k))
    for alphabet in ("ab", "\0a", "abcdefgh", "a", "\0"):
        data = "".join(rng.choice(alphabet) for _ in range(700)).encode() * 2
        word = repeats.eights(np.frombuffer(data + bytes(8), np.uint8))
        assert word.tolist() == [int.from_bytes((data + bytes(8))[i : i + 8]) for i in range(len(data) + 1)]
        at = np.array(sorted(rng.sample(range(len(data)), 500)))
        room = np.array([min(rng.choice((1, 6, 7, 8, 12, 49, 50, 90)), len(data) - i) for i in at.tolist()])
        strings = [data[i : i + min(n, 50)] for i, n in zip(at.tolist(), room.tolist())]
        places = {x: i for i, x in reversed(list(enumerate(sorted(strings), 1)))}
        seen.clear()
        assert repeats.ranked_strings(word, at, room).tolist() == [places[x] for x in strings]
        assert [n for _, n in seen] == sorted((n for _, n in seen), reverse=True) and seen[0] == (0, 500)
        assert alphabet != "abcdefgh" or sum(n for k, n in seen if k) < 500
    assert not len(repeats.ranked_strings(word, at[:0], room[:0])) and repeats.ranked_strings(word, at[:1], room[:1]).tolist() == [1]
    monkeypatch.setattr(repeats, "CACHED", 64)
    data = np.frombuffer(rng.randbytes(900), np.uint8)
    hashes = repeats.gram_hashes(data)
    value = lambda b: sum((int(x) + 1) * pow(repeats.BASE, 19 - i, 1 << 64) for i, x in enumerate(b)) % (1 << 64)
    assert hashes.tolist() == [value(data[i : i + 20]) for i in range(881)]
    assert repeats.window_minima(hashes).tolist() == [int(hashes[i : i + 31].min()) for i in range(851)]
    assert all((repeats.one_in(n, hashes) == (hashes % np.uint64(n) == 0)).all() for n in (1, 2, 3, 7, 32))


@pytest.mark.parametrize(("pass_bytes", "block_bytes", "hot"), [(1 << 20, 3 << 20, 8192), (700, 9_000, 8192), (700, 4_000, 4), (1 << 20, 3 << 20, 1)])
def test_repeats_against_brute_force(spark, monkeypatch, pass_bytes, block_bytes, hot):
    for name, value in (("PASS_BYTES", pass_bytes), ("BLOCK_BYTES", block_bytes), ("HOT_RUNS", hot), ("BUCKET_BYTES", block_bytes // 2)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(3)
    base = "".join(rng.choice("abc é") for _ in range(2500))
    rows = [(i % 50, "".join(rng.choice(["xy", "z", base[k : k + rng.randint(20, 250)]]) for k in [rng.randint(0, 2400) for _ in range(9)])) for i in range(90)]
    rows += [(60, None), (61, ""), (62, "a" * 400), (63, "a" * 300), (64, "a" * 60 + "b"), (65, "ab" * 200), (66, "ab" * 60), (67, base), (68, base), (68, base), (None, base[:100]), (70, "x" * 49), (71, "x" * 49)]
    got = repeats.repeat_digests(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute_repeats(rows)


def test_repeats_keep_other_columns(spark):
    rows = [(1, "x" * 10 + "common passage of more than fifty bytes, to be found again", 7, "n"), (2, "common passage of more than fifty bytes, to be found again" + "é tail", 8, None)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id bigint, text string, n_bytes int, block string, __block string")
    got = sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert got[0].text == rows[0][1] and got[1].text == "é tail" and got[1].n_bytes == len(rows[1][1].encode()) and got[0].block == "n" and got[0]["__block"] == "kept"
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited_copies(rng, base):
    """Copies of one text with a block added, a block cut off the end and words replaced."""
    n = len(base)
    yield "appended", base + words(rng, n * rng.randint(4, 22) // 100)
    yield "truncated", base[: n - n * rng.randint(4, 18) // 100]
    replaced = list(base)
    for k in rng.sample(range(n), max(1, n // 60)):
        replaced[k] = f"new{rng.randrange(9999)}"
    yield "replaced", replaced


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small):
    if small:  # so that keys are frequent, bands large and bit maps of several blocks
        for module, name, value in ((common, "FREQUENT_ROWS", 3), (simhash, "BAND_BLOCK", 2), (simhash, "FILTER_BITS", 12), (simhash, "FILTER_BLOCK", 6)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(11)
    rows = []
    for _ in range(40):
        base = words(rng, rng.randint(60, 900))
        rows += [(len(rows), " ".join(base))]
        rows += [(len(rows) + k, " ".join(copy)) for k, (_, copy) in enumerate(edited_copies(rng, base))]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i // 4 * 4, i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(k) for k in range(len(rows))})


def rooted(n, pairs):
    """The least member of each node's component."""
    label = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("tile, columns", [(3, 7), (256, 4096)])
@pytest.mark.parametrize("split", [None, 9])
def test_sets_compared_at_once(monkeypatch, tile, columns, split):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "COLUMNS", columns)
    rng = random.Random(3)
    groups = [rng.sample(range(900), rng.randint(5, 50)) for _ in range(5)]
    sets = [set(g) - set(rng.sample(g, rng.randint(0, len(g) // 6))) | {rng.randrange(900) for _ in range(rng.randint(0, 2))} for g in groups for _ in range(5)] + [set(), {5}]
    rng.shuffle(sets)
    near = [(i, j) for j in range(len(sets)) for i in range(j) if (split is None or i < split <= j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = simhash.near_sets([np.array(sorted(x), np.uint64) for x in sets], split)
    assert 0 < len(near) and got.tolist() == rooted(len(sets), near)


@pytest.mark.parametrize("block", [1000, 20])
def test_a_band_gives_no_more_rows_than_members(spark, monkeypatch, block):
    """All pairs of 90 members may be near: 4005 pairs, of which spanning links are asked for."""
    monkeypatch.setattr(simhash, "BAND_BLOCK", block)
    members = [(1, i, i, 100, 0, 0, 0, 0) for i in range(90)] + [(2, i, 7, 100, 0, 0, 0, 0) for i in range(5)] + [(3, 200, 200, 100, 0, 0, 0, 0), (3, 201, 201, 50, 0, 0, 0, 0)]
    got = [tuple(r) for r in simhash.band_pairs(spark.createDataFrame(members, "key bigint, id bigint, root bigint, n int, s1 bigint, s2 bigint, s3 bigint, s4 bigint")).collect()]
    assert rooted(90, got) == [0] * 90
    assert len(got) <= 90 * -(-90 // block)


@pytest.mark.parametrize("family", [1 << 19, 400])
def test_near_duplicates_in_a_family_of_unlike_texts(spark, monkeypatch, family):
    """Texts of one origin, most pairs of them under the similarity: each link must be found, and only those."""
    monkeypatch.setattr(simhash, "FAMILY_BLOCK", family)
    rng = random.Random(12)
    base = words(rng, 150)
    rows = []
    for k in range(50):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 2, 3, 3])):
            text[at] = f"new{rng.randrange(9999)}"
        rows.append((k, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for j in range(50) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = set(rooted(50, near))
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 10 and len(near) > 10 and got == want
