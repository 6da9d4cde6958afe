import base64
import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import common, pieces, sharding, token_store, warc
from waymark.llm.common import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string"
TEXTS = st.text(alphabet=" ab'sé5!\n\t。<|endoftx> ", max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def encoder():
    return token_store.FastEncoder(BPE)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_fast_encoder_equals_the_library(library, encoder, text):
    assert encoder.encode([text])[0] == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_encoder_forgets_without_harm(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_WORDS", 20)
    monkeypatch.setattr(token_store, "CACHE_PRETOKENS", 10)
    own = token_store.FastEncoder(BPE)
    for i in range(30):
        text = " ".join(f"word{chr(97 + (i + k) % 26)} thing{k}," for k in range(12))
        assert own.encode([text])[0] == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_letters_with_a_mark_are_not_cut_by_the_pattern(library, monkeypatch):
    cut, one = [], token_store.FastEncoder._cut
    monkeypatch.setattr(token_store.FastEncoder, "_cut", lambda self, piece: cut.append(piece) or one(self, piece))
    texts = ["a plain word, another; Élan! word? x.", "word, word. a1, b.c, (d) ,. \nline, end:", ""]
    own = token_store.FastEncoder(BPE)
    expected = [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert own.encode(texts) == expected
    assert not {"plain", "word,", "another;", "Élan!", "word?", "x."}.intersection(cut) and {"a1,", "b.c,", "\nline,"} <= set(cut)


def test_pieces_are_encoded_together_and_once(library, monkeypatch):
    own, asked, cut = token_store.FastEncoder(BPE), [], []
    one, pattern = token_store.FastEncoder._together, token_store.FastEncoder._cut
    monkeypatch.setattr(token_store.FastEncoder, "_together", lambda self, words, lead: asked.extend(lead + w for w in words) or one(self, words, lead))
    monkeypatch.setattr(token_store.FastEncoder, "_cut", lambda self, piece: cut.append(piece) or pattern(self, piece))
    texts = ["of words\nand lines\nélan words, zu\nzu", "", "\nand words,  twice", "of Élan", "naïve\tof", " of", "of "]
    assert own.encode(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert {" words", "\nand", "\nélan", "\nzu", " zu"} <= set(asked) and not {"\nand", "\nélan", "\nzu"}.intersection(cut)
    before = len(asked)
    own.encode(texts)
    assert asked.count("\nand") == 1 and len(asked) == before and own.encode([]) == []


def test_merges_over_a_border_are_left_to_the_pattern(tmp_path):
    import json

    alphabet = {c: i for i, c in enumerate(token_store.byte_alphabet().values())}
    merges = [["\u010a", "a"], ["b", "\u0120"], ["a", "b"]]  # a line end with a letter, a letter with a space
    vocab = alphabet | {"".join(m): 256 + k for k, m in enumerate(merges)}
    with open(BPE) as f:
        made = json.load(f)
    made["model"] |= {"vocab": vocab, "merges": merges}
    made["added_tokens"] = []
    (tmp_path / "small.json").write_text(json.dumps(made))
    own, library = token_store.FastEncoder(str(tmp_path / "small.json")), Tokenizer.from_file(str(tmp_path / "small.json"))
    texts = ["ab ab b\nab ba", "b aab\naé é\né", "x ab\nb"]
    assert own.known and own.encode(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_other_tokenizers_are_served_by_the_library(library, tmp_path):
    import json

    assert token_store.is_byte_bpe(BPE)
    with open(BPE) as f:
        made = json.load(f)
    made["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(made))
    own = token_store.FastEncoder(str(tmp_path / "other.json"))
    texts = ["Hello WORLD", "", "A  b\nC"]
    assert not own.known and own.encode(texts) == [np.asarray(library.encode(t.lower(), add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_memories_are_bounded_in_characters(library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_CHARS", 300)
    own = token_store.FastEncoder(BPE)
    for i in range(20):
        text = f"a{'bc' * i}d " * 3 + "x" * (40 * i)
        assert own.encode([text])[0] == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert own.word_chars < 2000 and len(own.words) < 20


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    levels = token_store.build_mph(keys)
    assert sorted(token_store.mph_slots(levels, keys).tolist()) == list(range(len(keys)))
    assert token_store.build_mph(keys[:0]) == []


def test_store_round_trip_and_lookup(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "KEYS_PER_BUCKET", 1)  # so that some buckets are empty
    rows = [(i * 3, f"text number {i} " * (i % 5)) for i in range(60)] + [(6, "again"), (None, "no key"), (0, "zero"), (-(1 << 63), "the least"), (None, "none again"), (500, None), (501, ""), (502, "long " * 50_000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = token_store.store_digest(docs, BPE).collect()
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(encode(t)), crc(encode(t))) for d, t in rows)
    placed = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in placed[:3]] == [None, None, -(1 << 63)] and [r.doc_id for r in placed[2:]] == sorted(r.doc_id for r in placed[2:])
    assert [r.start for r in placed] == [sum(x.n_tokens for x in placed[:i]) for i in range(len(placed))]
    path = scratch_path(spark, "store-test")
    token_store.write_store(docs, path, BPE, shard_ids=300)
    found = token_store.fetch(spark, path, spark.createDataFrame([(6,), (9,), (9999,), (502,)], "doc_id bigint")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted((d, encode(t)) for d, t in rows if d in (6, 9, 502))
    for key in (None, -(1 << 63), 0):
        found = token_store.fetch(spark, path, spark.createDataFrame([(key,)], "doc_id bigint")).collect()
        assert sorted((r.doc_id is None, list(r.ids)) for r in found) == sorted((d is None, encode(t)) for d, t in rows if d == key)
    assert token_store.store_digest(docs.limit(0), BPE).count() == 0


def test_chunked_framing():
    for text in ("", "é" * 5000, "a\r\n0\r\n\r\nb" * 3000):
        assert warc.dechunked(warc.chunked(text.encode(), 777)) == text.encode()
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("frequent", [2, 1000])
def test_archive_round_trip(spark, monkeypatch, frequent):
    monkeypatch.setattr(common, "FREQUENT_ROWS", frequent)
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "u", "x" * 2000), (2, None, "x" * 2000), (3, "u", "s"), (4, "u", "s"), (5, "a\r\nb", None), (None, "u", "x" * 2000), (7, "h", long), (7, "h", long), (8, "h", "y" * 999), (9, "h", "y" * 999), (10, "h", "z" * 1000), (11, "h", "z" * 1000), (11, "i", "z" * 1000), (11, "i", "z" * 1000)]
    rows += [(None, "u", "w" * 1500), (None, "v", "w" * 1500), (-5, "u", "v" * 1500), (-4, "u", "v" * 1500)]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", digest string").repartition(3)).collect()
    refers = {(1, "x"): 2, (None, "x"): 2, (10, "z"): 11, (-5, "v"): -4}
    want = [(str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (p, (h or " ")[0]) in refers else "response", refers.get((p, (h or " ")[0]))) for p, _, h in rows]
    assert sorted(map(str, [(str(r[0]), *r[1:]) for r in got])) == sorted(map(str, want))
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive_files(spark, path):
    return [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]


def test_archives_are_standard(spark):
    path = scratch_path(spark, "warc-test")
    rows = [(k, f"http://a/{k}", ("same" * 400 if k % 3 else f"own {k}" * 9000)) for k in range(30)] + [(29, "http://a/29", "same" * 400)] * 3
    warc.write_archive(spark.createDataFrame(rows, PAGES), path)
    ids, refers, dates, segments = [], [], 0, 0
    for data in archive_files(spark, path):
        # The standard library reads all members; each holds one record or nothing.
        assert gzip.decompress(data) == warc.members(data)
        rest = data
        while rest:
            unpacker = zlib.decompressobj(31)
            assert len(list(warc.parse_records(unpacker.decompress(rest)))) <= 1
            rest = unpacker.unused_data
        for h, _ in warc.parse_records(warc.members(data)):
            ids.append(h["warc-record-id"])
            refers += [h["warc-refers-to"]] if h["warc-type"] == "revisit" else []
            dates += "warc-date" in h
            segments += h["warc-type"] == "continuation"
    assert len(set(ids)) == len(ids) == dates and segments and len(refers) == 19 and set(refers) <= set(ids)


def foreign(kind, number, block, *more):
    return warc.gzip_member(warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Date", warc.DATE), *more], block))


def test_foreign_archives(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    parts = [foreign("warcinfo", 0, b"software: x\r\n"), foreign("response", 1, head + b"hello", ("WARC-Payload-Digest", digest)), foreign("request", 2, b"GET / HTTP/1.1\r\n\r\n"), foreign("revisit", 3, head, ("WARC-Refers-To", "<urn:uuid:1>"), ("WARC-Payload-Digest", digest))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    read = lambda: warc.resolve(warc.reassemble(warc.read_records(spark, f"file://{tmp_path}"))).collect()
    assert sorted((r.id, r.type, r.payload_bytes) for r in read()) == [("<urn:uuid:1>", "response", 5), ("<urn:uuid:3>", "revisit", 5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*parts, foreign("revisit", 4, head, ("WARC-Refers-To", "<urn:uuid:9>"))]))
    with pytest.raises(Exception, match="names no record"):
        read()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts)[:-9])
    with pytest.raises(Exception, match="cut short"):
        read()


def test_lost_segment_is_an_error(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(1, "u", "q" * 100_000)], PAGES), path)
    records = warc.read_records(spark, path)
    assert records.where("segment > 0").count() == 4
    with pytest.raises(Exception, match="missing"):
        warc.reassemble(records.where("segment <> 2")).collect()


def test_shards(spark):
    rows = [(i % 300, f"t{i % 7}") for i in range(1003)] + [(None, None)]
    got = sharding.document_shards(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), 16 + len(t or ""), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.document_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_shuffle_is_uniform_and_keeps_columns(spark):
    df = spark.range(4000).selectExpr("id", "id AS slot", "'x' AS shard", "id AS __row", "id AS __part", "id + 1 AS __key", "id AS row", "id AS `a.b`", "id AS __bounds")
    got = sharding.communication_shuffle(df, 8, seed=5, rows_per_partition=300)
    assert got.columns == ["id", "__row", "__part", "__key", "row", "a.b", "__bounds", "shard", "slot"]
    rows = got.collect()
    assert all(r["__row"] == r["__part"] == r["__key"] - 1 == r["row"] == r["a.b"] == r.id for r in rows)
    table = np.zeros((8, 8))
    for r in rows:
        table[r.id * 8 // 4000, r.shard] += 1
    # 49 degrees of freedom: 100 is far in the tail.
    assert ((table - 62.5) ** 2 / 62.5).sum() < 100 and (table.sum(0) == 500).all()
    matrix = sharding.communication_matrix([5, 0, 17, 3], 4, 1)
    assert matrix.sum(1).tolist() == [5, 0, 17, 3] and set(matrix.sum(0)) <= {6, 7}


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" abethinTo\né日🎉.", max_size=24))
def test_pieces_round_trip_and_best_score(model, text):
    packed = model.encode([text])[0]
    assert model.decode(packed) == text
    ids = np.frombuffer(packed, model.dtype).tolist()
    whole = ("▁" + text.replace(" ", "▁")) if text else ""
    table = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == pieces.NORMAL}
    best = [0.0] + [-np.inf] * len(whole)
    for end in range(1, len(whole) + 1):
        for start in range(max(0, end - model.longest), end):
            s = table.get(whole[start:end], model.unknown_score if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    n_unknown = sum(c not in table for c in whole)
    score = sum(model.scores[i] for i in ids if model.types[i] != pieces.BYTE) + n_unknown * model.unknown_score
    assert score == pytest.approx(best[-1])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abethinTo\né日🎉.▁", min_size=1, max_size=40))
def test_long_words_are_cut_as_short_ones(model, word):
    import unittest.mock

    with unittest.mock.patch.object(pieces, "SEGMENT", 7):
        long = model.long_viterbi(word)
    assert model.packed(long, word) == model.encode_words([word])[0]


def test_a_word_of_any_length(model):
    import time
    import tracemalloc

    began = time.time()
    text = "日本語thereisnospace" * 6_000
    tracemalloc.start()
    packed = model.encode([text])[0]
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert len(model.encode([text * 8])[0]) > 7 * len(packed)
    assert model.decode(packed) == text and time.time() - began < 120


def test_pieces_equal_the_library_as_unigram_model(model):
    import sentencepiece

    with open(MODEL, "rb") as f:
        data = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=data.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    for text in ("there is the thing", "Hello wörld", "onatou the.", "a  b", "x"):
        ours = [model.pieces[i] for i in np.frombuffer(model.encode([text])[0], model.dtype)]
        score = lambda ps: sum(model.scores[model.pieces.index(p)] for p in ps)
        assert score(ours) == score(library.nbest_encode_as_pieces(text, 2)[0])


def test_pieces_on_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a▁b"), (None, "x y"), (4, "word " * 30_000), (4, "word " * 30_000)]
    got = pieces.encode_documents(spark.createDataFrame(rows, DOCS), MODEL).collect()
    assert sorted((str(r.doc_id), r.round_trip) for r in got) == sorted((str(d), d != 3) for d, _ in rows)
    assert all(r.n_tokens == len(r.ids) for r in got) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
