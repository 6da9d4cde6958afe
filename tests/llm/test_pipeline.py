import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from test_copies import brute_repeats, shingles
from waymark.llm import decontaminate, pieces, ranking
from waymark.llm.queries import table, tokenizer_file


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, before = {}, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SMALL)
        after = made.collect()
        out[name] = (before, after, made.columns)
        docs, before = spark.createDataFrame(after, made.schema), after
    return out


def test_stages_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "token_ids"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        before, after, made = stages[name]
        assert made == columns and 0 < len(after) <= len(before), name


def test_quality_keeps_what_the_model_scores_above_its_cut(spark, stages):
    before, after, _ = stages["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    import zlib

    own = sorted((r for r in before if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5), key=lambda r: r.doc_id)
    spark_order = ranking.feature_rows(spark.createDataFrame(own, table(spark, SMALL, "documents").schema)).collect()
    assert [ranking.features(r.text or "") for r in own] == [x.features for x in sorted(spark_order, key=lambda r: r.doc_id)]
    model = ranking.fit_on_labels(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    want = {r.doc_id for r in before if model.score(np.array([ranking.features(r.text or "")]))[0] >= ranking.CUT}
    assert {r.doc_id for r in after} == want and all(tuple(r) in set(map(tuple, before)) for r in after)


def test_near_duplicates_leave_the_least_of_each_group(stages):
    before, after, _ = stages["near_duplicates"]
    rows = sorted(before, key=lambda r: r.doc_id)
    sets = [shingles(r.text or "") for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(rows) if find(i) == i]


def test_repeated_passages_are_cut(stages):
    before, after, _ = stages["repeated_passages"]
    want = {int(d): (n, removed) for d, n, removed, _, _ in brute_repeats([(r.doc_id, r.text) for r in before])}
    text = {r.doc_id: r.text for r in after}
    assert set(text) == {d for d, (n, removed) in want.items() if n > removed or not removed}
    # A cut inside a character drops its remaining bytes too.
    assert all(0 <= want[d][0] - want[d][1] - len((t or "").encode()) <= 6 * want[d][1] // 50 for d, t in text.items())
    assert all(r.n_chars == len(r.text) for r in after)


def least_edits(item, text):
    """Least edits of the item against any part of the text: rows of the full table."""
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (item, text))
    row, column = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, c in enumerate(a):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (b != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - column) + column
    return int(row.min())


def test_benchmark_leaks_go(spark, stages):
    before, after, _ = stages["benchmark_leaks"]
    items = [decontaminate.normal(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    budget = [decontaminate.edits_allowed(len(x), decontaminate.Q, decontaminate.EDIT_RATE) for x in items]
    kept = {r.doc_id for r in after}
    for r in before:
        text = decontaminate.normal(r.text or "")
        assert (r.doc_id not in kept) == any(least_edits(x, text) <= k for x, k in zip(items, budget)), r.doc_id


def test_token_ids_are_the_best_segmentation(stages):
    before, after, _ = stages["token_ids"]
    model = pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    score = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == pieces.NORMAL}
    best_of = {}

    def best(word):
        if word not in best_of:
            sums = [0.0] + [-np.inf] * len(word)
            for end in range(1, len(word) + 1):
                for start in range(max(0, end - model.longest), end):
                    s = score.get(word[start:end], model.unknown_score if end - start == 1 else None)
                    if s is not None:
                        sums[end] = max(sums[end], sums[start] + s)
            best_of[word] = sums[-1]
        return best_of[word]

    text = {r.doc_id: r.text or "" for r in before}
    assert len(after) == len(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)
    for r in after[:60]:
        words = [pieces.SPACE + w for w in text[r.doc_id].replace("\n", " \n").split(" ")]
        whole = "".join(words).replace(pieces.SPACE + "\n", "\n")
        import re

        want = sum(best(w) for w in re.findall(f"{pieces.SPACE}*[^{pieces.SPACE}\n]+|\n|{pieces.SPACE}+", whole))
        unknown = sum(c not in score for c in whole)
        got = sum(model.scores[i] for i in r.ids if model.types[i] != pieces.BYTE) + unknown * model.unknown_score
        assert got == pytest.approx(want), r.doc_id


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
