import collections
import re

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import line_crf, ranking

DOCS = "doc_id bigint, text string, lang string, score double"
EDGE = [(1, None, "en", 0.5), (2, "", None, None), (None, "a b", "en", 1.0), (4, "x " * 40_000, "en", 0.0), (4, "x " * 40_000, "en", 0.0), (5, " \n\t ", "en", 0.0)]


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered, seen, dup = set(), set(), 0
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        dup += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\té \x1c", max_size=60))
def test_base_counts(text):
    assert line_crf.base_counts(text) == brute_counts(text)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6))
def test_viterbi_is_the_best_labelling(n, seed):
    rng = np.random.default_rng(seed)
    chain = line_crf.Chain(np.zeros((2, 1)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = rng.normal(size=(n, 2))

    def total(labels):
        return chain.start[labels[0]] + sum(scores[i, y] for i, y in enumerate(labels)) + sum(chain.transition[a, b] for a, b in zip(labels, labels[1:]))

    best = max(total([k >> i & 1 for i in range(n)]) for k in range(1 << n))
    assert total(line_crf.viterbi(scores, chain)) == pytest.approx(best)


def test_crf_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in line_crf.line_rules(docs, labels).collect()}
    assert len(got) == docs.count()
    marked = [(got[r.doc_id], r.quality) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean([r.kept for r, q in marked if q]) > 0.95 and np.mean([r.kept for r, q in marked if not q] or [0]) < 0.2


def test_rules_on_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = line_crf.line_rules(docs, labels).collect()
    assert len(rows) == len(EDGE) and not any(r.kept for r in rows) and all(r.base_failed for r in rows)
    assert line_crf.line_rules(docs.limit(0), labels).count() == 0
    long = "\n".join(f"line {k} has words{k}" for k in range(20_000)) + "\nBUY!! " * 2000
    mixed = spark.createDataFrame([(1, long, "en", 0.0), (1, long, "en", 0.0)], DOCS)
    assert [(r.kept, r.content_share) for r in line_crf.line_rules(mixed, labels).collect()] == [(True, 1.0)] * 2


def test_ranking_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in ranking.rank_documents(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95


def test_ranking_on_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    assert ranking.rank_documents(docs, labels).count() == len(EDGE)
    model = ranking.fit(np.zeros((0, len(ranking.FEATURES))), np.zeros(0))
    scored = ranking.score_documents(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "score", "predicted"] and scored.where("predicted = 1").count() == len(EDGE)


def test_pairwise_fit_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(ranking.FEATURES)))
    y = (x[:, 2] < 0.5).astype(int)
    model = ranking.fit(x, y)
    assert ((model.score(x) >= ranking.CUT) == y).mean() > 0.97


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "river", "stone", "window", "summer"]) + str(rng.integers(9)) for _ in range(n)) + "."


def planted(rng, footer):
    return "\n".join([*(prose(rng, int(rng.integers(20, 60))) for _ in range(int(rng.integers(2, 6)))), footer])


def test_footers_are_marked_inside_good_documents():
    rng = np.random.default_rng(2)
    footers = ["All rights reserved by us", "Subscribe now", "Back to top"]
    texts = [planted(rng, footers[k % 3]) if k % 4 else "BUY!! NOW!! " * 20 + "\n" + footers[k % 3] for k in range(300)]
    texts += [texts[1]] * 20  # copies make no line a template
    keys = [np.array(line_crf.line_keys(t), dtype=np.int64) for t in texts]
    labels = line_crf.weak_labels(keys, [int("BUY" not in t) for t in texts])
    assert all(y.tolist() == ([0, 0] if "BUY" in t else [1] * (len(y) - 1) + [0]) for t, y in zip(texts, labels))
    chain = line_crf.train([np.array(line_crf.document_lines(t)[0]) for t in texts], labels)
    for k in range(3):
        features, words = line_crf.document_lines(planted(rng, footers[k]))
        marks = line_crf.viterbi(np.array(features) @ chain.emission.T, chain)
        assert marks == [1] * (len(marks) - 1) + [0] and line_crf.content_share(features, words, chain) == sum(words[:-1]) / sum(words) < 1


def test_kept_equals_brute_force_over_all_labellings(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    chain = line_crf.train_on_labels(docs, labels)
    shares = []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in line_crf.apply_rules(docs, chain).collect():
        features, words = line_crf.document_lines(texts[r.doc_id] or "")
        if not 0 < len(words) <= 10:
            continue
        scores = np.array(features) @ chain.emission.T

        def total(y):
            return chain.start[y[0]] + sum(scores[i, z] for i, z in enumerate(y)) + sum(chain.transition[a, b] for a, b in zip(y, y[1:]))

        best = max(([k >> i & 1 for i in range(len(words))] for k in range(1 << len(words))), key=total)
        share = sum(n for n, z in zip(words, best) if z) / sum(words)
        n_words, _, _, _, repeated = brute_counts(texts[r.doc_id])
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        assert (r.base_failed, r.kept) == (failed, not failed and share >= line_crf.SHARE) and r.content_share == pytest.approx(share)
        shares.append(share)
    assert len(shares) > 100 and any(0 < x < 1 for x in shares)


def test_training_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    x, y = [rng.normal(size=(n, len(line_crf.FEATURES))) for n in (1, 2, 4)], [np.array(v) for v in ([1], [0, 1], [1, 1, 0, 0])]
    chain = line_crf.train(x, y, rounds=3000, rate=0.05, ridge=0.01)

    def loss(theta):
        w = len(line_crf.FEATURES)
        c = line_crf.Chain(theta[: 2 * w].reshape(2, w), theta[2 * w : 2 * w + 4].reshape(2, 2), theta[-2:])
        value = 0.0
        for f, own in zip(x, y):
            scores = f @ c.emission.T
            total = lambda z: c.start[z[0]] + sum(scores[i, k] for i, k in enumerate(z)) + sum(c.transition[a, b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            every = [total([k >> i & 1 for i in range(len(own))]) for k in range(1 << len(own))]
            value += total(own.tolist()) - np.logaddexp.reduce(every)
        return -value / 7 + 0.005 * (theta @ theta)

    theta = np.concatenate([chain.emission.ravel(), chain.transition.ravel(), chain.start])
    slopes = [(loss(theta + d) - loss(theta - d)) / 2e-5 for d in np.eye(len(theta)) * 1e-5]
    assert np.abs(slopes).max() < 1e-3


def test_pairwise_fit_is_the_optimum():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, len(ranking.FEATURES)))
    y = (x[:, 1] + rng.normal(size=40) > 0).astype(int)
    model = ranking.fit(x, y, seed=3, ridge=0.05)
    z = np.clip((x - model.mean) / model.scale, -ranking.CLIP, ranking.CLIP)
    good, bad = z[y == 1], z[y == 0]
    draw = np.random.default_rng(3)
    winners = np.concatenate([np.repeat(np.arange(len(good)), ranking.OPPONENTS), draw.integers(0, len(good), len(bad) * ranking.OPPONENTS)])
    losers = np.concatenate([draw.integers(0, len(bad), len(good) * ranking.OPPONENTS), np.repeat(np.arange(len(bad)), ranking.OPPONENTS)])
    w = np.zeros(x.shape[1])
    for _ in range(20_000):  # plain descent, pair by pair loss
        d = good[winners] - bad[losers]
        w -= 0.05 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 0.05 * w)
    assert np.allclose(w, model.weights, atol=1e-4)
    # The cut: no other quantile of the training scores separates the labels better.
    raw = model.raw(x)
    errors = lambda cut: (raw[y == 1] < cut).mean() + (raw[y == 0] >= cut).mean()
    assert errors(model.cut) <= min(map(errors, [*raw, raw.max() + 1])) + 1e-12


def test_training_sees_late_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_crf, "train", lambda sequences, labels: seen.extend(map(len, sequences)))
    docs = spark.createDataFrame([(1, "a line of words\n" * 250, "en", 1.0), (2, "short", "en", 0.0)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    line_crf.train_on_labels(docs, labels)
    assert sorted(seen) == [1, 250]
