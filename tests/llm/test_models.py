import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import clashing, docs, empty, frame, prose, rows, rows_of  # noqa: F401
from pyspark.sql import functions as F

from leafwise.llm import class_lm, crf_lang

# --- class language model -------------------------------------------------------------------------


def tokens(text):
    return (text or "").encode().lower().split()


def test_base_scores_and_counts_match_brute_force(spark, docs, rows):
    train = docs.filter("doc_id % 3 <> 2")
    model, counts = class_lm.fit(train)
    seen, n_docs = Counter(), 0
    for doc_id, text, _ in rows:
        if doc_id % 3 != 2:
            seen.update(tokens(text))
            n_docs += 1
    n, v = sum(seen.values()) + n_docs, len(seen) + 1
    got = {r.doc_id: r for r in class_lm.score(clashing(docs), model, counts, {"even": F.col("doc_id") % 2 == 0}).collect()}
    for doc_id, text, _ in rows:
        words = tokens(text)
        r = got[doc_id]
        assert r.even == (doc_id % 2 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(seen[w] > 0 for w in words) + 1, n)
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words) + math.log10((n_docs + 1) / (n + v + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    held = [got[r[0]] for r in rows if r[0] % 3 == 2 and r[1]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_follow_the_model(spark, docs, rows, monkeypatch):
    """Every token's probability from the tables of the model; the join for rare words changes nothing."""
    plain = {r.doc_id: r.score for r in class_lm.score(docs, *class_lm.fit(docs)).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 5)
    model, counts = class_lm.fit(docs)
    assert len(model.head[0]) <= 5
    joined = {r.doc_id: r.score for r in class_lm.score(docs, model, counts).collect()}
    for doc_id in plain:
        assert abs(joined[doc_id]) > 0
    monkeypatch.undo()
    model, counts = class_lm.fit(docs)
    seen = Counter(w for _, text, _ in rows for w in tokens(text))
    for doc_id, text, _ in rows[:12]:
        words, total, before = class_lm.words_of(pa.array([text]), lower=True), 0.0, 0
        codes, hashes, endings = class_lm._types(words)
        kinds = model.class_of[model.units.of(hashes, endings)][codes]
        for word, kind in zip(tokens(text), kinds, strict=True):
            total += model.moves[before, kind] + math.log10(seen[word]) - model.totals[kind]
            before = kind
        total += model.moves[before, 0] + math.log10(model.n_docs) - model.totals[0]
        assert math.isclose(total, plain[doc_id], rel_tol=1e-9)


def test_probabilities_add_up(docs):
    model, counts = class_lm.fit(docs)
    assert np.allclose((10**model.moves).sum(axis=1), 1)
    words = counts.toPandas()
    kind = model.class_of[model.units.of(words["h"].to_numpy().view(np.uint64), words["ending"].to_numpy())]
    mass = np.bincount(kind, words["c"], class_lm.CLASSES) + 10.0**model.unseen
    mass[0] += model.n_docs
    assert np.allclose(mass / 10**model.totals, 1)


def likelihood(pairs, class_of):
    k = class_of.max() + 1
    n = np.zeros((k, k))
    np.add.at(n, (class_of[:, None], class_of[None, :]), pairs)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    rng = np.random.default_rng(3)
    kind = np.r_[0, 1 + np.arange(24) % 3]
    step = np.array([[0, 1, 0, 0], [0.1, 0.1, 0.7, 0.1], [0.1, 0.1, 0.1, 0.7], [0.1, 0.7, 0.1, 0.1]])
    pairs, u = np.zeros((25, 25), np.int64), 0
    for _ in range(6000):
        k = rng.choice(4, p=step[kind[u]])
        nxt = rng.choice(np.flatnonzero(kind == k))
        pairs[u, nxt] += 1
        u = nxt
    found = class_lm.exchange(pairs, classes=4, rounds=30)
    best = likelihood(pairs, found)
    for u in range(1, 25):
        for k in range(1, 4):
            other = found.copy()
            other[u] = k
            assert likelihood(pairs, other) <= best + 1e-6
    assert best >= likelihood(pairs, kind) - 1e-6


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_every_training_word_is_clustered(spark, docs, rows, monkeypatch, head):
    """Classes grow with the words, follow the neighbours and are used in scores, with and without a head."""
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "SPLIT", 16)
    train = docs.filter("doc_id % 3 <> 2")
    model, counts = class_lm.fit(train)
    words = counts.toPandas()
    kind = dict(zip(words["h"], words["cls"], strict=True))
    seen = dict(zip(words["h"], words["c"], strict=True))
    assert len(model.moves) == 1 + 31 * int(len(words) ** 0.5 / 16) > class_lm.CLASSES
    assert len(model.head[0]) <= head and words["cls"].between(1, len(model.moves) - 1).all()
    n = np.zeros_like(model.moves)
    got = {r.doc_id: r.score for r in class_lm.score(docs, model, counts).collect()}
    for doc_id, text, _ in rows:
        found = class_lm.words_of(pa.array([text or ""]), lower=True)
        codes, hashes, endings = class_lm._types(found)
        guess = model.class_of[model.units.of(hashes, endings)]
        names = hashes.view(np.int64)
        line = [kind.get(h, g) for h, g in zip(names[codes], guess[codes], strict=True)]
        if doc_id % 3 != 2:
            np.add.at(n, ([0, *line], [*line, 0]), 1)
        total = model.moves[[0, *line], [*line, 0]].sum() + math.log10(model.n_docs) - model.totals[0]
        for h, k in zip(names[codes], line, strict=True):
            total += (math.log10(seen[h]) if h in seen else model.unseen[k]) - model.totals[k]
        assert math.isclose(got[doc_id], total, rel_tol=1e-9)
    assert np.allclose(model.moves, np.log10((n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True)))


@pytest.mark.parametrize("line", [2, 1 << 18])
def test_lines_and_rare_words_hold_every_pair(spark, monkeypatch, line):
    """Null, empty and repeated texts, lines cut between any two words, and words outside the head side by side."""
    monkeypatch.setattr(class_lm, "LINE", line)
    texts = ["a b c a x y z a", None, "", " x y", "x y", "x y", "q", "a x x x b"]
    docs = frame(spark, list(enumerate(texts)))
    named = lambda w: class_lm.words_of(pa.array([w])).hashes[0]
    head = np.sort([named(w) for w in "abc"])
    units, coarse = class_lm._sorted_units([], []), np.array([0, 1])
    kind = lambda h: class_lm._first_class(np.atleast_1d(h), np.zeros(np.size(h), np.int64), units, coarse, 7)
    rare = class_lm.rare_words(docs, head, units, coarse, 7)
    found = {r.h: (len(r.beside), r.cls) for r in rare.collect()}
    seen = Counter(w for t in texts for w in (t or "").split())
    assert found == {int(named(w).view(np.int64)): (seen[w], kind(named(w))[0]) for w in "xyzq"}
    n = np.zeros((8, 8))
    for t in texts:
        row = [0, *(kind(named(w))[0] for w in (t or "").split()), 0]
        np.add.at(n, (row[:-1], row[1:]), 1)
    got = class_lm.class_pairs(class_lm.word_lines(docs, head), rare, np.append(0, kind(head)), 8)
    assert (got == n).all()


def test_words_move_to_the_class_of_their_neighbours(spark, monkeypatch):
    """Two kinds of words in turn, nearly all without a unit of the coarse classes: only their own moves find the kinds."""
    monkeypatch.setattr(class_lm, "WORD_UNITS", 2)
    monkeypatch.setattr(class_lm, "HEAD", 8)
    rng = random.Random(1)
    text = " ".join(f"{'ab'[i % 2]}{rng.randint(100, 299)}xyz" for i in range(4000))
    docs = frame(spark, [(1, text)])
    monkeypatch.setattr(class_lm, "MOVES", 0)
    before = class_lm.score(docs, *class_lm.fit(docs, 8)).first().score
    monkeypatch.setattr(class_lm, "MOVES", 2)
    assert class_lm.score(docs, *class_lm.fit(docs, 8)).first().score > before


def test_language_model_edge_cases(spark, docs):
    model, counts = class_lm.fit(empty(spark))
    scored = class_lm.score(frame(spark, [(1, "a b"), (1, "a b"), (2, None)]), model, counts).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in scored) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)]
    assert class_lm.score(empty(spark), *class_lm.fit(docs)).count() == 0


# --- language identification ----------------------------------------------------------------------


def brute_posteriors(scores, steps):
    """All label sequences of one short document."""
    n, k = scores.shape
    mass = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        w = np.exp(sum(scores[i, p] for i, p in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, p in enumerate(path):
            mass[i, p] += w
    return mass / mass.sum(axis=1, keepdims=True)


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(0)
    sizes = [3, 1, 0, 5, 2]
    scores, steps = rng.normal(size=(sum(sizes), 3)) * 2, rng.normal(size=(3, 3))
    bounds = np.cumsum([0, *sizes])
    found, expected = crf_lang.posteriors(scores, bounds, steps, expect=True)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            assert np.allclose(found[a:b], brute_posteriors(scores[a:b], steps))
    assert np.isclose(expected.sum(), sum(max(0, s - 1) for s in sizes))


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80, lang), lang) for i in range(150) for lang in [["en", "de", "fr"][i % 3]]]
    model = crf_lang.fit(frame(spark, rows[:120]))
    found = crf_lang.identify(frame(spark, rows[120:]), model).collect()
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in found)
    mixed = prose(rng, 30, "en") + " " + prose(rng, 30, "de")
    spans = crf_lang.identify(frame(spark, [(1, mixed)]), model, spans=True).first().spans
    labels = [s["lang"] for s in spans for _ in range(s["n"])]
    truth = ["en"] * 30 + ["de"] * 30
    assert len(labels) == 60 and sum(a == b for a, b in zip(labels, truth, strict=True)) >= 56


def test_the_sample_takes_copies_once_and_long_texts_at_need(spark, monkeypatch):
    monkeypatch.setattr(crf_lang, "MAX_BYTES", 200)
    rng = random.Random(5)
    rows = [(i, "a copy of one text", "en") for i in range(300)] + [(400 + i, f"other text {i}", "en") for i in range(30)]
    rows += [(500 + i, prose(rng, 100, "de"), "de") for i in range(4)] + [(600, "kurz und gut", "de"), (700, None, "fr"), (701, "x", None)]
    drawn = crf_lang.draw(frame(spark, rows).repartition(3), 8, 1)
    counts = drawn.groupby("lang").size().to_dict()
    assert counts == {"de": 5, "en": 8} and drawn["text"].is_unique and drawn["text"].str.len().max() == 200
    again = crf_lang.draw(frame(spark, rows[::-1]).repartition(2), 8, 1)
    assert drawn.equals(again)


def test_identification_edge_cases(spark, docs, rows):
    model = crf_lang.fit(docs)
    found = crf_lang.identify(clashing(docs), model)
    assert found.columns.count("lang_pred") == 1
    by_id = {r.doc_id: r for r in found.collect()}
    assert len(by_id) == len(rows)
    for i in (200, 201, 202, 207):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[206].lang_pred != "und"
    assert crf_lang.fit(empty(spark)) is None
    assert [r.lang_pred for r in crf_lang.identify(docs, None).collect()] == ["und"] * len(rows)
    assert crf_lang.identify(empty(spark), model).count() == 0
    one = crf_lang.fit(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in crf_lang.identify(docs, one).collect()} == {"en", "und"}
    assert rows_of(crf_lang.identify(frame(spark, [(1, "12 中文")]), one).select("lang_pred")) == [("en",)]
