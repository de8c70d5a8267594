import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from llm_helpers import clashing, docs, empty, frame, prose, rows, rows_of  # noqa: F401

from leafwise.llm import icws, line_clean, substring
from leafwise.llm.words import words_of

# --- substring dedup ------------------------------------------------------------------------------


def brute_substring(rows, size):
    first = {}
    split = {}
    for doc_id, text, *_ in rows:
        ws = (text or "").encode().split()
        split.setdefault(doc_id, []).append(ws)
        for i in range(len(ws) - size + 1):
            key = tuple(ws[i : i + size])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, texts in split.items():
        for ws in texts:
            lost = set()
            for i in range(len(ws) - size + 1):
                if first[tuple(ws[i : i + size])] < doc_id:
                    lost.update(range(i, i + size))
            kept = b" ".join(w for i, w in enumerate(ws) if i not in lost)
            out.append((doc_id, len(ws), len(lost), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 16])
def test_substring_dedup_matches_brute_force(spark, docs, rows, bits):
    got = substring.with_digest(substring.remove_repeats(clashing(docs), bits=bits))
    assert sorted(rows_of(got)) == brute_substring(rows, substring.WINDOW)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With far fewer cells than windows every window passes, and the exact pass still decides."""
    monkeypatch.setattr(substring, "MIN_BITS", 4)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(40)]
    for bits in (4, 6):
        got = substring.with_digest(substring.remove_repeats(frame(spark, rows), size=4, bits=bits))
        assert sorted(rows_of(got)) == brute_substring(rows, 4)


def test_substring_shards_and_merged_flushes(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_BYTES", 3000)
    got = substring.with_digest(substring.remove_repeats(docs))
    assert sorted(rows_of(got)) == brute_substring(rows, substring.WINDOW)


def test_substring_edge_cases(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0
    same = " ".join(f"w{i}" for i in range(20))
    found = substring.remove_repeats(frame(spark, [(None, same), (2, same), (2, same), (3, None), (1, "short")]), rebuilt=False)
    assert sorted(((r.doc_id or -1), r.n_removed, r.kept_text) for r in found.collect()) == [
        (-1, 0, same), (1, 0, "short"), (2, 0, same), (2, 0, same), (3, 0, ""),
    ]


# --- near-duplicates ------------------------------------------------------------------------------


def brute_classes(rows, similarity=icws.SIMILARITY):
    """Components of all pairs with the weighted Jaccard similarity of the operator's weights."""
    texts = sorted((r[0], r[1] or "") for r in rows)
    doc, hashes, counts = icws.shingles(words_of(pa.array([t for _, t in texts]), lower=True))
    sketch = np.stack([np.bincount(icws._cells(hashes, r), minlength=1 << icws.SKETCH_BITS) for r in range(icws.SKETCH_ROWS)])
    sets = defaultdict(dict)
    for d, h, w in zip(doc.tolist(), hashes.tolist(), icws.weights(hashes, counts, sketch).tolist(), strict=True):
        sets[d][h] = w
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b]:
                both = sum(min(w, sets[b][h]) for h, w in sets[a].items() if h in sets[b])
                if both >= similarity * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {texts[i][0]: texts[find(i)][0] for i in range(len(texts))}


def test_classes_match_all_pairs(spark, docs, rows):
    assert dict(rows_of(icws.classes(clashing(docs)))) == brute_classes(rows)


def chain(n, words, step, seed=5):
    """Documents that each change a few words of the one before: links run along the chain."""
    rng = random.Random(seed)
    now = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        out.append((i, " ".join(now)))
        for _ in range(step):
            now[rng.randrange(words)] = f"w{rng.randint(0, 10**6)}"
    return out


@pytest.mark.parametrize(("tries", "words", "step"), [(0, 300, 3), (2, 120, 2)])
def test_chains_in_one_bucket_stay_whole(spark, monkeypatch, tries, words, step):
    """Most members are no match of their bucket's first one; later rounds link them through each other."""
    monkeypatch.setattr(icws, "BLOCK", 7)
    monkeypatch.setattr(icws, "SMALL", 2)
    monkeypatch.setattr(icws, "TRIES", tries)
    rows = chain(60, words, step)
    got = dict(rows_of(icws.classes(frame(spark, rows))))
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) < 30


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    agree, expect = [], []
    for k in range(60):
        own = rng.integers(1, 1 << 62, (2, 60)).astype(np.uint64)
        parts = [np.sort(np.concatenate([shared[k : k + 200], o])) for o in own]
        weights = {int(h): 1 + (int(h) % 7) / 3 for p in parts for h in p}
        doc = np.repeat([0, 1], [len(p) for p in parts])
        flat = np.concatenate(parts)
        values = icws.sample(doc, flat, np.array([weights[int(h)] for h in flat]), 2)
        agree.append((values[0] == values[1]).mean())
        both = sum(weights[int(h)] for h in shared[k : k + 200])
        expect.append(both / (both + sum(weights[int(h)] for h in own.ravel())))
    assert abs(np.mean(agree) - np.mean(expect)) < 0.02


def test_near_duplicate_edge_cases(spark):
    assert icws.classes(empty(spark)).count() == 0
    found = icws.classes(frame(spark, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A  b c"), (7, None), (8, ""), (9, "")]))
    assert sorted(rows_of(found), key=str) == sorted([(None, None), (5, 4), (5, 4), (4, 4), (7, 7), (8, 8), (9, 9)], key=str)


def test_weights_do_not_fade_with_the_number_of_shingles():
    """A shingle of one document keeps its weight when a thousand times as many shingles share the cells as there are cells."""
    rng = np.random.default_rng(5)
    rare, common = np.array([1, 2, 3], np.uint64) * np.uint64(977), np.array([4], np.uint64)
    width = 1 << icws.SKETCH_BITS
    for load in (0, 1, 1000):
        sketch = rng.poisson(load, (icws.SKETCH_ROWS, width)) if load else np.zeros((icws.SKETCH_ROWS, width), int)
        for row in range(icws.SKETCH_ROWS):
            np.add.at(sketch[row], icws._cells(rare, row), 1)
            sketch[row][icws._cells(common, row)] += load * width // 10 + 1000
        assert (icws.weights(rare, np.ones(3), sketch) > 1 + 0.7 * icws.IDF_SHARE).all()
        assert icws.weights(common, np.ones(1), sketch)[0] < 1 + 0.2 * icws.IDF_SHARE


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    links = [(a, b) for a, b in links if a != b]
    got = dict(rows_of(icws.components(spark.createDataFrame(links, "a long, b long"))))
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


# --- line cleaning --------------------------------------------------------------------------------


def test_line_rules_and_text(spark):
    good = " ".join(f"word{i}" for i in range(30)) + "."
    last = " ".join(f"other{i}" for i in range(30)) + "."
    lines = [good, "Home | About | Contact | Help", "a short heading", "Click here to read more.", "x$$$ y%%% z***", "Done well.", "All rights reserved.", ""]
    row = line_clean.clean_lines(frame(spark, [(1, "\n".join([*lines, last]))])).first()
    assert row.clean_text == "\n".join([good, "Done well.", "", last])
    assert row.kept and not row.base_failed
    heavy = line_clean.clean_lines(frame(spark, [(1, "\n".join([good, *["menu | item | link | more"] * 6]))])).first()
    assert not heavy.kept


def brute_measures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {p for i, w in enumerate(windows) if counts[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force_and_sql(spark, docs, rows):
    import duckdb

    rng = random.Random(6)
    more = [(1000 + i, "\n".join(rng.choice(["a b c d e f", "a b # c", " ", "é ß 中 |", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    both = docs.unionByName(frame(spark, more))
    out = line_clean.OUT.split(", ")
    got = line_clean.clean_lines(clashing(both)).select(*out).toPandas().sort_values("doc_id", ignore_index=True)
    for r in got.itertuples():
        text = {x[0]: x[1] for x in [*rows, *more]}[r.doc_id]
        want = brute_measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    documents = both.toPandas()  # noqa: F841 - read by DuckDB
    sql = duckdb.sql(line_clean.SQL).df().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got[out], sql[out], check_dtype=False)
    assert line_clean.clean_lines(empty(spark)).count() == 0
