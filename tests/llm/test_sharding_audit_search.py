import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_helpers import clashing, docs, empty, frame, prose, rows, rows_of  # noqa: F401
from pyspark.sql import functions as F

from leafwise.llm import filter_audit, ranked_search, sharding

# --- sharding -------------------------------------------------------------------------------------


def brute_owner(key, weights):
    name = "n" if key is None else f"k{key}"

    def score(s):
        digits = int(hashlib.md5(f"{name}:{s}".encode()).hexdigest()[: sharding.DIGITS], 16)
        return -math.log((digits + 0.5) / 16**sharding.DIGITS) / weights[s]

    return min((s for s in range(len(weights)) if weights[s] > 0), key=lambda s: (score(s), s))


def written(spark, tmp_path, docs, weights, **more):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, weights, **more)
    return sharding.read_shards(spark, path)


def test_shards_match_brute_force_and_come_back_whole(spark, docs, rows, tmp_path):
    weights = [1.0, 2.0, 0.0, 4.0]
    got = written(spark, tmp_path, clashing(docs).withColumn("shard", F.lit("x")), weights, grown=[1.0], part_bytes=4000)
    found = got.select("doc_id", "text", "size", "shard", "slot", "grown_shard", "law").collect()
    assert sorted((r.doc_id, r.text or "") for r in found) == sorted((r[0], r[1] or "") for r in rows)
    for r in found:
        assert r["shard"] == brute_owner(r.doc_id, weights)
        assert r["grown_shard"] == brute_owner(r.doc_id, [*weights, 1.0]) and r["grown_shard"] in (r["shard"], 4)
        assert r["size"] == len((r.text or "").encode()) + 16 and r["law"] == "key"
    for shard in {r["shard"] for r in found}:
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert "n_words" in got.columns and got.columns.count("shard") == 1


def test_few_rows_move_and_weights_hold(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    even = [1.0] * 8
    shares = {r["shard"]: r["count"] for r in sharding.assign(ids, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(shares[1] / 20_000 - 0.75) < 0.02
    grown = sharding.moved(ids, even, [*even, 1.0])
    assert {r[0] for r in grown.select("to_shard").distinct().collect()} == {8}
    assert abs(grown.count() / 20_000 - 1 / 9) < 0.02
    gone = sharding.moved(ids, even, [0.0, *even[1:]])
    assert {r[0] for r in gone.select("from_shard").distinct().collect()} == {0}


def test_a_row_repeated_over_and_over_is_dealt_over_many_runs(spark, tmp_path):
    same = [(7, "the same text " * 20)] * 300 + [(None, "no id " * 10)] * 50 + [(i, f"text {i}") for i in range(50)]
    got = written(spark, tmp_path, frame(spark, same).repartition(5), [1.0, 1.0], part_bytes=8000)
    runs = spark.read.parquet(str(tmp_path / "shards" / "parts")).collect()
    assert got.count() == sum(r.n_rows for r in runs) == 400 and max(r.n_rows for r in runs) < 150
    for shard, slots in got.groupBy("shard").agg(F.sort_array(F.collect_list("slot"))).collect():
        assert slots == list(range(len(slots)))


def test_shard_edge_cases(spark, tmp_path):
    assert written(spark, tmp_path, empty(spark), [1.0, 1.0]).count() == 0
    for bad in ([], [0.0], [-1.0, 2.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.assign(empty(spark), bad)


# --- filter audit ---------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(rows, labels):
    first, table = {}, []
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        table.append((lang or "", fails, good, toxic))
    out = []
    for part in {t[0] for t in table}:
        mine = [t for t in table if t[0] == part]
        shapley = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                lost = [t for t in left if t[1][f]]
                left = [t for t in left if not t[1][f]]
                shapley[f] += len(lost)
                failing = sum(t[1][f] for t in mine)
                unique = sum(t[1][f] and sum(t[1].values()) == 1 for t in mine)
                counts = (len(left), len(lost), failing - len(lost), unique, sum(t[2] for t in lost), sum(t[3] for t in lost))
                steps.append((part, "".join(order), step, *counts, f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("bits", [16, 2])
def test_audit_matches_brute_force(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(filter_audit, "RANGE_BITS", bits)
    rng = random.Random(1)
    more = [(300 + i, prose(rng, 300).upper() if i % 2 else prose(rng, 210) + " #5 | 3", ["en", "de"][i % 3 % 2]) for i in range(8)]
    more += [(None, more[0][1], "en"), (None, more[0][1], "en"), (300, more[0][1], "fr"), (310, more[0][1], "en"), (310, more[0][1], "en")]
    table = [r if len(r) > 2 else (*r, "en") for r in rows] + more
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 320, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1), (6, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = frame(spark, table).repartition(3)
    got = filter_audit.audit_documents(docs.withColumn("part", F.lit(1)).withColumn("id", F.lit(2)), labels_of(spark, labels))
    assert sorted(rows_of(got)) == brute_audit(table, labels)


def test_merge_counts_every_cell():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 60)
        lists = [sorted(rng.sample(range(n), rng.randint(0, n) // rng.randint(1, 9))) for _ in range(rng.randint(0, 7))]
        want = Counter(sum(1 << k for k, ids in enumerate(lists) if i in ids) for i in range(n))
        want.pop(0, None)
        assert filter_audit.merge_sizes([np.array(ids, np.int64) for ids in lists]) == want


def test_gallop_finds_the_first_place():
    ids = np.array([1, 3, 3, 7, 20, 21, 50])
    for at in range(len(ids) + 1):
        for bound in range(60):
            assert filter_audit.gallop(ids, at, bound) == max(at, int(np.searchsorted(ids, bound)))


def test_audit_edge_cases(spark):
    no_labels = labels_of(spark, [])
    assert filter_audit.audit_documents(empty(spark), no_labels).count() == 0
    one = filter_audit.audit_documents(frame(spark, [(1, None, None)]), no_labels)
    assert sorted(rows_of(one)) == brute_audit([(1, None, None)], [])


# --- ranked search --------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute_search(rows, queries, top):
    table = [(r[0], Counter(terms_of(r[1]))) for r in rows]
    table = [t for t in table if t[1]]
    n_docs, n_terms = len(table), sum(sum(c.values()) for _, c in table)
    df = Counter(t for _, c in table for t in c)
    out = []
    for item_id, text in queries:
        scored = []
        for doc_id, c in table:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms_of(text))
                if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("short", "window", "block"), [(64, 6, 4 << 20), (2, 1, 3000), (0, 0, 20_000), (10**9, 3, 1)])
def test_search_matches_brute_force(spark, rows, monkeypatch, short, window, block, tmp_path):
    monkeypatch.setattr(ranked_search, "SHORT", short)
    monkeypatch.setattr(ranked_search, "WINDOW_BITS", window)
    table = [r[:2] for r in rows] + [(None, "bright river rare-word"), (5, "bright RIVER rare-word"), (5, "bright river rare-word")]
    queries = [(k, r[1]) for k, r in enumerate(rows[::9])]
    queries += [(1, "bright river"), (None, "rare word Straße ÉTÉ"), (3, None), (4, "--- ..."), (5, "nowhere7"), (6, "thing " * 50)]
    monkeypatch.setattr(ranked_search, "QUERIES", 4)
    items = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit(1))
    path = str(tmp_path / "index")
    ranked_search.write_index(clashing(frame(spark, table).repartition(3)), path, block)
    for top in (3, 50):
        got = ranked_search.search(ranked_search.read_index(spark, path), items, top)
        assert sorted(rows_of(got), key=str) == brute_search(table, queries, top)


def test_skipping_leaves_documents_out():
    """With a floor, documents under it are not looked at, and none that reaches it is lost."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(3, 9))) + (" rare" * (i % 97 == 0)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    made = ranked_search._block(batch)
    names = ("doc_ids", "lengths", "terms", "starts", "places", "counts")
    row = ranked_search._lists(made, 0, names)
    wanted = np.sort(row["terms"].view(np.uint64))
    block = ranked_search.Block(row, wanted, np.arange(1, len(wanted) + 1) * 100, 2000, made.column("n_terms")[0].as_py())
    lists = np.arange(len(wanted))
    docs, scores = block.best(lists, 1)
    assert len(docs) == 2000
    for floor in np.sort(scores)[[10, 1000, 1900, 1999]]:
        got = block.best(lists, int(floor))
        assert dict(zip(*got)) == {d: s for d, s in zip(docs, scores) if s >= floor}


def test_readers_of_the_index_decode_one_block_at_a_time(spark, tmp_path):
    """Spark decodes a whole row group at once: one of all blocks of a task grows with the part of the table it read."""
    table = [(i, prose(random.Random(i), 40) + f" only{i}") for i in range(30)]
    path = tmp_path / "index"
    ranked_search.write_index(frame(spark, table).coalesce(1), str(path), 1)
    files = [pq.read_metadata(f) for f in path.glob("*.parquet")]
    assert [f.row_group(k).num_rows for f in files for k in range(f.num_row_groups)] == [1] * 30
    queries = [(k, f"bright river only{k}") for k in range(5)]
    got = ranked_search.search(ranked_search.read_index(spark, str(path)), spark.createDataFrame(queries, "item_id long, text string"), 3)
    assert sorted(rows_of(got), key=str) == brute_search(table, queries, 3)


def test_search_edge_cases(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search_documents(empty(spark), items).count() == 0
    assert ranked_search.search_documents(frame(spark, [(1, "a b")]), items.limit(0)).count() == 0
    assert rows_of(ranked_search.search_documents(frame(spark, [(1, "a b"), (2, None)]), items)) == [(1, 1, 1, 287 * (10**9 // 3000))]
