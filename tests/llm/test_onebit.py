import numpy as np
import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from leafwise.llm import onebit

DDL = "vec_id long, embedding array<float>"


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in asked:
        if q in good:
            v = good[q]
            near = [(-float(v @ w / np.sqrt((v @ v) * (w @ w))), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = sorted(near)[:k]
    return out


def check(spark, rows, asked, k=5, recall=1.0):
    df = spark.createDataFrame(rows, DDL)
    got = {}
    for q, rank, i, score in rows_of(onebit.search(df, F.col("vec_id").isin(list(asked)), k=k)):
        got.setdefault(q, {})[rank] = (i, score)
    want = brute(rows, asked, k)
    assert {q for q in want if want[q]} == set(got)
    hits = total = 0
    for q, near in want.items():
        assert sorted(got.get(q, {})) == list(range(1, len(near) + 1))
        hits += len({i for i, _ in got.get(q, {}).values()} & {i for _, i in near})
        total += len(near)
        scores = [got[q][r][1] for r in sorted(got.get(q, {}))]
        assert scores == sorted(scores, reverse=True)
    assert hits >= recall * total
    return got, want


@pytest.mark.parametrize("dim", [8, 33])
def test_recall_and_scores(spark, monkeypatch, dim):
    monkeypatch.setattr(onebit, "QUERY_BLOCK", 16)
    monkeypatch.setattr(onebit, "CODE_BLOCK", 200)
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(900)]
    got, want = check(spark, rows, range(0, 900, 25), recall=0.97)
    for q, near in want.items():
        exact = {i: -c for c, i in near}
        for i, score in got[q].values():
            if i in exact:
                assert score == pytest.approx(exact[i], abs=1e-12)


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, base) for i in range(40)] + [(100 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6)]
    rows += [(205, [1.0, 2.0]), (206, [2.0, 1.0]), (None, base), (300, [])]
    asked = [0, 3, 39, 100, 110, 200, 201, 205]
    got, want = check(spark, rows, asked)
    for q in (0, 3, 39, 205):
        assert [got[q][r][0] for r in sorted(got[q])] == [i for _, i in want[q]]
    assert check(spark, rows + rows[:50], asked)[0] == got


def test_fewer_candidates_than_asked_for(spark):
    check(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], [1, 2])
    assert onebit.search(spark.createDataFrame([(1, [1.0, 2.0])], DDL), F.col("vec_id") == 1).count() == 0
    empty = spark.createDataFrame([], DDL)
    assert onebit.search(empty, F.col("vec_id") == 1).count() == 0


def test_intervals_hold_the_truth():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    codes, own = onebit.encode(v, 11)
    queries = v[:40] @ onebit.rotation(24, 11)
    found, width = onebit.estimate(codes, own, queries)
    off = np.abs(found - v @ v[:40].T)
    assert (off <= width[:, None]).mean() > 0.985 and off.mean() < 0.08
