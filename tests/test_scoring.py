"""Context, reliability and clusters against small Python models."""

import random

import pytest

from leafwise.functions.scores import FEATURES, score_pairs
from leafwise.operators import adjust, pairs, select
from tests.conftest import rows_of


def clamp(x):
    return min(1.0, max(0.0, x))


def scores(spark, spans, extra=()):
    """(start, spread, review) triples as scored pairs with harmless features."""
    rows = [(1, f"p-{s:03d}", f"p-{s + 1:03d}", v, r) for s, v, r in spans] + list(extra)
    df = spark.createDataFrame(rows, "volume_id long, right_name string, left_name string, spread double, review_score double")
    for name in FEATURES:
        df = df.selectExpr("*", f"double({0.5 if name not in ('barrier', 'panel') else 0.1}) as {name}")
    return df


def context(spans):
    out = {}
    for s, v, r in spans:
        rivals = [w for t, w, _ in spans if t != s and abs(t - s) <= 1]
        if not rivals:
            out[s] = (v, r, 0.0)
            continue
        margin = v - max(rivals)
        ties = sum(w >= v - 0.05 for w in rivals)
        loss = clamp(clamp((0.04 - margin) / 0.12) * 0.10 + clamp((ties - 1) / 3) * 0.04)
        peak = clamp((margin - 0.12) / 0.10) * 0.015
        out[s] = (clamp(v * (1 - loss) + peak), clamp(r * (1 - loss * 0.72) + peak), margin)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.usefixtures("tiny_chunks")
def test_contextual_adjustment(spark, seed):
    rng = random.Random(seed)
    spans = [(s, rng.random(), rng.random()) for s in range(1, 40) if rng.random() < 0.8]
    lone = (1, "cover", "p-003", 0.4, 0.3)
    got = {r.right_name: r for r in adjust.contextual_adjustment(scores(spark, spans, [lone])).collect()}
    assert (got["cover"].spread, got["cover"].local_margin) == (0.4, 0.0)
    for s, (spread, review, margin) in context(spans).items():
        row = got[f"p-{s:03d}"]
        assert (row.spread, row.review_score, row.local_margin) == pytest.approx((spread, review, margin))


def test_stability(spark):
    rows = [(1, "a", "b", s) for s in (0.6, 0.5, 0.55)] + [(1, "c", "d", 0.7)]
    df = spark.createDataFrame(rows, "volume_id long, right_name string, left_name string, spread double")
    got = {r.right_name: r.stability for r in adjust.stability_from_probes(df).collect()}
    std = (((0.05**2) * 2) / 3) ** 0.5
    assert got["a"] == pytest.approx(clamp(1 - 0.1 / 0.35 - std / 0.22)) and got["c"] == 1.0


def test_pairs_without_probes_keep_their_score(spark):
    base = adjust.attach_raw_scores(scores(spark, [(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 0.5, 0.5)]))
    none = spark.createDataFrame([], "volume_id long, right_name string, left_name string, stability double")
    for row in adjust.reliability_adjustment(base, none).collect():
        assert row.spread == 0.5 and row.reliability_penalty == 0.0 and row.stability_score == 0.0


def cluster_model(starts):
    number, end, out = 0, None, {}
    for s in sorted(starts):
        if end is None or s > end:
            number, end = number + 1, s + 1
        end = max(end, s + 1)
        out[s] = number
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.usefixtures("tiny_chunks")
def test_clusters(spark, seed):
    rng = random.Random(seed)
    starts = sorted(rng.sample(range(1, 60), 30))
    items = select.candidate_items(scores(spark, [(s, 0.9, 0.9) for s in starts]), 0.53)
    assert {r.span_start: r.cluster for r in select.clusters(items).collect()} == cluster_model(starts)


@pytest.mark.usefixtures("tiny_chunks")
def test_selection_takes_one_clear_winner_per_cluster(spark):
    spans = [(1, 0.90, 0.9), (2, 0.70, 0.7), (5, 0.80, 0.8), (6, 0.79, 0.8), (9, 0.60, 0.6), (12, 0.4, 0.9)]
    ready = adjust.contextual_adjustment(scores(spark, spans)).drop("spread", "review_score")
    ready = ready.withColumnsRenamed({"raw_spread": "spread", "raw_review_score": "review_score"})
    chosen = select.select_non_overlapping(ready.selectExpr("* except (local_margin)", "double(0.1) as local_margin"))
    assert sorted(r.span_start for r in chosen.collect()) == [1, 9]
    table = select.cluster_table(ready.selectExpr("* except (local_margin)", "double(0.1) as local_margin"))
    assert {r.span_start: r.decision for r in table.collect() if r.rank_in_cluster == 1} == {
        1: "auto", 5: "review", 9: "auto",
    }


def test_decisions(spark):
    spans = [(1, 0.90, 0.9), (4, 0.55, 0.5), (7, 0.54, 0.5), (10, 0.48, 0.1), (13, 0.1, 0.5), (16, 0.05, 0.1)]
    ready = scores(spark, spans).selectExpr("*", "double(0.2) as local_margin")
    got = {int(r.right_name[2:]): r.decision for r in select.review_decisions(ready).collect()}
    assert got == {1: "auto", 4: "review", 7: "review", 10: "borderline", 13: "borderline", 16: "reject"}


def test_mutual_best_is_one_to_one(spark):
    rows = [(1, "a", "x", 0.9, 0.0), (1, "a", "y", 0.8, 0.0), (1, "b", "x", 0.85, 0.0), (1, "b", "y", 0.7, 0.0)]
    df = spark.createDataFrame(rows, "volume_id long, right_name string, left_name string, spread double, review_score double")
    assert [(r.right_name, r.left_name) for r in select.mutual_best_pairs(df).collect()] == [("a", "x")]


def test_offsets_need_an_overlap(spark):
    df = spark.createDataFrame([(1, "a", "b", 30, 40)], "volume_id long, right_name string, left_name string, right_height int, left_height int")
    got = sorted(r.offset for r in pairs.offset_candidates(df).collect())
    assert got == [o for o in range(-18, 19) if min(40 - max(0, o), 30 - max(0, -o)) > 24]


def test_flat_features_give_bounded_scores(spark):
    ones = spark.range(1).selectExpr(*[f"double(1) as {n}" for n in FEATURES])
    zeros = spark.range(1).selectExpr(*[f"double(0) as {n}" for n in FEATURES])
    for total, spread, review in rows_of(score_pairs(ones.union(zeros)).select("total", "spread", "review_score")):
        assert 0 <= total <= 1 and 0 <= spread <= 1 and 0 <= review <= 1
