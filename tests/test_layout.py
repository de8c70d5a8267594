"""Diagnosis and edits against a plain list model of a page order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafwise.functions.names import pair_id
from leafwise.operators import diagnose, presets
from leafwise.operators import spine as ops
from tests.conftest import rows_of

SPINE = "volume_id long, entry_index long, kind string, source_index long, item_id string, inserted_path string, width long, height long, ext string"


def page(n):
    return ("source", n, f"page-{n:04d}", None, 100 + n, 200 + n, "jpg")


def blank(w=None, h=None):
    return ("blank", None, None, None, w, h, None)


def table(spark, volumes):
    rows = [(v, i, *entry) for v, entries in volumes.items() for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, SPINE).repartition(3)


def entries(df):
    out = {}
    for r in df.select(*ops.SPINE_COLUMNS).orderBy("volume_id", "entry_index").collect():
        assert r.entry_index == len(out.setdefault(r.volume_id, []))
        out[r.volume_id].append(tuple(r)[2:])
    return out


def spreads(spark, pairs, volume=1):
    df = spark.createDataFrame([(volume, a, b) for a, b in pairs], "volume_id long, start_page long, end_page long")
    return df.withColumn("pair_id", pair_id(F.col("start_page"), F.col("end_page")))


def status(layout, a, b, gap):
    at = {e[1]: i for i, e in enumerate(layout) if e[0] != "blank"}
    if a not in at or b not in at:
        return "missing"
    preview = lambda i: i + 1 if gap and i >= 1 else i
    s, e = preview(at[a]), preview(at[b])
    return "intact" if s + 1 == e and s // 2 == e // 2 else "damaged"


@pytest.mark.parametrize(
    ("layout", "gap", "want"),
    [
        (list(range(1, 41)), False, "intact"),
        (list(range(1, 41)), True, "damaged"),
        (list(range(1, 37)) + [None] + list(range(37, 41)), False, "damaged"),
        ([n for n in range(1, 41) if n != 38], False, "missing"),
        (list(range(1, 37)) + [38, 37, 39, 40], False, "damaged"),
    ],
)
def test_damage_of_one_spread(spark, layout, gap, want):
    spine = table(spark, {1: [blank(1, 1) if n is None else page(n) for n in layout]})
    (row,) = diagnose.diagnose_damage(spine, spreads(spark, [(37, 38)]), gap).collect()
    assert row.status == want
    if want == "missing":
        assert row.reason == "Page 38 missing from current layout"


@pytest.mark.parametrize("gap", [False, True])
@pytest.mark.parametrize("seed", range(3))
@pytest.mark.usefixtures("tiny_chunks")
def test_what_if_equals_list_insertion(spark, seed, gap):
    rng = random.Random(seed)
    pages = [n for n in range(1, 30) if rng.random() < 0.9]
    layout = [page(n) for n in pages]
    for _ in range(4):
        layout.insert(rng.randint(0, len(layout)), blank(1, 1))
    confirmed = [(n, n + 1) for n in range(1, 29) if rng.random() < 0.3]
    gaps = [(n, n + 1, rng.random()) for n in range(1, 29)]
    candidates = spark.createDataFrame(
        [(1, f"{a:03d}-{b:03d}", a, b, s, "B low_content_pause") for a, b, s in gaps],
        "volume_id long, gap_id string, after_page long, before_page long, safe_insert_score double, label string",
    )
    spine, marked = table(spark, {1: layout}), spreads(spark, confirmed)
    points = diagnose.what_if_insert(spine, marked, candidates, gap)
    got = {r.gap_id: r for r in points.collect()}
    ranges = diagnose.repair_ranges(diagnose.diagnose_damage(spine, marked, gap), gap)
    fixes = {}
    for _, g, p in rows_of(diagnose.expand_fixes(points, ranges)):
        fixes.setdefault(g, set()).add(p)
    for r in diagnose.with_fixes(points, ranges).collect():
        assert r.fixes == sorted(fixes.get(r.gap_id, [])) and len(r.fixes) == r.fix_count
    at = {e[1]: i for i, e in enumerate(layout) if e[0] != "blank"}
    before = {c: status(layout, *c, gap) for c in confirmed}
    for a, b, _ in gaps:
        g = f"{a:03d}-{b:03d}"
        if a not in at or b not in at or at[b] != at[a] + 1:
            assert got[g].kind == "stale"
            continue
        changed = layout[: at[b]] + [blank()] + layout[at[b] :]
        after = {c: status(changed, *c, gap) for c in confirmed}
        broken = [c for c in confirmed if before[c] == "intact" and after[c] != "intact"]
        fixed = {f"{s:03d}-{e:03d}" for s, e in confirmed if before[s, e] == "damaged" and after[s, e] == "intact"}
        if (a, b) in confirmed or broken:
            assert got[g].kind == "protected" and got[g].insertion_index == at[b]
        elif fixed:
            assert got[g].kind == "suggested" and got[g].fix_count == len(fixed)
            assert got[g].first_fix == min(fixed) and fixes[g] == fixed
        else:
            assert g not in got


def reference_size(layout, index):
    for e in layout[max(0, index - 1) :: -1] if index else []:
        if e[0] != "blank":
            return e[4:6]
    for e in layout[index:]:
        if e[0] != "blank":
            return e[4:6]
    return (None, None)


@pytest.mark.usefixtures("tiny_chunks")
def test_blanks_take_the_size_of_the_nearest_page(spark):
    layout = [blank(9, 9), page(1), page(2), blank(8, 8), page(3)]
    points = [(1, 0, 1), (1, 2, 2), (1, 4, 3), (1, 4, 4), (1, 5, 5), (1, 6, 6)]
    df = spark.createDataFrame(points, "volume_id long, index long, seq long")
    spine = table(spark, {1: layout})
    got = entries(ops.insert_blanks(spine, df))[1]
    want = list(layout)
    for _, index, _ in reversed([p for p in points if p[1] <= len(layout)]):
        want.insert(index, blank(*reference_size(layout, index)))
    assert got == want
    errors = [r.error for r in ops.check_points(spine, df).collect() if r.error]
    assert errors == ["Blank insertion index out of range"]


@pytest.mark.usefixtures("tiny_chunks")
def test_blanks_of_a_template_equal_list_insertion(spark):
    """Volumes with pages, blanks and nothing left; positions before, inside and behind the entries, and null ones."""
    rng = random.Random(3)
    templates, volumes, chosen = {}, {}, []
    for key in range(6):
        positions = [rng.choice([None, -2, *range(14), 99]) for _ in range(rng.randint(0, 9))]
        templates[key] = {"version": 1, "deleted_source_pages": rng.sample(range(1, 9), 3), "blank_positions": positions}
    for v in range(25):
        volumes[v] = [page(n) if rng.random() < 0.7 else blank(n, n) for n in range(1, rng.randint(2, 18))]
        chosen.append((v, v % 6))
    texts = spark.createDataFrame([(k, json.dumps(t)) for k, t in templates.items()], "preset_id long, json string")
    targets = spark.createDataFrame(chosen[:-1], "volume_id long, preset_id long")
    got = entries(presets.apply_preset_v1(table(spark, volumes), targets, presets.parse_presets(texts)))
    for v, key in chosen[:-1]:
        layout = [e for e in volumes[v] if e[1] not in templates[key]["deleted_source_pages"]]
        for position in templates[key]["blank_positions"] if any(e[0] != "blank" for e in layout) else []:
            if position is not None:
                at = min(max(position, 0), len(layout))
                layout.insert(at, blank(*reference_size(layout, at)))
        assert got.get(v, []) == layout, v
    assert chosen[-1][0] not in got


def test_a_template_with_many_blanks():
    rng = random.Random(4)
    positions = [rng.randint(0, 30_000) for _ in range(10_000)]
    layout = [False] * 500
    for p in positions:
        layout.insert(min(p, len(layout)), True)
    assert presets.blank_slots(500, positions) == [i for i, new in enumerate(layout) if new]


@pytest.mark.usefixtures("tiny_chunks")
def test_delete_recover_and_move(spark):
    layout = [page(n) for n in range(1, 20)]
    spine = table(spark, {1: layout, 2: layout[:3]})
    ranges = spark.createDataFrame([(1, 2, 4), (1, 4, 9), (2, 1, 50), (2, 7, 8)], "volume_id long, start long, end long")
    kept, deleted = ops.delete_entries(spine, ranges)
    assert entries(kept) == {1: layout[:2] + layout[10:], 2: layout[:1]}
    assert entries(ops.recover_deleted(kept, deleted)) == {1: layout, 2: layout[:3]}
    moves = spark.createDataFrame([(1, 3, 15), (2, 2, 0)], "volume_id long, from_index long, to_index long")
    moved = entries(ops.move_entries(spine, moves))
    assert moved[1] == layout[:3] + layout[4:16] + [layout[3]] + layout[16:]
    assert moved[2] == [layout[2], layout[0], layout[1]]


def test_the_lowest_score_of_a_pair_stays(spark):
    rows = [(1, "001-002", 1, 2, s, 0.0, "auto") for s in (0.9, 0.2, 0.5)]
    df = spark.createDataFrame(rows, "volume_id long, pair_id string, start_page int, end_page int, score double, review_score double, decision string")
    assert [r.score for r in diagnose.load_candidates(df).collect()] == [0.2]
