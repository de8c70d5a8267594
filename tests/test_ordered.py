"""Ordered primitives against plain Python, with chunks small enough to cross borders."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafwise.functions.names import natural_key
from leafwise.operators import ordered
from tests.conftest import rows_of

pytestmark = pytest.mark.usefixtures("tiny_chunks")


def sequences(seed, volumes=3, longest=23):
    rng = random.Random(seed)
    return {v: [rng.choice([None, rng.randint(0, 9)]) for _ in range(rng.randint(1, longest))] for v in range(volumes)}


def table(spark, data):
    rows = [(v, i, x) for v, xs in data.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "v long, i long, x long").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_neighbours(spark, seed):
    data = sequences(seed)
    near = ordered.with_neighbours(table(spark, data), ["v"], "i", {"a": -1, "b": 1, "c": 2}, ["x"])
    got = {(r.v, r.i): tuple(None if s is None else s.x for s in (r.a, r.b, r.c)) for r in near.collect()}
    for v, xs in data.items():
        at = lambda i: xs[i] if 0 <= i < len(xs) else None  # noqa: E731, B023
        for i in range(len(xs)):
            assert got[v, i] == (at(i - 1), at(i + 1), at(i + 2))


@pytest.mark.parametrize("seed", range(3))
def test_running(spark, seed):
    data = sequences(seed)
    x = F.col("x")
    got = ordered.running(
        table(spark, data), ["v"], "i",
        sums={"s": F.coalesce(x, F.lit(0))}, before={"p": x}, after={"n": x}, totals={"t": F.lit(1)},
        later_sums={"ls": F.coalesce(x, F.lit(0))}, later_mins={"lm": x}, maxes={"m": x},
    )
    found = {(r.v, r.i): r for r in got.collect()}
    for v, xs in data.items():
        for i in range(len(xs)):
            seen = lambda part: [y for y in part if y is not None]
            r = found[v, i]
            early, late = seen(xs[:i]), seen(xs[i:])
            assert r.s == sum(seen(xs[: i + 1])) and r.t == len(xs)
            assert r.p == (early[-1] if early else None) and r.n == (late[0] if late else None)
            assert r.ls == sum(late) and r.lm == min(late, default=None)
            assert r.m == max(seen(xs[: i + 1]), default=None)


def test_number_rows_over_sparse_keys(spark):
    rng = random.Random(5)
    rows = [(v, k) for v in range(3) for k in rng.sample(range(-50, 500), 40)]
    got = ordered.number_rows(spark.createDataFrame(rows, "v long, k long"), ["v"], "k", "n", first=1)
    for v in range(3):
        keys = sorted(k for w, k in rows if w == v)
        assert {r.k: r.n for r in got.where(F.col("v") == v).collect()} == {k: i + 1 for i, k in enumerate(keys)}


@pytest.mark.parametrize("buckets", [2, 256])
def test_ranked_with_ties_in_the_first_key(spark, monkeypatch, buckets):
    monkeypatch.setattr(ordered, "BUCKETS", buckets)
    rng = random.Random(7)
    rows = [(v, rng.choice([0.0, 0.5, 1.0, None]), u) for v, n in ((1, 60), (2, 9)) for u in range(n)]
    df = spark.createDataFrame(rows, "v long, s double, u long")
    got = ordered.ranked_with_next(df, ["v"], [*ordered.falling("s"), "u"], "r", {"nxt": "s"}).collect()
    for v in (1, 2):
        want = sorted((r for r in rows if r[0] == v), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        mine = sorted((r for r in got if r.v == v), key=lambda r: r.r)
        assert [(r.v, r.s, r.u) for r in mine] == want
        assert [r.r for r in mine] == list(range(1, len(want) + 1))
        assert [r.nxt for r in mine] == [w[1] for w in want[1:]] + [None]


def test_a_hot_group_is_numbered_in_many_tasks(spark):
    """Sparse keys of one group fall into many buckets; every bucket is a small share."""
    rng = random.Random(9)
    keys = rng.sample(range(10**15), 2000)
    df = spark.createDataFrame([(1, k) for k in keys], "v long, k long")
    sizes = [r["count"] for r in ordered.bucketed(df, ["v", "k"]).groupBy("_bucket").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 100
    got = {r.k: r.n for r in ordered.number_rows(df, ["v"], "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_names_of_one_series_are_sorted_in_many_tasks(spark):
    """The order of names that begin alike is decided by their ends; buckets follow the whole key."""
    numbers = random.Random(3).sample(range(10**6), 3000)
    names = spark.createDataFrame([(1, f"My Series Vol.{n}") for n in numbers], "series_id long, name string")
    order = ["series_id", natural_key(F.col("name"))]
    sizes = [r["count"] for r in ordered.bucketed(names, order).groupBy("_bucket").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 100
    got = {r.name: r.n for r in ordered.ranked(names, ["series_id"], order[1:], "n").collect()}
    assert got == {f"My Series Vol.{n}": i for i, n in enumerate(sorted(numbers), 1)}


def test_ranks_of_an_empty_table_and_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2.0, "b"), (1, None, "b"), (1, 3.0, None)], "v long, s double, n string")
    assert ordered.ranked(df.limit(0), ["v"], ["s", "n"], "r").count() == 0
    up = {(r.s, r.n): r.r for r in ordered.ranked(df, ["v"], ["s", "n"], "r").collect()}
    assert up == {(None, "a"): 1, (None, "b"): 2, (2.0, "b"): 3, (3.0, None): 4}
    down = {(r.s, r.n): r.r for r in ordered.ranked(df, ["v"], [*ordered.falling("s"), "n"], "r").collect()}
    assert down == {(3.0, None): 1, (2.0, "b"): 2, (None, "a"): 3, (None, "b"): 4}


@pytest.mark.parametrize("buckets", [2, 256])
def test_median(spark, monkeypatch, buckets):
    """All sizes, a narrow distribution, and a group without any value beside the others."""
    monkeypatch.setattr(ordered, "BUCKETS", buckets)
    rng = random.Random(11)
    data = {v: [round(rng.random(), rng.choice([1, 6])) for _ in range(n)] for v, n in ((1, 1), (2, 40), (3, 41))}
    data[5] = [1e-9 * rng.random() for _ in range(99)]
    rows = [(v, x) for v, xs in data.items() for x in xs] + [(4, None), (4, None), (3, None)]
    got = dict(rows_of(ordered.group_median(spark.createDataFrame(rows, "v long, x double"), ["v"], "x", "m")))
    assert got[4] is None and len(got) == 5
    for v, xs in data.items():
        assert got[v] == pytest.approx(statistics.median(xs), abs=1e-15)


def test_no_window_over_a_whole_sequence(spark):
    """A neighbour lookup needs one exchange, and its key holds the chunk."""
    df = spark.range(100).select(F.lit(1).alias("v"), F.col("id").alias("i"), F.col("id").alias("x"))
    plan = ordered.with_neighbours(df, ["v"], "i", {"b": 1}, ["x"])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "_chunk" in exchanges[0]


def test_only_groups_with_a_bound_inside_are_counted(spark):
    """Thousands of small groups and a large one: offsets are kept for the groups of bounds, numbers are dense in all."""
    small = spark.range(6000).select((F.col("id") % 2000).alias("g"), "id")
    rows = small.unionByName(spark.range(6000, 12000).select(F.lit(-1).cast("long").alias("g"), "id"))
    rows = rows.unionByName(spark.range(3).select(F.lit(None).cast("long").alias("g"), "id"))
    keyed, cuts = ordered._keyed(rows, ["g", "id"])
    groups = ordered.split_groups(cuts, ["g"])
    assert 0 < groups.count() < 256 and groups.where("g = -1").count() == 1
    got = ordered.ranked(rows, ["g"], ["id"], "n")
    want = got.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert got.count() == 12000 and want.where("n <> w").count() == 0


def test_running_values_carry_only_between_chunks(spark, tiny_chunks):
    rows = [(g, p, p + g) for g in range(30) for p in range(3)] + [(99, p, p) for p in range(11)] + [(None, 0, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "g long, p long, v long")
    out = ordered.running(df, ["g"], "p", sums={"s": F.col("v")}, totals={"t": F.col("v")}, later_mins={"m": F.col("v")})
    assert "LeftOuter" in out._jdf.queryExecution().toString()
    for r in out.collect():
        same = sorted(x[2] for x in rows if x[0] == r.g and x[1] is not None)
        assert (r.s, r.t, r.m) == (sum(v for v in same if v <= r.v), sum(same), r.v)
    assert out.count() == 101
