"""How filters interact: what each one removes in every order of applying them, from sorted posting lists.

For every part and filter the ids of failing rows are kept as sorted lists, cut by ranges of ids. One galloping
k-way merge over the lists of a range counts, for every set of lists, the ids that stand in exactly these.
Summed over the ranges these counts give the size of every union and difference of the lists, so that no order
of the filters needs another pass and no list is ever held whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.store import scratch, stored
from leafwise.llm.words import slices, text_buffer, words_of

RANGE_BITS = 16  # log2 of the ids in one range
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of words
MAX_CAPITALS = 3  # per cent of code points
MARKS = "#$%&*|"
LETTERS = "ABCDE"
LISTS = (*LETTERS, "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


# --- failing conditions ---------------------------------------------------------------------------


def text_failures(texts: pa.Array) -> np.ndarray:
    """One bit for each of A to D, from the lowest, for every text of a batch; null counts as empty."""
    words, (data, offsets) = words_of(texts), text_buffer(texts)
    doc, n = words.docs(), words.counts
    by_hash = np.lexsort((words.hashes, doc))
    h, d = words.hashes[by_hash], doc[by_hash]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(n))

    def chars(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(hit), offsets))

    marks = np.zeros(256, bool)
    marks[list(MARKS.encode())] = True
    capitals, points = chars((data >= 65) & (data <= 90)), chars((data & 0xC0) != 0x80)
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * points, chars(marks[data]) > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, fails`` of every row: the text is read once and goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("digest"), "text")

    def judge(batches):
        for batch in batches:
            for rows_ in slices(batch):
                fails = pa.array(text_failures(rows_.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [rows_.column("doc_id"), rows_.column("part"), rows_.column("digest"), fails], ["doc_id", "part", "digest", "fails"]
                )

    return rows.mapInArrow(judge, "doc_id long, part string, digest binary, fails long")


def _later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text stands under a smaller ``doc_id`` as well; a null ``doc_id`` is neither smaller nor larger.

    Equal texts are found by a 128-bit digest. The join meets only texts of several rows; grouping by two keys
    leaves it an exchange of its own, which adaptive execution splits for a text with many copies.
    """
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    groups = groups.groupBy("digest", "first").agg(F.max("last").alias("last")).select("digest", "first")
    return rows.join(groups, "digest").filter(F.col("doc_id") > F.col("first"))


# --- posting lists --------------------------------------------------------------------------------


def posting_lists(rows: DataFrame, lists: Mapping[str, DataFrame]) -> DataFrame:
    """``part, range, n, lists``: the rows of every range of ids and, by name, the sorted ids of each list.

    ``rows`` holds ``id`` and ``part``; each list holds ``id, part`` of its members, each id once. A range spans
    2^16 ids, so a list of a range is bounded whatever share of the rows a part holds.
    """

    def cut(df: DataFrame) -> DataFrame:
        return df.select("part", F.shiftright("id", RANGE_BITS).alias("range"), "id")

    sizes = cut(rows).groupBy("part", "range").agg(F.count("*").alias("n"))
    postings = None
    for name, members in lists.items():
        one = cut(members).groupBy("part", "range").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        one = one.select("part", "range", F.lit(name).alias("name"), "ids")
        postings = one if postings is None else postings.unionByName(one)
    by_name = postings.groupBy("part", "range").agg(F.map_from_entries(F.collect_list(F.struct("name", "ids"))).alias("by_name"))
    named = F.struct(*[F.coalesce(F.try_element_at("by_name", F.lit(n)), F.array().cast("array<bigint>")).alias(n) for n in lists])
    return sizes.join(by_name, ["part", "range"], "left").select("part", "range", "n", named.alias("lists"))


def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """The first place from ``at`` on whose id is not below ``bound``: doubling steps, then binary search."""
    step, low, n = 1, at, len(ids)
    while low + step < n and ids[low + step] < bound:
        low += step
        step *= 2
    return low + int(np.searchsorted(ids[low : low + step + 1], bound))


def merge_sizes(lists: Sequence[np.ndarray]) -> Counter:
    """How many ids stand in exactly which of the sorted ``lists``: one bit for each list, lists from the lowest.

    The list with the smallest head gallops to the next smallest head; what it passes is in it alone.
    An id at several heads is counted for all of them.
    """
    cells: Counter = Counter()
    at = [0] * len(lists)
    heads = {k: int(ids[0]) for k, ids in enumerate(lists) if len(ids)}

    def move(k: int, to: int) -> None:
        at[k] = to
        if to < len(lists[k]):
            heads[k] = int(lists[k][to])
        else:
            del heads[k]

    while heads:
        low = min(heads.values())
        first = [k for k, head in heads.items() if head == low]
        if len(first) > 1:
            cells[sum(1 << k for k in first)] += 1
            for k in first:
                move(k, at[k] + 1)
        elif len(heads) == 1:
            cells[1 << first[0]] += len(lists[first[0]]) - at[first[0]]
            break
        else:
            k = first[0]
            to = gallop(lists[k], at[k], min(head for j, head in heads.items() if j != k))
            cells[1 << k] += to - at[k]
            move(k, to)
    return cells


def cell_sizes(postings: DataFrame, names: Sequence[str]) -> DataFrame:
    """``part, cell, n``: ids of each part that stand in exactly the lists whose bits ``cell`` has (0: in none)."""

    def merge(batches):
        for batch in batches:
            part, n, lists = batch.column("part"), batch.column("n").to_pylist(), batch.column("lists").flatten()
            for i in range(batch.num_rows):
                cells = merge_sizes([ids[i].values.to_numpy(zero_copy_only=False) for ids in lists])
                cells[0] = n[i] - sum(cells.values())
                out = [pa.array([part[i].as_py()] * len(cells)), pa.array(list(cells)), pa.array(list(cells.values()))]
                yield pa.RecordBatch.from_arrays(
                    [out[0].cast(pa.string()), out[1].cast(pa.int32()), out[2].cast(pa.int64())], ["part", "cell", "n"]
                )

    rows = postings.select("part", "n", F.struct(*[F.col("lists").getField(n).alias(n) for n in names]).alias("lists"))
    merged = rows.mapInArrow(merge, "part string, cell int, n long")
    return merged.groupBy("part", "cell").agg(F.sum("n").alias("n"))


# --- orders ---------------------------------------------------------------------------------------


def interaction(cells: Mapping[int, int], letters: str, good: int, toxic: int) -> pd.DataFrame:
    """One row for every order of the filters and step, from the cell sizes of one part.

    ``good`` and ``toxic`` are the bits of these lists. A set of filters removes the union of its lists; a step removes
    the difference that its filter adds to the union of those before it.
    """
    k = len(letters)
    total = sum(cells.values())

    def union(members: int, also: int = 0) -> int:
        return sum(n for cell, n in cells.items() if cell & members and cell & also == also)

    sizes = {also: [union(m, also) for m in range(1 << k)] for also in (0, 1 << good, 1 << toxic)}
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            now = before | 1 << f
            removed, good_lost, toxic_lost = (s[now] - s[before] for s in sizes.values())
            unique = sizes[0][-1] - sizes[0][(1 << k) - 1 - (1 << f)]
            name = "".join(letters[i] for i in order)
            steps.append((name, step, total - sizes[0][now], removed, sizes[0][1 << f] - removed, unique, good_lost, toxic_lost, letters[f]))
            before = now
    columns = ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "filter")
    out = pd.DataFrame(steps, columns=columns)
    out["shapley"] = out.groupby("filter")["removed"].transform("sum")
    return out


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The report over all orders: a part has at most 2^(filters + 2) cells, whatever its size."""
    k = len(letters)

    def report(group: pd.DataFrame) -> pd.DataFrame:
        out = interaction(dict(zip(group["cell"], group["n"], strict=True)), letters, k, k + 1)
        out.insert(0, "part", group["part"].iloc[0])
        return out[["part", "filter_order", "step", *COUNTS]]

    return cells.groupBy("part").applyInPandas(report, REPORT)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over ``docs`` by ``lang``, with losses of rows that ``labels`` calls good (quality 1) or toxic.

    A null text is empty, a null ``lang`` is the part of the empty string. Rows are counted one by one, so repeated rows
    and ids count as often as they stand; a null ``doc_id`` has no smaller one and no labels. A row is good if any
    label of its id says so. Columns beyond those used are ignored, an empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        # Ids are row numbers of this stored table: a lost executor reads the same ones again.
        rows = stored(_judged(docs).withColumn("id", F.monotonically_increasing_id()), "judged")
        lists = {name: rows.filter(F.col("fails").bitwiseAND(1 << i) != 0) for i, name in enumerate("ABCD")}
        lists["E"] = _later_copies(rows)
        for name, said in (("good", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)):
            # Two keys, for the reason given at ``_later_copies``.
            labelled = labels.filter(said).groupBy("doc_id", "quality", "toxic").agg(F.lit(1)).groupBy("doc_id", F.lit(name)).agg(F.lit(1))
            lists[name] = rows.join(labelled.select("doc_id"), "doc_id")
        return audit(stored(cell_sizes(posting_lists(rows, lists), LISTS), "cells", keep=True))


def _sql_perms() -> str:
    names = list(LETTERS)
    froms = ", ".join(f"letter_ a{i}" for i in range(5))
    differ = " AND ".join(f"a{i}.l <> a{j}.l" for i in range(5) for j in range(i))
    return f"""letter_ AS (SELECT unnest({names}) AS l, unnest(range(5)) AS b),
  perm_ AS (SELECT {" || ".join(f"a{i}.l" for i in range(5))} AS filter_order, [{", ".join(f"a{i}.b" for i in range(5))}] AS bs
            FROM {froms} WHERE {differ}),
  step_ AS (SELECT filter_order, s::INT AS step, bs[s] AS f, list_sum(list_transform(bs[1:s - 1], lambda b: 1 << b)) AS before
            FROM perm_, range(1, 6) r(s))"""


SQL = f"""
WITH {_sql_perms()},
  text_ AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
              regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
              min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
  row_ AS (SELECT part,
      (len(ws) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {MIN_DISTINCT} * len(ws))::INT
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS fails,
      (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)) IS TRUE AS good,
      (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)) IS TRUE AS toxic FROM text_),
  cell_ AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM row_ GROUP BY ALL),
  done_ AS (SELECT part, filter_order, step, f,
      coalesce(sum(n) FILTER (fails & (coalesce(before, 0) | (1 << f)) = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0) <> 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (fails = 1 << f), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (fails & (1 << f) <> 0 AND fails & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
    FROM cell_, step_ GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM done_"""
