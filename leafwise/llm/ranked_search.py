"""Ranked lexical search: short lists summed into accumulators, long lists skipped document by document.

``write_index`` keeps an inverted index as a table with one row for each block of documents; a block holds
the postings of all its terms. ``search`` ranks all blocks for a set of queries: inside a block the short lists of a query
are materialised term at a time as summed accumulators, which then act as one iterator with a bound beside the
long lists. Documents are looked at in windows of ascending places; windows and documents whose bounds stay under the
query's 50th best score so far are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwise.llm.store import shared_path, stored
from leafwise.llm.words import slices, words_of

BLOCK_BYTES = 4 << 20  # text in one block of the index
WINDOW_BITS = 6  # log2 of the documents that share a bound
SHORT = 64  # lists up to this length are summed up front
QUERY_TERMS = 250_000  # terms of the queries searched together: 2 MB of hashes
QUERIES = 4096  # queries searched together
TOP = 50
INDEX = "doc_ids array<long>, lengths array<int>, terms array<long>, starts array<int>, places array<int>, counts array<int>, n_docs long, n_terms long"


@lru_cache(1)
def term_bytes() -> np.ndarray:
    """Which bytes belong to terms: digits, ASCII letters and all bytes of other characters."""
    solid = np.ones(256, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        solid[low : high + 1] = False
    return solid


# --- index ----------------------------------------------------------------------------------------


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = words_of(batch.column("text"), lower=True, solid=term_bytes())
    doc = words.docs()
    order = np.lexsort((doc, words.hashes))
    h, d = words.hashes[order], doc[order]
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    counts, h, d = np.diff(at), h[at[:-1]], d[at[:-1]]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    starts = np.append(np.flatnonzero(first), len(h))
    ids = batch.column("doc_id").cast(pa.int64())
    lists = [ids, words.counts, h[first].view(np.int64), starts, d, counts]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    columns = []
    for values, kind in zip(lists, types, strict=True):
        flat = values if isinstance(values, pa.Array) else pa.array(values.astype(kind.to_pandas_dtype()))
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
    columns += [pa.array([int((words.counts > 0).sum())], pa.int64()), pa.array([len(words.hashes)], pa.int64())]
    names = [f.split()[0] for f in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays(columns, names)


def write_index(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the inverted index of ``docs`` (``doc_id, text``): postings stay in the block of their documents, nothing is shuffled.

    Terms are known by 64-bit hashes. A null text has no terms; rows count one by one, also with equal or null
    ids; other columns are ignored; an empty table gives an empty index. Blocks take whole texts. Every block is a Parquet
    row group of its own, because Spark's reader decodes the rows of a group (up to 4,096) at once: a task that writes
    or reads the index decodes one block at a time, however large its part of the table is.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=block_bytes):
                yield _block(rows)

    docs.select("doc_id", "text").mapInArrow(build, INDEX).write.option("parquet.block.row.count.limit", 1).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


# --- search ---------------------------------------------------------------------------------------


class Block:
    """The postings of the wanted terms in one block of the index, as contributions to scores.

    ``lists`` of a term are the places ``docs[a:b]``, ascending, and what the term adds to each; ``tops`` is the largest
    of them, ``window_tops`` the largest in each window.
    """

    def __init__(self, row: dict, wanted: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(row["doc_ids"])
        lengths, starts = row["lengths"].astype(np.int64), row["starts"]
        terms = row["terms"].view(np.uint64)
        at = np.searchsorted(terms, wanted)
        at[at == len(terms)] = 0
        here = (terms[at] == wanted) if len(terms) else np.zeros(len(wanted), bool)
        self.found = np.flatnonzero(here & (weights > 0))  # which of the wanted terms stand here
        low, high = starts[at[self.found]].astype(np.int64), starts[at[self.found] + 1].astype(np.int64)
        sizes = high - low
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(low - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])
        self.docs, tf = row["places"][take].astype(np.int64), row["counts"][take].astype(np.int64)
        m = 100 - 50 + (50 * lengths * n_docs) // n_terms if n_terms else lengths
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.docs])
        self.adds = np.repeat(weights[self.found], sizes) * impact
        self.windows = (self.size >> WINDOW_BITS) + 1
        self.window_tops = np.zeros((len(self.found), self.windows), np.int64)
        if len(self.found):
            cell = np.repeat(np.arange(len(self.found)) * self.windows, sizes) + (self.docs >> WINDOW_BITS)
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            self.window_tops.reshape(-1)[cell[cuts]] = np.maximum.reduceat(self.adds, cuts)
        self.tops = self.window_tops.max(axis=1) if len(self.found) else np.zeros(0, np.int64)

    def list_of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[k], self.bounds[k + 1]
        return self.docs[a:b], self.adds[a:b]

    def accumulators(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the places in any of ``lists`` and the sums of what these add."""
        if len(lists) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = self.bounds[lists + 1] - self.bounds[lists]
        ends = np.cumsum(sizes)
        take = np.repeat(self.bounds[lists] - (ends - sizes), sizes) + np.arange(ends[-1])
        docs, adds = self.docs[take], self.adds[take]
        order = np.argsort(docs, kind="stable")
        docs, adds = docs[order], adds[order]
        cuts = np.flatnonzero(np.diff(docs, prepend=-1))
        return docs[cuts], np.add.reduceat(adds, cuts)

    def best(self, lists: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that reach ``floor`` (at least 1) over ``lists``; others are skipped.

        The accumulators of the short lists and each long list are iterators with a bound. Those whose bounds together
        stay under the floor give no candidates; candidates of the others look them up, largest bound first,
        and fall out when what is left cannot lift them to the floor.
        """
        sizes = self.bounds[lists + 1] - self.bounds[lists]
        short, long = lists[sizes <= SHORT], lists[sizes > SHORT]
        summed = self.accumulators(short)
        windows = self.window_tops[long].sum(axis=0)
        iterators = [(int(self.tops[k]), *self.list_of(k)) for k in long]
        if len(summed[0]):
            iterators.append((int(summed[1].max()), *summed))
            at = summed[0] >> WINDOW_BITS
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            windows[at[cuts]] += np.maximum.reduceat(summed[1], cuts)
        live = windows >= floor
        if not live.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        iterators.sort(key=lambda x: x[0])
        under = np.cumsum([x[0] for x in iterators])
        idle = int(np.searchsorted(under, floor))  # so many iterators cannot reach the floor without another one
        scores = np.zeros(self.size, np.int64)
        seen = np.zeros(self.size, bool)
        for _, docs, adds in iterators[idle:]:
            scores[docs] += adds
            seen[docs] = True
        docs = np.flatnonzero(seen)
        docs = docs[live[docs >> WINDOW_BITS]]
        for k in range(idle - 1, -1, -1):
            docs = docs[scores[docs] + under[k] >= floor]
            if len(docs) == 0:
                break
            _, places, adds = iterators[k]
            at = np.searchsorted(places, docs)
            at[at == len(places)] = 0
            hit = places[at] == docs
            scores[docs[hit]] += adds[at[hit]]
        docs = docs[scores[docs] >= floor]
        return docs, scores[docs]


class Ranking:
    """The best rows of one query so far: highest score first, equal scores by smaller id, null ids last."""

    __slots__ = ("scores", "ids", "unnamed", "top")

    def __init__(self, top: int):
        self.top = top
        self.scores = self.ids = np.zeros(0, np.int64)
        self.unnamed = np.zeros(0, bool)

    @property
    def floor(self) -> int:
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        unnamed = np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((ids, unnamed, -scores))[: self.top]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


def _lists(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> dict:
    return {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names}


def _query_terms(queries: DataFrame) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for rows in slices(batch):
                words = words_of(rows.column("text"), lower=True, solid=term_bytes())
                terms = [np.unique(words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                ends = np.cumsum([0] + [len(t) for t in terms]).astype(np.int32)
                flat = np.concatenate([*terms, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["item_id", "terms"])

    return queries.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, terms array<long>")


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Queries as (ids, term hashes), in blocks of bounded size."""
    ids: list = []
    terms: list[np.ndarray] = []
    size = 0
    for item_id, hashes in _query_terms(queries).toLocalIterator():
        if ids and (len(ids) == QUERIES or size + len(hashes) > QUERY_TERMS):
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(item_id)
        terms.append(np.array(hashes, np.int64).view(np.uint64))
        size += len(hashes)
    if ids:
        yield ids, terms


def _frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each wanted term stands; sums are taken ahead of the shuffle."""

    def count(batches):
        totals = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = _lists(batch, i, ("terms", "starts"))
                _, at, there = np.intersect1d(wanted, row["terms"].view(np.uint64), assume_unique=True, return_indices=True)
                totals[at] += np.diff(row["starts"])[there]
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["term", "df"])

    counted = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(wanted), np.int64)
    for term, df in counted.collect():  # at most one row for each term of the query block
        out[term] = df
    return out


def _search_block(index: DataFrame, n_docs: int, n_terms: int, ids: list, terms: list[np.ndarray], top: int) -> DataFrame:
    wanted = np.unique(np.concatenate(terms))
    frequencies = _frequencies(index, wanted)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) if f else 0 for f in frequencies], np.int64)
    places = [np.searchsorted(wanted, t) for t in terms]
    schema = "query int, item_id long, doc_id long, score long"
    names = tuple(f.split()[0] for f in INDEX.split(", "))[1:6]

    def rank(batches):
        rankings = [Ranking(top) for _ in ids]
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[i].values
                unnamed = doc_ids.is_null().to_numpy(zero_copy_only=False)
                doc_ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
                block = Block({"doc_ids": doc_ids, **_lists(batch, i, names)}, wanted, weights, n_docs, n_terms)
                slot = np.full(len(wanted), -1)
                slot[block.found] = np.arange(len(block.found))
                for mine, ranking in zip(places, rankings, strict=True):
                    lists = slot[mine]
                    docs, scores = block.best(lists[lists >= 0], ranking.floor)
                    if len(docs):
                        ranking.add(scores, doc_ids[docs], unnamed[docs])
        n = [len(r.scores) for r in rankings]
        columns = [
            pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), n)),
            pa.array([x for x, k in zip(ids, n, strict=True) for _ in range(k)], pa.int64()),
            pa.array(np.concatenate([r.ids for r in rankings]), mask=np.concatenate([r.unnamed for r in rankings])),
            pa.array(np.concatenate([r.scores for r in rankings])),
        ]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    found = index.select("doc_ids", *names).mapInArrow(rank, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every query: ``item_id, rank, doc_id, score``.

    ``queries`` holds ``item_id, text``; rows with equal or null ids are queries of their own, those without a
    term that stands in a document give no rows. Only scores above 0 count; equal scores go by smaller ``doc_id``, null
    ids last. Queries are searched in blocks of bounded size, each over the whole index; a task sends at most ``top`` rows a
    query. An empty index or query table gives no rows; other columns are ignored.
    """
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    spark = index.sparkSession
    found = [
        _search_block(index, n_docs, n_terms, ids, terms, top)
        for ids, terms in _query_blocks(queries)
        if n_terms and any(len(t) for t in terms)
    ]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if len(found) > 1:
        found = [stored(f, "ranked", keep=True) for f in found]
    return reduce(DataFrame.unionByName, found)


def search_documents(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """``search`` over an index of ``docs`` written to the shared folder."""
    spark = docs.sparkSession
    path = shared_path(spark, "lexical-index")
    write_index(docs, path)
    return search(read_index(spark, path), queries, top)


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH word_ AS (SELECT rid, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term
               FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
  doc_ AS (SELECT rid, doc_id, count(*) AS n FROM word_ GROUP BY rid, doc_id),
  all_ AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc_),
  tf_ AS (SELECT rid, term, count(*) AS tf FROM word_ GROUP BY rid, term),
  weight_ AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
              FROM (SELECT term, count(*) AS df FROM tf_ GROUP BY term), all_),
  query_ AS (SELECT DISTINCT qid, item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERM}')) AS term
             FROM (SELECT row_number() OVER () AS qid, item_id, text FROM benchmark)),
  score_ AS (SELECT qid, item_id, rid, d.doc_id,
      sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM query_ JOIN tf_ USING (term) JOIN weight_ USING (term) JOIN doc_ d USING (rid), all_
    GROUP BY qid, item_id, rid, d.doc_id),
  rank_ AS (SELECT item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
            FROM score_ WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM rank_ WHERE rank <= {TOP}"""
