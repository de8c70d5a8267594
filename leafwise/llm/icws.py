"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of its five-word shingles. Improved consistent weighted sampling draws ``BANDS * ROWS``
samples from it so that two documents agree in a sample with the probability of their weighted Jaccard
similarity. Documents that agree in all samples of a band meet in a bucket; pairs from buckets
are verified on their whole weighted sets, and classes are the components of the verified links.

Weights are term frequency x (1 + IDF_SHARE x idf), with idf from 0 to 1 by the logarithm of the document frequency. The
frequency comes from a count-min sketch over all documents: shingles are told from each other by their frequency
as soon as that is a noticeable share of the corpus. The share of idf is small on purpose: inside a
large group of copies the common shingles are frequent because of the group itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.store import scratch, stored
from leafwise.llm.words import Words, mix, slices, tidy, windows_of, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4  # a pair at 0.8 meets in some band with probability 0.9994
IDF_SHARE = 0.25
SKETCH_BITS, SKETCH_ROWS = 18, 2
PART_BITS = 12  # sketch cells merged by one task
PLAUSIBLE = 30  # equal samples of 56; a pair at 0.8 has fewer with a chance below 1e-5
SMALL = 16  # members of a bucket whose pairs are all tried at once
BLOCK = 1024  # bucket members compared at once
TRIES = 4  # most similar partners an unlinked member tries ahead of the last round
SMALL_SLICE = 1 << 19


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts: document, hash, count, in this order.

    A document of fewer words than a shingle is one shingle of all its words; without words it has none.
    """
    found, at = windows_of(words, SHINGLE)
    doc = np.searchsorted(words.bounds, at, "right") - 1
    sizes = words.counts
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        whole = np.uint64(sizes[i])
        for h in words.hashes[words.bounds[i] : words.bounds[i + 1]]:
            whole = mix(np.array([whole ^ h]))[0]
        found, doc = np.append(found, whole), np.append(doc, i)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], found[first], np.diff(np.append(first, len(found)))


def _cells(hashes: np.ndarray, row: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA24BAED4963EE407 * (row + 1) % (1 << 64))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Count-min sketch of how many documents hold each shingle: one row of cells for each hash."""
    inner = 1 << PART_BITS

    def count(batches):
        total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for rows in slices(batch):
                hashes = shingles(words_of(rows.column("text"), lower=True))[1]
                for row in range(SKETCH_ROWS):
                    total[row] += np.bincount(_cells(hashes, row), minlength=1 << SKETCH_BITS)
        if total.any():
            parts = total.reshape(-1, inner)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(range(len(parts)), pa.int32()),
                    "cells": pa.array([p.astype("<u4" if p.max() < 1 << 32 else "<u8").tobytes() for p in parts], pa.binary()),
                }
            )

    def add(batches):
        now, total = None, None
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = part, np.zeros(inner, np.int64)
                total += np.frombuffer(cells, f"<u{len(cells) // inner}").astype(np.int64)
        if now is not None:
            yield out(now, total)

    def out(part, total):
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, cells binary"
    partial = docs.select("text").mapInArrow(tidy(count), schema).repartition("part").sortWithinPartitions("part")
    sketch = np.zeros((SKETCH_ROWS << SKETCH_BITS) // inner * inner, np.int64).reshape(-1, inner)
    for row in partial.mapInArrow(tidy(add), schema).collect():  # as large as the sketch
        sketch[row["part"]] = np.frombuffer(row["cells"], np.int64)
    return sketch.reshape(SKETCH_ROWS, -1)


def weights(hashes: np.ndarray, counts: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """TF-IDF weights: idf is 1 for a shingle of one document and 0 for one that makes up all there are.

    What other shingles add to a cell on the average is taken off it, so that rare shingles keep the idf of rare ones however
    many shingles share a cell.
    """
    total = int(sketch[0].sum())
    cells = np.stack([sketch[row][_cells(hashes, row)] for row in range(len(sketch))])
    seen = (cells - (total - cells) / (sketch.shape[1] - 1)).min(axis=0)
    idf = 1 - np.log(np.maximum(seen, 1)) / np.log(max(total, 2))
    return counts * (1 + IDF_SHARE * np.clip(idf, 0, 1))


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) draws r and log c, and uniform b, for 2^16 values of a hash."""
    rng = np.random.default_rng(3)
    r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    return r.astype(np.float32), np.log(c).astype(np.float32), b.astype(np.float32)


def sample(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Samples of each document (document x sample) as 64-bit values; rows of documents without shingles are 0.

    Ties inside a sample go to the shingle with the smallest hash.
    """
    r_all, c_all, b_all = _draws()
    out = np.zeros((n, BANDS * ROWS), np.uint64)
    if not len(doc):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sizes = np.diff(np.append(first, len(doc)))
    place = np.arange(len(doc))
    logs = np.log(weight).astype(np.float32)
    for j in range(BANDS * ROWS):
        at = (hashes * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64) | 1)) >> np.uint64(48)
        r = r_all[at]
        t = np.floor(logs / r + b_all[at])
        value = c_all[at] - r * (t - b_all[at] + np.float32(1))
        least = np.repeat(np.minimum.reduceat(value, first), sizes)
        best = np.minimum.reduceat(np.where(value == least, place, len(doc)), first)
        out[doc[first], j] = mix(hashes[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(j))
    return out


def signatures(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``doc_id, d1, d2, keys, sig``: digest of the text, a bucket key for each band, a byte of each sample.

    Documents without words are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches):
        for batch in batches:
            for rows in slices(batch, limit=SMALL_SLICE):
                doc, hashes, counts = shingles(words_of(rows.column("text"), lower=True))
                values = sample(doc, hashes, weights(hashes, counts, shared.value), rows.num_rows)
                keys = np.zeros((rows.num_rows, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys * np.uint64(31) + values[:, k::ROWS][:, :BANDS] + np.arange(BANDS, dtype=np.uint64))
                some = np.unique(doc)
                part = rows.take(pa.array(some))
                sig = (values[some] & np.uint64(255)).astype(np.uint8)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys[some].ravel().view(np.int64))
                )
                columns = [part.column(c) for c in ("doc_id", "d1", "d2")] + [lists, pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "d1", "d2", "keys", "sig"])

    digested = docs.select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(1)).alias("d2"))
    return digested.mapInArrow(tidy(sign), "doc_id long, d1 long, d2 long, keys array<long>, sig binary")


def verify(pairs: DataFrame, texts: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``a, b, similarity`` of pairs: weighted Jaccard similarity on the whole texts (``rep, text``)."""
    shared = pairs.sparkSession.sparkContext.broadcast(sketch)

    def compare(batches):
        for batch in batches:
            for rows in slices(batch, "ta", SMALL_SLICE):
                n = rows.num_rows
                sides = []
                for c in ("ta", "tb"):
                    doc, hashes, counts = shingles(words_of(rows.column(c), lower=True))
                    sides.append((doc, hashes, weights(hashes, counts, shared.value)))
                doc, hashes, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
                order = np.lexsort((hashes, doc))
                doc, hashes, weight = doc[order], hashes[order], weight[order]
                both = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
                shared_weight = np.bincount(doc[both], np.minimum(weight[both], weight[both + 1]), n)
                whole = np.bincount(doc, weight, n) - shared_weight
                found = shared_weight / np.maximum(whole, 1e-12)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(found)], ["a", "b", "similarity"])

    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").mapInArrow(tidy(compare), "a long, b long, similarity double")


def components(links: DataFrame, keep: bool = False) -> DataFrame:
    """``node, root`` of every node of ``a, b``. Nodes hook to their smallest neighbour, linked trees contract.

    ``keep`` saves the result from the end of a ``scratch`` block.
    """
    edges, labels = stored(links.select("a", "b").distinct(), "edges"), None
    while labels is None or not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = labels.join(hooks, F.col("root") == F.col("a"), "left")
            labels = moved.select("node", F.coalesce("to", "root").alias("root"))
        ha = hooks.select("a", F.col("to").alias("x"))
        hb = hooks.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = edges.join(ha, "a").join(hb, "b").filter("x <> y")
        edges = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return stored(labels, "labels", keep)


def _equal(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``a, b, equal`` of rows with signatures ``sa, sb``, where enough samples are equal."""
    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
    equal = (x == y).sum(axis=1).astype(np.int32)
    out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal)], ["a", "b", "equal"])
    return out.filter(pa.array(equal >= PLAUSIBLE))


def _plausible(pairs: DataFrame) -> DataFrame:
    """``a, b, equal`` of pairs with signatures ``sa, sb`` that have enough equal samples."""
    return pairs.select("a", "b", "sa", "sb").mapInArrow(
        lambda batches: (_equal(x) for x in batches if x.num_rows), "a long, b long, equal int"
    )


def _open_members(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, rep, sig, root, main, n``: members of buckets that hold more than one component.

    ``main`` is the component of the bucket's first member.
    """
    roots = labels.withColumnRenamed("node", "rep")
    held = entries.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    held = stored(held.select("key", "rep", "sig", "root"), "members")
    parity = F.pmod("key", F.lit(2))  # leaves the join an exchange of its own, which can be split
    heads = held.groupBy("key", parity.alias("p")).agg(
        F.min_by("root", "rep").alias("main"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
    )
    return stored(held.join(heads.filter("low <> high").select("key", "main", "n"), "key"), "open")


def _small_buckets(members: DataFrame) -> DataFrame:
    """``a, b``: plausible pairs across components in buckets of at most ``SMALL`` members."""
    small = members.filter(F.col("n") <= SMALL)
    a = small.select("key", F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("root").alias("ra"))
    b = small.select(F.col("key").alias("kb"), F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("root").alias("rb"))
    return _plausible(a.join(b, (F.col("key") == F.col("kb")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")))).select("a", "b")


def _blocks(members: DataFrame, columns: list[str]):
    """Members outside their bucket's main component against all members, in pairs of blocks of ``BLOCK``."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = members.filter(F.col("n") > SMALL).withColumn("blocks", blocks)
    large = large.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = large.filter("root <> main").select("key", F.col("block").alias("x"), every.alias("y"), *columns)
    names = {"key": "key2", "block": "y2"} | {c: c for c in columns}
    right = large.select(every.alias("x2"), *[F.col(c).alias(n) for c, n in names.items()])
    return left.groupBy("key", "x", "y").cogroup(right.groupBy("key2", "x2", "y2"))


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


_NO_PAIRS = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)}


def _large_buckets(members: DataFrame) -> DataFrame:
    """``a, b``: the ``TRIES`` most similar partners of other components, in larger buckets and each block."""

    def meet(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame(_NO_PAIRS)
        x, y = _bytes(mine["sig"]), _bytes(others["sig"])
        rx, ry = mine["root"].to_numpy(), others["root"].to_numpy()
        a, b = mine["rep"].to_numpy(), others["rep"].to_numpy()
        out = []
        for i in range(len(mine)):
            equal = (y == x[i]).sum(axis=1)
            good = np.flatnonzero((equal >= PLAUSIBLE) & (ry != rx[i]))
            if len(good) > TRIES:
                good = good[np.argsort(-equal[good], kind="stable")[:TRIES]]
            out.append((np.minimum(a[i], b[good]), np.maximum(a[i], b[good])))
        return pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})

    return _blocks(members, ["rep", "sig", "root"]).applyInPandas(meet, "a long, b long")


def _exhaust(members: DataFrame, reps: DataFrame, texts: DataFrame, sketch: np.ndarray, similarity: float) -> DataFrame:
    """``a, b``: links between components in larger buckets, with every plausible pair compared in the task.

    Only links leave a task, one for each member and other component. A pair that shares several
    buckets is compared in the one of its first band.
    """
    shared = members.sparkSession.sparkContext.broadcast(sketch)

    def side(frame: pd.DataFrame):
        doc, hashes, counts = shingles(words_of(pa.array(frame["text"], pa.string()), lower=True))
        weight = weights(hashes, counts, shared.value)
        return hashes, weight, np.searchsorted(doc, np.arange(len(frame) + 1)), np.bincount(doc, weight, len(frame))

    def meet(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame(_NO_PAIRS)
        x, y = _bytes(mine["sig"]), _bytes(others["sig"])
        kx, ky = np.stack(mine["keys"].to_numpy()), np.stack(others["keys"].to_numpy())
        rx, ry = mine["root"].to_numpy(), others["root"].to_numpy()
        a, b = mine["rep"].to_numpy(), others["rep"].to_numpy()
        (hx, wx, cx, tx), (hy, wy, cy, ty) = side(mine), side(others)
        band = int(mine["band"].iloc[0])
        out = []
        for i in range(len(mine)):
            good = ((y == x[i]).sum(axis=1) >= PLAUSIBLE) & (ry != rx[i]) & ~(ky[:, :band] == kx[i, :band]).any(axis=1)
            good = np.flatnonzero(good)
            own, own_weight = hx[cx[i] : cx[i + 1]], wx[cx[i] : cx[i + 1]]
            if not len(good) or not len(own):
                continue
            sizes = cy[good + 1] - cy[good]
            at = np.repeat(cy[good] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            found = np.minimum(np.searchsorted(own, hy[at]), len(own) - 1)
            both = np.where(own[found] == hy[at], np.minimum(own_weight[found], wy[at]), 0.0)
            both = np.bincount(np.repeat(np.arange(len(good)), sizes), both, len(good))
            links = good[both >= similarity * (tx[i] + ty[good] - both)]
            links = links[np.unique(ry[links], return_index=True)[1]]
            out.append((np.minimum(a[i], b[links]), np.maximum(a[i], b[links])))
        if not out:
            return pd.DataFrame(_NO_PAIRS)
        return pd.DataFrame({"a": np.concatenate([o[0] for o in out]), "b": np.concatenate([o[1] for o in out])})

    large = members.filter(F.col("n") > SMALL).join(reps.select("rep", "keys"), "rep").join(texts, "rep")
    large = large.withColumn("band", F.array_position("keys", F.col("key")).cast("int") - 1)
    return _blocks(large, ["rep", "sig", "root", "keys", "band", "text"]).applyInPandas(meet, "a long, b long")


def _labels(known: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of all documents that share a class with another one: the one table that is kept."""
    sketch = document_frequencies(known)
    signed = stored(signatures(known, sketch), "signatures")
    reps = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"), F.min("sig").alias("sig"))
    reps = stored(reps, "distinct")
    belongs = signed.select("doc_id", "d1", "d2").join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep")
    entries = reps.select("rep", "sig", F.explode("keys").alias("key"))
    parity = F.pmod("key", F.lit(2))
    heads = entries.groupBy("key", parity.alias("p")).agg(F.min("rep").alias("head"), F.count("*").alias("n"))
    entries = stored(entries.join(heads.filter("n > 1").select("key", "head"), "key"), "entries")
    sigs = reps.select("rep", "sig").groupBy("rep").agg(F.min("sig").alias("sig"))
    wanted = entries.select("rep").distinct()
    texts = known.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi").dropDuplicates(["rep"])
    texts = stored(texts, "texts")
    stars = entries.filter("head <> rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    sa = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    sb = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    nearest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("equal"), "a"))
    stars = _plausible(stars.join(sa, "a").join(sb, "b")).withColumn("r", nearest).filter("r <= 2").select("a", "b")
    tried = stored(verify(stars, texts, sketch), "tried")
    members = entries.select("key", "rep", "sig")
    linked = F.col("similarity") >= similarity
    members = _open_members(members, components(tried.filter(linked)))
    more = _small_buckets(members).unionByName(_large_buckets(members)).distinct()
    more = more.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    tried = tried.unionByName(stored(verify(more, texts, sketch), "tried"))
    links = tried.filter(linked).select("a", "b")
    large = members.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        large = _open_members(large.select("key", "rep", "sig"), components(links))
        one_each = reps.dropDuplicates(["rep"])
        links = links.unionByName(stored(_exhaust(large, one_each, texts, sketch, similarity), "links"))
    # Copies of one text are linked by their digest.
    copies = belongs.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return components(links.unionByName(copies), keep=True)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id``: one row for each row of ``docs``; a class is named by its smallest ``doc_id``.

    Equal texts are one node from the start, so copies are never expanded to pairs. Then

    1. each bucket links its members to its first one, where that is verified;
    2. buckets that still hold several components go on: small ones try all plausible pairs across
       components, in larger ones members outside the first member's component try their most similar
       partners of other components;
    3. in larger buckets that are still open, such members are compared with all plausible partners, block
       by block, and only links leave the tasks.

    Every plausible pair of a bucket is thus verified or already connected. Documents without words (null, empty or
    blank text) are classes of their own; a null ``doc_id`` has a null class. Rows that share a ``doc_id`` share
    a class. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        labels = _labels(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"), similarity)
    named = labels.withColumnRenamed("node", "doc_id")
    return rows.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
