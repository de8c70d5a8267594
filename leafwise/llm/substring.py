"""Substring deduplication behind a count-min prefilter.

Windows of ``size`` consecutive words are counted in a count-min sketch: partitions sketch their own windows,
the sketches are merged, and a cell remembers whether it was hit more than once. Since
a sketch never counts too low, a window that stands in two documents has only such cells. A second
pass over the text takes those windows alone and groups them exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.words import Words, mix, slices, tidy, text_buffer, windows_of, words_of

WINDOW = 13
ROWS = 2
MIN_BITS, MAX_BITS = 16, 28  # log2 of the cells of a sketch row: the merged sketch has 64 MB at most
CELLS_PER_WINDOW = 2
PART_BITS = 12  # at most 2^12 parts of at least 2^16 cells are merged apart
SHARD_BYTES = 24 << 20  # text bytes for each shard of the second pass
BUCKET_BYTES = 4 << 20  # text bytes for each bucket of documents whose windows are gathered
FLUSH = 1 << 22  # windows sketched before a partition hands out what it has


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.uint32)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending distinct values as gaps of one byte; 255 adds on to the next byte."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    more, rest = np.divmod(gaps, 255)
    out = np.full(len(gaps) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(steps != 255)
    return np.cumsum(steps.astype(np.int64))[ends] + np.arange(len(ends))


def sketch_bits(n_bytes: int) -> int:
    """Row width by the size of the corpus: about ``CELLS_PER_WINDOW`` cells a window, up to the bound.

    Beyond the bound more windows pass the sketch; the second pass stays exact.
    """
    wanted = int(np.ceil(np.log2(max(1, CELLS_PER_WINDOW * n_bytes / 6))))
    return min(MAX_BITS, max(MIN_BITS, wanted))


def merged_sketch(docs: DataFrame, size: int, bits: int) -> list[np.ndarray]:
    """For each sketch row the packed bits of cells that were hit more than once."""
    part_bits = min(PART_BITS, bits - MIN_BITS)
    inner = bits - part_bits

    def sketch(batches):
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for rows in slices(batch):
                found = windows_of(words_of(rows.column("text")), size)[0]
                held.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held):
        hashes = np.concatenate(held)
        for row in range(ROWS):
            cells = np.sort(_cells(hashes, row, bits))
            new = np.r_[True, cells[1:] != cells[:-1]]
            once = cells[new]
            twice = once[np.diff(np.append(np.flatnonzero(new), len(cells))) > 1]
            parts = np.arange(1 << part_bits, dtype=np.int64) << inner
            a, b = np.append(np.searchsorted(once, parts), len(once)), np.append(np.searchsorted(twice, parts), len(twice))
            some = np.flatnonzero(np.diff(a))
            low = parts.tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array([row] * len(some), pa.int32()),
                    "part": pa.array(some, pa.int32()),
                    "once": pa.array([pack_sorted(once[a[p] : a[p + 1]] - low[p]) for p in some], pa.binary()),
                    "twice": pa.array([pack_sorted(twice[b[p] : b[p + 1]] - low[p]) for p in some], pa.binary()),
                }
            )

    def merge(batches):
        """Sorted rows of several parts: one part's cells at a time."""
        now, once, twice = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "part", "once", "twice")]
            for row, part, a, b in zip(*columns, strict=True):
                if (row, part) != now:
                    if now is not None:
                        yield packed(now, twice)
                    now, once, twice = (row, part), np.zeros(1 << inner, bool), np.zeros(1 << inner, bool)
                cells = unpack_sorted(a)
                twice[cells] |= once[cells]
                once[cells] = True
                twice[unpack_sorted(b)] = True
        if now is not None:
            yield packed(now, twice)

    def packed(now, twice):
        cells = [np.packbits(twice).tobytes()]
        return pa.RecordBatch.from_pydict(
            {"row": pa.array([now[0]], pa.int32()), "part": pa.array([now[1]], pa.int32()), "cells": pa.array(cells, pa.binary())}
        )

    partial = docs.select("text").mapInArrow(tidy(sketch), "row int, part int, once binary, twice binary")
    shards = partial.repartition("row", "part").sortWithinPartitions("row", "part")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for found in shards.mapInArrow(tidy(merge), "row int, part int, cells binary").toLocalIterator(prefetchPartitions=True):
        cells = np.frombuffer(found["cells"], np.uint8)
        low = found["part"] << (inner - 3)
        out[found["row"]][low : low + len(cells)] = cells
    return out


def repeated_windows(docs: DataFrame, size: int = WINDOW, bits: int | None = None) -> DataFrame:
    """``doc_id, spots``: windows (packed indexes of first words) that also start in a document with a smaller id.

    One row for each document that has any.

    A slice of documents settles by itself what it can: of the documents in it that share a window, all but
    the first are repeats. The first one's windows go, packed, to the shard of their hash; each shard compares
    the firsts of all slices. So a window sends one document a slice at most, however frequent it is.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = sketch_bits(n_bytes) if bits is None else bits
    shards, buckets = n_bytes // SHARD_BYTES + 1, n_bytes // BUCKET_BYTES + 1
    shared = docs.sparkSession.sparkContext.broadcast(merged_sketch(docs, size, bits))  # at most 64 MB

    def candidates(batches):
        rows_of_cells = shared.value
        for batch in batches:
            for rows in slices(batch):
                words = words_of(rows.column("text"))
                found, at = windows_of(words, size)
                likely = np.ones(len(found), bool)
                for row, cells in enumerate(rows_of_cells):
                    cell = _cells(found, row, bits)
                    likely &= (cells[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
                found, at = found[likely], at[likely]
                second = _second(words, at, size)
                doc = np.searchsorted(words.bounds, at, "right") - 1
                ids, places = rows.column("doc_id").to_numpy()[doc], (at - words.bounds[doc]).astype(np.int32)
                # Shards are ranges of the hash, so the sorted windows of a shard stand in a row.
                order = np.lexsort((ids, second, found))
                found, second, ids, places = found[order], second[order], ids[order], places[order]
                first = ids == _first_ids(found, second, ids)
                yield _only(_spots(ids[~first], places[~first], buckets), names)
                found, second, ids, places = found[first], second[first], ids[first], places[first]
                shard = ((found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cuts, ends = _runs(shard)
                parts = {"shard": pa.array(shard[cuts], pa.int64())}
                for name, values in (("h", found), ("g", second), ("ids", ids), ("places", places)):
                    parts[name] = pa.array([_planes(values[x:y]) for x, y in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())
                none = pa.nulls(len(cuts), pa.binary())
                parts |= {"bucket": pa.nulls(len(cuts), pa.int64()), "sizes": none, "spots": none}
                yield _only(pa.RecordBatch.from_pydict(parts), names)

    def resolve(batches):
        now, held = None, []
        for batch in batches:
            passed = pc.is_null(batch.column("h"))
            yield _only(batch.filter(passed), out)
            part = batch.filter(pc.invert(passed))
            columns = [part.column(c).to_pylist() for c in ("shard", "h", "g", "ids", "places")]
            for shard, *values in zip(*columns, strict=True):
                if shard != now and held:
                    yield settle(held)
                    held = []
                now = shard
                kinds = (np.uint64, np.int32, np.int64, np.int32)
                held.append([_values(x, kind) for x, kind in zip(values, kinds, strict=True)])
        if held:
            yield settle(held)

    def settle(held):
        found, second, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, second, found))
        found, second, ids, places = found[order], second[order], ids[order], places[order]
        later = ids != _first_ids(found, second, ids)
        return _only(_spots(ids[later], places[later], buckets), out)

    def gather(batches):
        """One row for each document of a bucket."""
        now, held = None, {}
        for batch in batches:
            for bucket, ids, sizes, spots in zip(*(batch.column(c).to_pylist() for c in out), strict=True):
                if bucket != now and held:
                    yield rows_of_documents(held)
                    held = {}
                now, at = bucket, 0
                for doc_id, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist(), strict=True):
                    held.setdefault(doc_id, []).append(spots[at : at + n])
                    at += n
        if held:
            yield rows_of_documents(held)

    def rows_of_documents(held):
        return pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(list(held), pa.int64()), "spots": pa.array(list(held.values()), pa.list_(pa.binary()))}
        )

    out = ["bucket", "ids", "sizes", "spots"]
    kinds = "bucket long, ids binary, sizes binary, spots binary"
    names = ["shard", "h", "g", "places", *out]
    schema = "shard long, h binary, g binary, places binary, " + kinds
    packed = docs.filter("doc_id IS NOT NULL").mapInArrow(tidy(candidates), schema)
    settled = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(resolve), kinds)
    return settled.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(gather), "doc_id long, spots array<binary>")


def _only(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(name) for name in names], names)


def _first_ids(found: np.ndarray, second: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For windows sorted by hash and id, the smallest id among equal windows."""
    if not len(found):
        return ids
    new = np.r_[True, (found[1:] != found[:-1]) | (second[1:] != second[:-1])]
    return ids[new][np.cumsum(new) - 1]


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte place by byte place: the zero bytes of small numbers stand together and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return cuts, np.append(cuts[1:], len(values))


def _spots(ids: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places gathered by document, documents by bucket; the shard only spreads these rows."""
    bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((places, ids, bucket))
    ids, places, bucket = ids[order], places[order], bucket[order]
    if len(ids):
        new = np.r_[True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])]
        ids, places, bucket = ids[new], places[new], bucket[new]
    begin, end = _runs(ids)
    spots = [pack_sorted(places[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    sizes, ids, bucket = np.fromiter(map(len, spots), np.int32, len(spots)), ids[begin], bucket[begin]
    begin, end = _runs(bucket)
    runs = list(zip(begin.tolist(), end.tolist(), strict=True))
    none = pa.nulls(len(runs), pa.binary())
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(bucket[begin], pa.int64()),
            "h": none,
            "g": none,
            "places": none,
            "bucket": pa.array(bucket[begin], pa.int64()),
            "ids": pa.array([ids[a:b].tobytes() for a, b in runs], pa.binary()),
            "sizes": pa.array([sizes[a:b].tobytes() for a, b in runs], pa.binary()),
            "spots": pa.array([b"".join(spots[a:b]) for a, b in runs], pa.binary()),
        }
    )


def _second(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Another 32 bits for chosen windows, from other sums over other hashes of their words."""
    other = mix(words.hashes ^ np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = out * np.uint64(0xA0761D6478BD642F) + other[at + j]
    return (mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def remove_repeats(docs: DataFrame, size: int = WINDOW, bits: int | None = None, rebuilt: bool = True) -> DataFrame:
    """Remove every word covered by a window that also starts in a document with a smaller id.

    Adds ``n_words, n_removed, kept_text``: kept words joined by single spaces, or with ``rebuilt=False`` the
    original text if nothing was removed. Windows are judged on the input. A window is known by 96 bits of two hashes.

    ``doc_id`` names a document: rows that share one are never repeats of each other, and the union of what they
    lose is removed from each. Rows with a null ``doc_id`` keep their words. A null text has no words. Texts shorter
    than a window lose nothing. An empty table gives an empty result. Other columns are kept; those named
    like a result are replaced.
    """
    added = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c not in added]
    kinds = dict(docs.dtypes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spots = repeated_windows(texts, size, bits).select(F.col("doc_id").alias("__doc"), F.col("spots").alias("__at"))
    both = docs.select(*[f"`{c}`" for c in kept]).join(spots, F.col("doc_id") == F.col("__doc"), "left")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_words long, n_removed long, kept_text string"

    def remove(batches):
        for batch in batches:
            for rows in slices(batch):
                data, offsets = text_buffer(rows.column("text"))
                raw = data.tobytes()
                counts, gone, texts = [], [], []
                for i, at in enumerate(rows.column("__at").to_pylist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    words = text.split()
                    counts.append(len(words))
                    lost = np.zeros(len(words), bool)
                    for spots in at or []:
                        lost[np.add.outer(unpack_sorted(spots), np.arange(size)).ravel()] = True
                    n = int(lost.sum())
                    gone.append(n)
                    if n:
                        words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                    texts.append((b" ".join(words) if n or rebuilt else text).decode())
                columns = [rows.column(c) for c in kept]
                columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return both.select(*[f"`{c}`" for c in kept], "__at").mapInArrow(tidy(remove), schema)


def with_digest(cleaned: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of cleaned documents."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for the query over ``documents``.
SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
  later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first),
  gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(coalesce(ps, []), k)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
