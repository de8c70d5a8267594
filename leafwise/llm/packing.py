"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

A sequence with room ``g`` left is an open bin of gap ``g``; ``N(g)`` counts them. A piece goes where the sum
of ``N(g)^2`` over all gaps becomes smallest: into a bin of some gap, or into a new one. That keeps
gaps of every size in stock, so later pieces find exact fits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.encoders import ENCODE_SLICE, encoder
from leafwise.llm.store import stored
from leafwise.llm.words import slices, tidy

SEQUENCE = 1024
END_ID = 2
SHARD = 50_000  # pieces packed by one task
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Encode texts, append the end id and cut what is longer than ``size``; the first piece takes the rest.

    A null text counts as empty, so it is one piece holding the end id. ``with_ids`` adds the ids themselves.
    """
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            for rows in slices(batch, limit=ENCODE_SLICE):
                ids, bounds = encode(rows.column("text"))
                flat = np.insert(ids.astype("<u4"), bounds[1:], end_id)
                ends = bounds + np.arange(rows.num_rows + 1)
                totals = np.diff(ends)
                pieces = -(-totals // size)
                row = np.repeat(np.arange(rows.num_rows), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                rest = (totals - (pieces - 1) * size)[row]
                start = np.where(number == 0, 0, rest + (number - 1) * size)
                length = np.where(number == 0, rest, size)
                at = ends[row] + start
                crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [
                    rows.column("doc_id").take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.append(at, len(flat)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(cut), schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack pieces, longest first; gives the bin and offset of each piece and the gap left in every bin.

    Only a piece that fits no open bin opens a new one. Among placements with the same sum the smallest gap wins.
    """
    count = np.zeros(size + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        # Change of the sum of squares when a bin of gap g gets gap g - s; a full bin has no gap to count.
        here = count[s:]
        change = 2 - 2 * here + 2 * count[: size + 1 - s]
        change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        g = s + int(change.argmin())
        if count[g]:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g = len(gaps), size
            gaps.append(size)
        bins[i], offsets[i] = b, size - g
        gaps[b] = g - s
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, size: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with ``length`` from 1 to ``size``.

    Full pieces are sequences of their own. The others are dealt by hash into shards of about ``shard`` pieces,
    which tasks pack on their own. The pieces of sequences that kept a gap are dealt again and
    packed together, until one shard takes them all or they stop becoming fewer.
    An empty table gives an empty result; repeated rows are pieces of their own.
    """
    keyed = stored(pieces.withColumn("__key", F.monotonically_increasing_id()), "pieces")
    full = keyed.filter(F.col("length") >= size).select("__key", F.col("__key").alias("sequence_id"), F.lit(0).alias("offset"))
    rest = keyed.filter(F.col("length") < size).select("__key", "length")
    left, done, turn = rest.count(), [full], 0
    while left:
        shards = -(-left // shard)
        last = shards == 1
        turn += 1
        packed = stored(_pack_shards(rest, shards, size, turn), "packed")
        loose = packed.filter("gap > 0").select("__key", "length")
        again = 0 if last else loose.count()
        if last or again > 0.9 * left:
            done.append(packed.select("__key", "sequence_id", "offset"))
            break
        done.append(packed.filter("gap = 0").select("__key", "sequence_id", "offset"))
        rest, left = loose, again
    places = done[0]
    for more in done[1:]:
        places = places.unionByName(more)
    joined = keyed.join(places.withColumn("offset", F.col("offset").cast("long")), "__key")
    return joined.drop("__key")


def _pack_shards(rest: DataFrame, shards: int, size: int, turn: int) -> DataFrame:
    schema = "__key long, length long, sequence_id long, offset long, gap long"

    def pack_one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__key", ignore_index=True)
        bins, offsets, gaps = sum_of_squares(group["length"].to_numpy(), size)
        first = np.full(len(gaps), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, group["__key"].to_numpy())
        return pd.DataFrame(
            {
                "__key": group["__key"],
                "length": group["length"],
                "sequence_id": first[bins],
                "offset": offsets,
                "gap": gaps[bins],
            }
        )

    dealt = rest.withColumn("__shard", F.pmod(F.xxhash64("__key", F.lit(turn)), F.lit(shards)))
    return dealt.groupBy("__shard").applyInPandas(pack_one, schema)
