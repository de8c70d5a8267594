"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Every training word is clustered, and the number of classes grows with the square root of the number of words.
Exchange on the most frequent words, and on the last bytes of all others, gives coarse classes; these are split,
and then all words move in rounds, each to the class that fits the classes of its neighbours best. The neighbour
counts and the classes of words are Spark tables; tasks hold class by class counts and the classes of a bounded
number of frequent words. Last bytes stand only for words that training has not seen. A text has the probability

    product over its words and end of  P(class | class before) * P(word | class)

where a class gives the mass of its words seen once, and one more, to all words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.store import scratch, stored
from leafwise.llm.words import Words, mix, slices, tidy, words_of

WORD_UNITS = 512  # of the coarse classes
ENDING_UNITS = 255
ENDINGS = 1 << 14  # with a class of their own for unseen words
CLASSES = 32  # coarse classes
SPLIT = 128  # a coarse class is split by sqrt(words) / SPLIT
MOVES = 2  # rounds, in each of which every other word may move: words that move at once do not see one another
CELLS = 1 << 23  # numbers held at once while words are compared with classes
MANY = 32  # cells from which a word's are laid out by all classes
ROUNDS = 8
HEAD = 1 << 18  # most frequent words whose counts every task holds; all others are joined
FLUSH = 1 << 21  # tokens counted before a partition hands out what it has
PRIOR = 0.5  # added to every class transition
OUT_ROWS = 1 << 16
LINE = 1 << 18  # words of a stored line
CELL = np.dtype([("key", "<u4"), ("n", "<u4")])


class Units(NamedTuple):
    """Unit 0 is the end of a text, 1 any word without a unit of its own or of its ending.

    In a finished model the words are those of the head, and endings serve unseen words.
    """

    words: np.ndarray  # sorted hashes
    word_ids: np.ndarray
    endings: np.ndarray  # sorted endings
    ending_ids: np.ndarray

    @property
    def size(self) -> int:
        return 2 + len(self.words) + len(self.endings)

    def of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = _looked_up(self.endings, self.ending_ids, endings, 1)
        return _looked_up(self.words, self.word_ids, hashes, out)


class Model(NamedTuple):
    units: Units
    class_of: np.ndarray  # by unit
    moves: np.ndarray  # log10 P(class | class before)
    totals: np.ndarray  # log10 of each class's words and unseen mass
    unseen: np.ndarray  # log10 of each class's unseen mass
    head: tuple[np.ndarray, np.ndarray]  # sorted hashes of frequent words, and their counts
    n_docs: int
    n_tokens: int
    n_types: int


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(default, asked.shape).copy()
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def _types(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Type of each word, and hash and ending of each type; an ending is the last three bytes as a number."""
    codes, hashes = pd.factorize(words.hashes)
    first = np.empty(len(hashes), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    ends, sizes = words.ends[first], (words.ends - words.starts)[first]
    endings = np.zeros(len(hashes), np.int64)
    for j in range(3):
        byte = words.data[np.maximum(ends - 1 - j, 0)].astype(np.int64)
        byte[(byte >= 0x41) & (byte <= 0x5A)] |= 0x20
        endings += np.where(sizes > j, byte << (8 * j), 0)
    return codes, hashes, endings


def count_words(docs: DataFrame) -> DataFrame:
    """``h, c, ending``: how often each word stands in all texts; partitions count their own words first."""

    @tidy
    def count(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for rows in slices(batch):
                codes, hashes, endings = _types(words_of(rows.column("text"), lower=True))
                held.append((hashes, np.bincount(codes, minlength=len(hashes)), endings))
                n += len(codes)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    def flush(held):
        hashes, counts, endings = (np.concatenate(x) for x in zip(*held, strict=True))
        codes, uniques = pd.factorize(hashes)
        ending = np.empty(len(uniques), np.int64)
        ending[codes] = endings
        total = np.bincount(codes, counts, len(uniques)).astype(np.int64)
        columns = [pa.array(uniques.view(np.int64)), pa.array(total), pa.array(ending.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["h", "c", "ending"])

    partial = docs.select("text").mapInArrow(count, "h long, c long, ending int")
    return partial.groupBy("h").agg(F.sum("c").alias("c"), F.min("ending").alias("ending"))


def _sorted_units(words: list[int], endings: list[int]) -> Units:
    hashes = np.array(words, np.int64).view(np.uint64)
    order, ends = np.argsort(hashes), np.array(sorted(endings), np.int64)
    return Units(hashes[order], 2 + np.arange(len(words)), ends, 2 + len(words) + np.arange(len(ends)))


def count_bigrams(docs: DataFrame, units: Units) -> np.ndarray:
    """How often each unit follows each other one, over all texts with their ends."""
    size = units.size

    @tidy
    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for rows in slices(batch):
                words = words_of(rows.column("text"), lower=True)
                line = _line(words, units)[0]
                total += np.bincount(np.append(0, line[:-1]) * size + line, minlength=size * size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    pairs = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = pairs.toPandas()  # at most size^2 rows
    out = np.zeros(size * size, np.int64)
    out[found["pair"].to_numpy(int)] = found["n"].to_numpy(int)
    return out.reshape(size, size)


def _line(words: Words, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Units of all words with a 0 behind each text, and the places of the ends."""
    codes, hashes, endings = _types(words)
    ends = words.bounds[1:] + np.arange(len(words.bounds) - 1)
    return np.insert(units.of(hashes, endings)[codes], words.bounds[1:], 0), ends


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit. Unit 0 keeps class 0 for itself; the others move while the likelihood rises."""
    size = len(pairs)
    seen = pairs.sum(axis=0)
    class_of = np.zeros(size, np.int64)
    rank = np.argsort(-seen[1:], kind="stable")
    class_of[1:][rank] = 1 + np.arange(size - 1) % (classes - 1)
    n = np.zeros((classes, classes))
    np.add.at(n, (class_of[:, None], class_of[None, :]), pairs)
    f = lambda x: x * np.log(np.maximum(x, 1))
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in 1 + rank:
            if not seen[u] and not pairs[u].any():
                continue
            out = np.bincount(class_of, pairs[u], classes)
            into = np.bincount(class_of, pairs[:, u], classes)
            own, was = pairs[u, u], class_of[u]
            out[was] -= own
            into[was] -= own
            n[was] -= out
            n[:, was] -= into
            n[was, was] -= own
            gain = (f(n + out[None, :]) - f(n)).sum(axis=1) + (f(n + into[:, None]) - f(n)).sum(axis=0)
            d = n[diagonal, diagonal]
            gain += f(d + out + into + own) - f(d) - (f(d + out) - f(d)) - (f(d + into) - f(d))
            for side, mine in ((n.sum(axis=1), out.sum() + own), (n.sum(axis=0), into.sum() + own)):
                gain -= f(side + mine) - f(side)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            moved += best != was
            class_of[u] = best
            n[best] += out
            n[:, best] += into
            n[best, best] += own
        if not moved:
            break
    return class_of


def _coded(names: np.ndarray) -> bytes:
    """Names from -1 on as bytes, all lowest bytes first: the highest ones are nearly all zero and pack well."""
    return (names + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _decoded(lines: pa.Array) -> Iterator[np.ndarray]:
    for value in lines:
        planes = np.frombuffer(value.as_buffer(), np.uint8).reshape(4, -1)
        yield np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64) - 1


def _named(words: Words, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words with a 0 ahead of, between and behind the texts; places of words without one, their hashes and endings.

    A word of ``head`` is its place there plus one, any other word -1, and 0 the end of a text.
    """
    codes, hashes, endings = _types(words)
    names = _looked_up(head, np.arange(1, len(head) + 1), hashes, -1)
    line = np.append(0, np.insert(names[codes], words.bounds[1:], 0))
    rare = np.flatnonzero(names[codes] < 0)
    at = 1 + rare + np.searchsorted(words.bounds[1:], rare, "right")
    return line, at, hashes[codes[rare]].view(np.int64), endings[codes[rare]]


def word_lines(docs: DataFrame, head: np.ndarray) -> DataFrame:
    """``line``: the names of the words of some texts, see ``_named``, as bytes."""

    @tidy
    def name(batches):
        for batch in batches:
            for rows in slices(batch):
                line = _named(words_of(rows.column("text"), lower=True), head)[0]
                for at in range(0, len(line) - 1, LINE):  # a line begins with the last name of the one before
                    yield pa.RecordBatch.from_arrays([pa.array([_coded(line[at : at + LINE + 1])], pa.binary())], ["line"])

    return docs.select("text").mapInArrow(name, "line binary")


def rare_words(docs: DataFrame, head: np.ndarray, units: Units, coarse: np.ndarray, split: int) -> DataFrame:
    """One row ``h, ending, beside, after, met, cls`` for each word outside ``head``, with its first class.

    ``beside`` holds the names on both sides of every occurrence (left << 32 | right, each plus one), ``after`` the hashes
    of following words outside the head; ``met`` is true when such a word stands before it somewhere. A word outside the
    head makes up less than one part in ``HEAD`` of all tokens.
    """

    @tidy
    def find(batches):
        for batch in batches:
            for rows in slices(batch):
                line, at, hashes, endings = _named(words_of(rows.column("text"), lower=True), head)
                sides = (line[at - 1] + 1) << 32 | (line[at + 1] + 1)
                follows = np.append(at[1:] == at[:-1] + 1, False) if len(at) else np.zeros(0, bool)
                after = pa.array(np.append(hashes[1:], 0)[: len(at)], mask=~follows)
                columns = [pa.array(hashes), pa.array(endings.astype(np.int32)), pa.array(sides), after]
                yield pa.RecordBatch.from_arrays(columns, ["h", "ending", "sides", "after"])

    def begin(batches):
        for batch in batches:
            hashes = batch.column("h").to_numpy().view(np.uint64)
            cls = _first_class(hashes, batch.column("ending").to_numpy(), units, coarse, split)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls.astype(np.int32))], [*batch.schema.names, "cls"])

    found = docs.select("text").mapInArrow(find, "h long, ending int, sides long, after long")
    grouped = found.groupBy("h").agg(
        F.min("ending").alias("ending"),
        F.collect_list("sides").alias("beside"),
        F.collect_list("after").alias("after"),
        F.bool_or(F.col("sides") < 1 << 32).alias("met"),
    )
    return grouped.mapInArrow(begin, "h long, ending int, beside array<long>, after array<long>, met boolean, cls int")


def _first_class(hashes: np.ndarray, endings: np.ndarray, units: Units, coarse: np.ndarray, split: int) -> np.ndarray:
    """The parts of a coarse class begin with words by their hashes."""
    kind = coarse[units.of(hashes, endings)]
    return 1 + (kind - 1) * split + (hashes >> np.uint64(40)).astype(np.int64) % split


def _beside(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and name to the left and to the right, of each occurrence of a batch of ``rare_words``."""
    lists = batch.column("beside")
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    sides = lists.flatten().to_numpy()
    return row, (sides >> 32) - 1, (sides & 0xFFFFFFFF) - 1


def _meetings(rare: DataFrame) -> DataFrame:
    """``a, b, left, right``: words outside the head that stand one behind the other, and their classes."""
    first = rare.select(F.col("h").alias("a"), F.col("cls").alias("left"), F.explode("after").alias("b"))
    return first.join(rare.filter("met").select(F.col("h").alias("b"), F.col("cls").alias("right")), "b")


def class_pairs(lines: DataFrame, rare: DataFrame, head_class: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each other one."""
    schema = "pair long, n long"

    def counted(parts):
        total = np.zeros(classes * classes, np.int64)
        for left, right in parts:
            total += np.bincount(left * classes + right, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    @tidy
    def inside(batches):
        def parts():
            for batch in batches:
                for line in _decoded(batch.column("line")):
                    both = (line[:-1] >= 0) & (line[1:] >= 0)
                    yield head_class[line[:-1][both]], head_class[line[1:][both]]

        return counted(parts())

    @tidy
    def beside(batches):
        def parts():
            for batch in batches:
                row, left, right = _beside(batch)
                cls = batch.column("cls").to_numpy().astype(np.int64)[row]
                yield head_class[left[left >= 0]], cls[left >= 0]
                yield cls[right >= 0], head_class[right[right >= 0]]

        return counted(parts())

    met = _meetings(rare).groupBy((F.col("left").cast("long") * classes + F.col("right")).alias("pair")).agg(F.count("*").alias("n"))
    pairs = lines.mapInArrow(inside, schema).unionByName(rare.select("beside", "cls").mapInArrow(beside, schema)).unionByName(met)
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most classes^2 rows
    out = np.zeros(classes * classes)
    out[found["pair"].to_numpy(int)] = found["n"].to_numpy(int)
    return out.reshape(classes, classes)


def _summed(row: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of row and key in order, and how often each stands there."""
    both = np.sort(row * keys + key)
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return both[starts] // keys, both[starts] % keys, np.diff(np.append(starts, len(both)))


def _packed(w: np.ndarray, key: np.ndarray, keys: int) -> Iterator[pa.RecordBatch]:
    """One row for each word with its summed cells as bytes."""
    words, key, n = _summed(w, key, keys)
    cells = np.empty(len(words), CELL)
    cells["key"], cells["n"] = key, n
    firsts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    bounds = np.append(firsts, len(words)) * CELL.itemsize
    data = cells.tobytes()
    for low in range(0, len(firsts), OUT_ROWS):
        part = bounds[low : low + OUT_ROWS + 1]
        offsets = pa.py_buffer((part - part[0]).astype(np.int32))
        blobs = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, offsets, pa.py_buffer(data[part[0] : part[-1]])])
        yield pa.RecordBatch.from_arrays([pa.array(words[firsts[low : low + OUT_ROWS]]), blobs], ["w", "cells"])


def neighbours(lines: DataFrame, rare: DataFrame, head_class: np.ndarray, free: np.ndarray, classes: int) -> DataFrame:
    """``w, cells`` of the ``free`` words of the head: the counts by class of what follows (key ``class``) and of what
    stands before (key ``classes + class``).
    """
    keys = 2 * classes

    def packed(parts):
        held: list[tuple] = []
        n = 0
        for part in parts:
            held.append(part)
            n += len(part[0])
            if n >= FLUSH:
                yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), keys)
                held, n = [], 0
        if n:
            yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), keys)

    @tidy
    def inside(batches):
        def parts():
            for batch in batches:
                for line in _decoded(batch.column("line")):
                    both = (line[:-1] >= 0) & (line[1:] >= 0)
                    left, right = line[:-1][both], line[1:][both]
                    for side, (w, other) in enumerate(((left, right), (right, left))):
                        yield w[free[w]], side * classes + head_class[other[free[w]]]

        return packed(parts())

    @tidy
    def beside(batches):
        def parts():
            for batch in batches:
                row, *sides = _beside(batch)
                cls = batch.column("cls").to_numpy().astype(np.int64)[row]
                for side, w in enumerate(sides):
                    hit = np.flatnonzero(w >= 0)
                    hit = hit[free[w[hit]]]
                    yield w[hit], side * classes + cls[hit]

        return packed(parts())

    schema = "w long, cells binary"
    cells = lines.mapInArrow(inside, schema).unionByName(rare.select("beside", "cls").mapInArrow(beside, schema))
    return cells.groupBy("w").agg(F.collect_list("cells").alias("cells"))


def _cells(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and count of each cell of a batch of ``neighbours``, in this order and summed over partitions."""
    lists = batch.column("cells")
    blobs = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    row = np.repeat(row, pc.binary_length(blobs).to_numpy() // CELL.itemsize)
    cells = np.frombuffer(b"".join(blobs.to_pylist()), CELL)
    both = row * keys + cells["key"].astype(np.int64)
    order = np.argsort(both)
    both = both[order]
    starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[starts] // keys, both[starts] % keys, np.add.reduceat(cells["n"][order].astype(np.int64), starts)


class Fit:
    """Finds the class in which the neighbours of words are likeliest, each word itself not counted."""

    def __init__(self, n: np.ndarray):
        classes = len(n)
        self.counts = np.concatenate([n.T, n])  # by key and class
        self.sides = np.concatenate([np.broadcast_to(x, n.shape) for x in (n.sum(axis=1), n.sum(axis=0))])
        self.smooth = PRIOR * classes
        self.fit = np.log((self.counts + PRIOR) / (self.sides + self.smooth)).astype(np.float32)

    def best(self, was: np.ndarray, c: np.ndarray, row: np.ndarray, key: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The classes of words that are in ``was`` and seen ``c`` times, from their cells in the order of ``row``; words without cells stay."""
        fit, classes = self.fit, self.fit.shape[1]
        own = np.maximum(self.counts[key, was[row]] - m, 0) + PRIOR
        own /= np.maximum(self.sides[key, was[row]] - c[row], 0) + self.smooth
        stays = np.bincount(row, m * np.log(own), len(was))
        bounds, best = np.searchsorted(row, np.arange(len(was) + 1)), was.copy()
        size = np.diff(bounds)
        for many in (False, True):
            chosen = np.flatnonzero((size > 0) & ((size >= MANY) == many))
            step = max(1, CELLS // classes // (2 if many else MANY))
            for low in range(0, len(chosen), step):
                part = chosen[low : low + step]
                at = np.repeat(bounds[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
                if many:
                    place = np.repeat(np.arange(len(part)), size[part]) * len(fit) + key[at]
                    scores = np.bincount(place, m[at], len(part) * len(fit)).astype(np.float32).reshape(-1, len(fit)) @ fit
                else:
                    firsts = np.cumsum(size[part]) - size[part]
                    scores = np.add.reduceat(fit[key[at]] * m[at, None].astype(np.float32), firsts)
                scores[:, 0] = -np.inf  # the end's own
                mine, now = np.arange(len(part)), was[part]
                scores[mine, now] = stays[part]
                top = scores.argmax(axis=1)
                best[part] = np.where(scores[mine, top] > stays[part] + 1e-4, top, now)
        return best


def moved_head(lines: DataFrame, rare: DataFrame, head_class: np.ndarray, seen: np.ndarray, free: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the head after its ``free`` words have moved; ``seen`` is how often each word stands."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast((n, head_class, seen))

    @tidy
    def move(batches):
        n, head_class, seen = shared.value
        fit = Fit(n)
        for batch in batches:
            w = batch.column("w").to_numpy()
            cls = fit.best(head_class[w], seen[w], *_cells(batch, 2 * len(n)))
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(cls)], ["w", "cls"])

    found = neighbours(lines, rare, head_class, free, len(n)).mapInArrow(move, "w long, cls long").toPandas()  # at most HEAD rows
    out = head_class.copy()
    out[found["w"].to_numpy(int)] = found["cls"].to_numpy(int)
    return out


def moved_rare(rare: DataFrame, head_class: np.ndarray, n: np.ndarray, turn: int) -> DataFrame:
    """``rare`` after the words that are free in this turn have moved. Most meet only words of the head and move where they are."""
    classes = len(n)
    shared = rare.sparkSession.sparkContext.broadcast((n, head_class))

    @tidy
    def move(batches):
        n, head_class = shared.value
        fit = Fit(n)
        for batch in batches:
            was = batch.column("cls").to_numpy().astype(np.int64)
            free = batch.column("h").to_numpy() % 2 != turn % 2
            row, left, right = _beside(batch)
            c = np.bincount(row, minlength=len(was))
            lists = batch.column("keys")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            rows = [row[right >= 0], row[left >= 0], np.repeat(np.arange(len(was)), size)]
            keys = [head_class[right[right >= 0]], classes + head_class[left[left >= 0]], lists.flatten().to_numpy()]
            row, key = np.concatenate(rows), np.concatenate(keys).astype(np.int64)
            part = _summed(row[free[row]], key[free[row]], 2 * classes)
            cls = np.where(free, fit.best(was, c, *part), was).astype(np.int32)
            columns = [batch.column(x) for x in ("h", "ending", "beside", "after", "met")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cls)], ["h", "ending", "beside", "after", "met", "cls"])

    meet = F.col("met") | (F.size("after") > 0)
    cell = lambda h, key: F.struct(F.col(h).alias("h"), key.alias("key"))
    both = F.explode(F.array(cell("a", F.col("right")), cell("b", F.col("left") + classes)))
    keys = _meetings(rare).select(both.alias("x")).select("x.h", "x.key").groupBy("h").agg(F.collect_list("key").alias("keys"))
    alone = rare.filter(~meet).withColumn("keys", F.lit(None).cast("array<int>"))
    beside = rare.filter(meet).join(keys, "h", "left")
    return alone.unionByName(beside).mapInArrow(move, rare.schema)


def _likelihood(n: np.ndarray) -> float:
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


def cluster(docs: DataFrame, frequent: pd.DataFrame, units: Units, coarse: np.ndarray, classes: int, split: int):
    """Table of all words ``h, c, ending, cls``, classes of the head, and counts of class pairs.

    ``frequent`` holds the head in the order of its hashes. Rounds end early when one does not raise the likelihood;
    that round's moves are undone.
    """
    spark = docs.sparkSession
    hashes = frequent["h"].to_numpy(np.int64)
    seen = np.append(0, frequent["c"].to_numpy(np.int64))
    head = hashes.view(np.uint64)
    endings = frequent["ending"].to_numpy(np.int64)
    head_class = np.append(0, _first_class(head, endings, units, coarse, split))
    with scratch(spark):
        lines = stored(word_lines(docs, head), "word-lines")
        rare = stored(rare_words(docs, head, units, coarse, split), "rare-words")
        best = rare, head_class, class_pairs(lines, rare, head_class, classes)
        for turn in range(MOVES):
            rare, head_class, n = best
            free = np.append(False, hashes % 2 != turn % 2)
            next_class = moved_head(lines, rare, head_class, seen, free, n)
            rare = stored(moved_rare(rare, head_class, n, turn), "rare-words")
            found = class_pairs(lines, rare, next_class, classes)
            if _likelihood(found) <= _likelihood(n):
                break
            best = rare, next_class, found
        rare, head_class, n = best
        table = frequent[["h", "c", "ending"]].assign(cls=head_class[1:])
        named = spark.createDataFrame(table, "h long, c long, ending int, cls int")
        others = rare.select("h", F.size("beside").cast("long").alias("c"), "ending", "cls")
        return stored(named.unionByName(others), "word-classes", keep=True), head_class, n


def fit(docs: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the table of all words with counts and classes. Null texts count as empty.

    ``classes`` are coarse classes. Tables of words held by the driver and every task are bounded.
    """
    counts = stored(count_words(docs), "word-counts")
    n_docs = docs.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    frequent = _frequent(counts)
    words = frequent["h"].head(WORD_UNITS).tolist()
    rest = counts.filter(~F.col("h").isin(words)) if words else counts
    endings = rest.groupBy("ending").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "ending").limit(ENDING_UNITS)
    units = _sorted_units(words, [r["ending"] for r in endings.collect()])
    coarse = exchange(count_bigrams(docs, units), classes)
    frequent = frequent.iloc[np.argsort(frequent["h"].to_numpy(np.int64).view(np.uint64))]
    hashes = frequent["h"].to_numpy(np.int64).view(np.uint64)
    head = (hashes, frequent["c"].to_numpy(np.int64))
    split = max(1, int(sums["v"] ** 0.5 / SPLIT))
    named, head_class, n = cluster(docs, frequent, units, coarse, 1 + (classes - 1) * split, split)
    classes = len(n)
    moves = np.log10((n + PRIOR) / (n + PRIOR).sum(axis=1, keepdims=True))
    mass, once = np.zeros(classes), np.ones(classes)
    for row in named.groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect():
        mass[row["cls"]] += row["c"]
        once[row["cls"]] += row["once"]
    mass[0] = n_docs
    once[0] = 0  # an end is never an unseen word
    with np.errstate(divide="ignore"):
        totals, unseen = np.log10(np.maximum(mass + once, 1)), np.log10(once)
    ends, end_class = _endings(named)
    known = Units(head[0], 2 + np.arange(len(hashes)), ends, 2 + len(hashes) + np.arange(len(ends)))
    other = 1 + int(once[1:].argmax())
    class_of = np.concatenate([[0, other], head_class[1:], end_class])
    return Model(known, class_of, moves, totals, unseen, head, n_docs, (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)), named


def _endings(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent endings and the class that most words with them have; words seen seldom tell most of unseen ones."""
    votes = named.groupBy("ending", "cls").agg(F.sum(1 / F.col("c")).alias("n"))
    chosen = votes.groupBy("ending").agg(F.max_by("cls", F.struct("n", "cls")).alias("cls"), F.sum("n").alias("n"))
    found = chosen.orderBy(F.desc("n"), "ending").limit(ENDINGS).toPandas().sort_values("ending")
    return found["ending"].to_numpy(np.int64), found["cls"].to_numpy(np.int64)


def _frequent(counts: DataFrame) -> pd.DataFrame:
    """All words seen at least so often that no more than ``HEAD`` are, most frequent first.

    The limit comes from a table of how many words have a count of about each eighth of a power of two. If there are more
    words already in the first of these, the first ``HEAD`` by count and hash are taken.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    left, least = HEAD, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    chosen = counts.filter(level >= least) if least is not None else counts.orderBy(F.desc("c"), "h").limit(HEAD)
    return chosen.select("h", "c", "ending").toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def score(docs: DataFrame, model: Model, counts: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, extras, ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text.

    ``base_score`` is the add-one unigram model. Tokens of frequent words are scored where the text is read;
    other tokens get count and class by a join and come back to their text, where the steps beside them are added. Null texts count as empty: one end. Repeated
    rows are scored each; no rows give no rows; training on no texts leaves every word unseen.
    """
    extra = extra or {}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, h long, doc_id long, at long, side long, kind int, n_tokens long, known long, base double, part double"

    @tidy
    def walk(batches):
        model, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch):
                n = rows.num_rows
                words = words_of(rows.column("text"), lower=True)
                codes, hashes, endings = _types(words)
                kind = model.class_of[model.units.of(hashes, endings)]
                seen = _looked_up(*model.head, hashes, 0)
                line = np.insert(kind[codes], words.bounds[1:], 0)
                ends = words.bounds[1:] + np.arange(n)
                doc = np.repeat(np.arange(n), words.counts + 1)
                before = np.append(0, line[:-1])
                count = np.insert(seen[codes], words.bounds[1:], model.n_docs)
                known = count > 0
                sure = known.copy()  # the class is known here
                sure[ends] = True
                step = sure & np.append(True, sure[:-1])
                part = np.where(step, model.moves[before, line], 0) + np.where(
                    known, np.log10(np.maximum(count, 1)) - model.totals[line], 0
                )
                base = np.where(known, np.log10(count + 1), 0)
                if not model.n_docs:
                    part[ends] = np.where(step[ends], model.moves[before[ends], 0], 0)
                ids = np.arange(row, row + n)
                row += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        pa.array(mix(ids.astype(np.uint64)).view(np.int64)),  # spreads the rows; at = -1 makes a match void
                        rows.column("doc_id"),
                        pa.array(np.full(n, -1)),
                        pa.array(np.zeros(n, np.int64)),
                        pa.array(np.zeros(n, np.int32)),
                        pa.array(words.counts + 1),
                        pa.array(np.bincount(doc, known, n).astype(np.int64)),
                        pa.array(np.bincount(doc, base, n)),
                        pa.array(np.bincount(doc, part, n)),
                    ],
                    names,
                )
                rare = np.flatnonzero(~sure)
                owner = doc[rare]
                first = np.append(True, sure[:-1])[rare]  # the class before is known here
                left = np.where(first, before[rare], -1)
                right = np.where(sure[rare + 1], line[rare + 1], -1)
                none = lambda kind: pa.nulls(len(rare), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner]),
                        pa.array(np.insert(words.hashes, words.bounds[1:], 0)[rare].view(np.int64)),
                        none(pa.int64()),
                        pa.array(rare - np.append(0, ends[:-1] + 1)[owner]),
                        pa.array((left + 1) << 32 | (right + 1)),
                        pa.array(line[rare].astype(np.int32)),
                        *(none(k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())),
                    ],
                    names,
                )

    @tidy
    def add(batches):
        """Steps beside rare tokens, and their own shares."""
        model = shared.value
        for batch in batches:
            lists = batch.column("rare")
            rare, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            at, side, kind, c = (rare.field(x).to_numpy(zero_copy_only=False) for x in ("at", "side", "kind", "c"))
            order = np.lexsort((at, row))
            side, kind, c, row = side[order], kind[order], c[order], row[order]
            left, right = (side >> 32) - 1, (side & 0xFFFFFFFF) - 1
            left = np.where(left < 0, np.append(0, kind[:-1]), left)  # the token before is rare too
            part = model.moves[left, kind] + np.where(right < 0, 0, model.moves[kind, np.maximum(right, 0)])
            part += np.where(c > 0, np.log10(np.maximum(c, 1)), model.unseen[kind]) - model.totals[kind]
            score = batch.column("score").to_numpy() + np.bincount(row, part, len(lists))
            columns = [*(batch.column(x) for x in ("doc_id", "n_tokens", "n_known", "base")), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base", "score"])

    names = [x.split()[0] for x in schema.split(", ")]
    walked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = walked.mapInArrow(walk, schema)
    table = counts.select(F.col("h").alias("ch"), "c", "cls")
    joined = tokens.join(table, F.col("h") == F.col("ch"), "left")
    rare, found = F.col("at") >= 0, F.col("c").isNotNull()
    token = F.struct(
        "at", "side", F.coalesce("cls", "kind").alias("kind"), F.coalesce("c", F.lit(0)).cast("long").alias("c")
    )
    grouped = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.count_if(rare & found)).alias("n_known"),
        F.sum(F.when(rare, F.when(found, F.log10(F.col("c") + 1)).otherwise(0.0)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(rare, 0.0).otherwise(F.col("part"))).alias("score"),
        F.collect_list(F.when(rare, token)).alias("rare"),
    )
    summed = grouped.mapInArrow(add, "doc_id long, n_tokens long, n_known long, base double, score double")
    scale = float(np.log10(model.n_tokens + model.n_types + 1))
    return summed.select(
        "doc_id",
        *[c.alias(name) for name, c in extra.items()],
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * scale).alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
