"""Exact token ids through a memo of pre-tokens.

Both public BPE files cut a text by a fixed pattern and encode every piece on its own, so a piece has
the same ids wherever it stands. An encoder therefore asks the tokenizers library once for each
distinct piece and keeps the answer in a bounded memo.

Texts take one of three ways, all with the ids of the library:

* letters of ASCII and two-byte Latin, digits, marks and blanks, without apostrophes: cut on whole
  batches of bytes, pieces told apart by 64-bit hashes inside one slice of a batch;
* other texts below U+0250: cut by the pattern, one text at a time;
* all else, and texts with the mark of a special string: given to the library as a whole.

Pieces of the byte file go to the library's model alone: its other steps, cutting and spelling the bytes, are done here.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from leafwise.llm.words import _hashes, text_buffer

MEMO = 250_000  # pieces in each of the two generations a worker keeps
LONG_PIECE = 256  # longer pieces are not kept
ENCODE_SLICE = 1 << 22  # bytes of text cut at once: pieces repeat more in larger slices


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version_digest(path: str) -> str:
    """Digest of the tokenizer file and the library version: changes when counts might."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


# The patterns of the two files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters on which the library's and this module's character classes agree: printable ASCII, tab,
# line feed, carriage return and the Latin letters of two bytes.
ODD = regex.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ]|<\\|")


@lru_cache(1)
def _spelling() -> dict[int, str]:
    """The letter by which byte-level files spell each byte: itself if it can be printed, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(0x100 + i) for i, b in enumerate(others)}}


class _Memo(dict):
    """Answers for pieces in two generations: a full one is kept until the next is full."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


class Pieces(NamedTuple):
    """Pre-tokens of a run of texts: distinct pieces, the piece of each place, the places of each text."""

    distinct: list
    codes: np.ndarray
    bounds: np.ndarray


LETTER, DIGIT, MARK, SPACE, BLANK, OTHER = range(6)


@lru_cache(1)
def _classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[0x30:0x3A] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:0xC0] = kind[0xC3:0xCA] = LETTER
    kind[[0x09, 0x0A, 0x0D]] = BLANK
    kind[0x20] = SPACE
    kind[0x27] = OTHER
    return kind


class Encoder:
    """Ids, counts or decoded text of whole texts for one tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.lower = self.tokenizer.normalizer is not None
        self.find = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall
        # The word file normalises a piece and marks its end; the byte file does neither.
        self.memo = _Memo(self._library if self.lower else self._model())

    def _library(self, piece: str) -> bytes:
        return np.array(self.raw(piece), "<u4").tobytes()

    def _model(self) -> Callable[[str], bytes]:
        """Ids of one pre-token straight from the model, without the library's passes over a whole text."""
        tokenize, spelling, pack = self.tokenizer.model.tokenize, _spelling(), struct.pack

        def ids(piece: str) -> bytes:
            tokens = tokenize(piece.encode().decode("latin-1").translate(spelling))
            return pack(f"<{len(tokens)}I", *[t.id for t in tokens])

        return ids

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def text_ids(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if ODD.search(text):
            return np.array(self.raw(text), "<u4")
        return np.frombuffer(b"".join([self.memo[p] for p in self.find(text.lower() if self.lower else text)]), "<u4")

    def pieces(self, texts: pa.Array) -> Pieces:
        """Cut texts into pre-tokens; a text of the third way is one piece, as bytes in a tuple."""
        data, offsets = text_buffer(texts)
        size, n = len(data), len(offsets) - 1
        kind = _classes()[data]
        after = np.append(data[1:], np.uint8(0)) if size else data
        bad = kind == OTHER
        lead = data >= 0xC3
        bad |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
        bad |= (data == 0xC4) & ((after == 0xB0) | (after == 0xB1))
        bad |= (data == 0xC9) & (after > 0x8F)
        bad |= (data == 0x3C) & (after == 0x7C)
        if self.lower:
            bad |= lead & (data > 0xC3)
            data = data.copy()
            data[(data >= 0x41) & (data <= 0x5A)] |= 0x20
            upper = np.flatnonzero((data == 0xC3) & (after >= 0x80) & (after <= 0x9E)) + 1
            data[upper[data[upper] != 0x97]] += 0x20
        flawed = np.zeros(n, bool)
        flawed[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
        cut = np.zeros(size + 1, bool)
        cut[offsets] = True
        starts, ends = self._cut_words(kind, cut) if self.lower else self._cut_bytes(kind, cut)
        if flawed.any():
            inside = np.repeat(flawed, np.diff(np.searchsorted(starts, offsets)))
            starts, ends = starts[~inside], ends[~inside]
        codes, uniques = pd.factorize(_hashes(data, starts, ends, False))
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        distinct: list = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        bounds = np.searchsorted(starts, offsets)
        if not flawed.any():
            return Pieces(distinct, codes, bounds)
        index, runs = {p: i for i, p in enumerate(distinct)}, []
        for i in range(n):
            if not flawed[i]:
                runs.append(codes[bounds[i] : bounds[i + 1]])
                continue
            text = texts[i].as_py() or ""
            odd = ODD.search(text)
            parts = [(text,)] if odd else self.find(text.lower() if self.lower else text)
            for p in parts:
                if p not in index:
                    index[p] = len(distinct)
                    distinct.append(p)
            runs.append(np.fromiter((index[p] for p in parts), np.int64, len(parts)))
        return Pieces(distinct, np.concatenate(runs), np.cumsum([0, *map(len, runs)]))

    @staticmethod
    def _cut_bytes(kind: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of one class; the last blank ahead of a run leaves its own run, a space joins the next."""
        size = len(kind)
        blank = (kind == SPACE) | (kind == BLANK)
        group = np.where(blank, SPACE, kind)
        start = cut.copy()
        start[1:size] |= group[1:] != group[:-1]
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~cut[1:size]) if size else np.zeros(0, np.int64)
        start[last] = True
        start[last[kind[last] == SPACE] + 1] = False
        at = np.flatnonzero(start[:size])
        return at, np.append(at[1:], size) if len(at) else at

    @staticmethod
    def _cut_words(kind: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters or marks and single digits; blanks go."""
        size = len(kind)
        start = cut.copy()
        start[1:size] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(start[:size])
        ends = np.append(at[1:], size) if len(at) else at
        solid = kind[at] < SPACE if len(at) else np.zeros(0, bool)
        return at[solid], ends[solid]

    def packed(self, piece: str | tuple[str]) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers."""
        return self._library(piece[0]) if isinstance(piece, tuple) else self.memo[piece]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins among them."""
        cut = self.pieces(texts)
        memo = self.memo
        parts = [memo[p] if isinstance(p, str) else self.packed(p) for p in cut.distinct]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool = np.frombuffer(b"".join(parts), "<u4")
        sizes = lengths[cut.codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        begin = (np.cumsum(lengths) - lengths)[cut.codes]
        at = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
        return pool[at], ends[cut.bounds]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        cut = self.pieces(texts)
        lengths = np.fromiter((len(self.packed(p)) for p in cut.distinct), np.int64, len(cut.distinct)) // 4
        ends = np.concatenate([[0], np.cumsum(lengths[cut.codes])])
        return np.diff(ends[cut.bounds])


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
