"""BPE encoding by tree concatenation, and decoding.

A long text is halved until the leaves are short; leaves are encoded in parallel as rows of their own, whatever
text they come from. Two neighbours are joined by encoding a window around the joint again, growing
until it shares a token with the left side and one with the right side: same id, same characters.
In a BPE code a run of tokens is the code of its text exactly if every two neighbours are the code of
theirs, and each pair of the joined run stands in one of three true codes, so the result is exact
wherever the cut fell, inside a word or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.encoders import encoder, load
from leafwise.llm.words import slices

LEAF = 16_384  # characters of a leaf
SLICE = 1 << 21  # bytes of text encoded at once
CODED = "doc_id long, ids array<int>, decoded string"
Finish = Callable[[pa.RecordBatch], pa.RecordBatch]
WINDOW = 48  # characters on either side of a joint, doubled until both sides agree


@lru_cache(4)
def _plain(path: str):
    """The tokenizer without normaliser and without special strings: what leaves are encoded by."""
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(4)
def _specials(path: str) -> tuple[regex.Pattern | None, dict[str, int]]:
    ids = {token.content: i for i, token in load(path).get_added_tokens_decoder().items()}
    ordered = sorted(ids, key=len, reverse=True)
    return (regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ids else None), ids


def segments(text: str, path: str) -> list[tuple[str, int]]:
    """The text in order as normalised stretches (id -1) and special strings with their ids."""
    pattern, ids = _specials(path)
    normaliser = load(path).normalizer
    out = []
    for part in pattern.split(text) if pattern else [text]:
        if part in ids:
            out.append((part, ids[part]))
        elif part:
            out.append((normaliser.normalize_str(part) if normaliser else part, -1))
    return out


def leaves(text: str, leaf: int) -> list[str]:
    """Halve until no part is longer than ``leaf``."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return leaves(text[:mid], leaf) + leaves(text[mid:], leaf)


Code = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, and where each token starts and ends


def encode_leaf(text: str, path: str) -> Code:
    found = _plain(path).encode(text, add_special_tokens=False)
    spans = np.array(found.offsets, np.int64).reshape(-1, 2)
    return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]


def _agree(a: Code, b: Code, last: bool) -> tuple[int, int] | None:
    """Places in ``a`` and ``b`` of a token they share: the first one, or the last one."""
    _, at_a, at_b = np.intersect1d(a[1] << 32 | a[2], b[1] << 32 | b[2], assume_unique=False, return_indices=True)
    same = np.flatnonzero((a[0][at_a] == b[0][at_b]) & (a[1][at_a] < a[2][at_a]))
    if not len(same):
        return None
    pick = same[-1 if last else 0]
    return int(at_a[pick]), int(at_b[pick])


def concatenate(text: str, left: Code, right: Code, joint: int, path: str, window: int = WINDOW) -> Code:
    """The code of ``text`` from those of ``text[:joint]`` and ``text[joint:]``."""
    right = (right[0], right[1] + joint, right[2] + joint)
    while True:
        low, high = max(0, joint - window), min(len(text), joint + window)
        ids, starts, ends = encode_leaf(text[low:high], path)
        middle = (ids, starts + low, ends + low)
        a = (0, 0) if low == 0 else _agree(_within(left, low, joint), middle, last=False)
        b = (0, len(ids)) if high == len(text) else _agree(_within(right, joint, high), middle, last=True)
        if a and b and (low == 0 or high == len(text) or a[1] < b[1]):
            keep_left = 0 if low == 0 else int(np.searchsorted(left[2], low, "right")) + a[0]
            keep_right = len(right[0]) if high == len(text) else int(np.searchsorted(right[2], joint, "right")) + b[0]
            return tuple(
                np.concatenate([x[:keep_left], y[a[1] : b[1]], z[keep_right:]])
                for x, y, z in zip(left, middle, right, strict=True)
            )
        window *= 2


def _within(code: Code, low: int, high: int) -> Code:
    """Tokens that end after ``low``; those are the ones a window from ``low`` to ``high`` can share."""
    at = int(np.searchsorted(code[2], low, "right"))
    to = int(np.searchsorted(code[1], high, "left"))
    return code[0][at:to], code[1][at:to], code[2][at:to]


def tree(texts: list[str], codes: list[Code], path: str, window: int = WINDOW) -> Code:
    """Join the codes of neighbouring leaves pair by pair, level by level."""
    while len(texts) > 1:
        joined_texts, joined = [], []
        for i in range(0, len(texts) - 1, 2):
            text = texts[i] + texts[i + 1]
            joined.append(concatenate(text, codes[i], codes[i + 1], len(texts[i]), path, window))
            joined_texts.append(text)
        if len(texts) % 2:
            joined_texts.append(texts[-1])
            joined.append(codes[-1])
        texts, codes = joined_texts, joined
    return codes[0]


def encode_text(text: str, path: str, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
    """Ids of one text by the tree, in this process."""
    out = [np.zeros(0, np.int64)]
    for part, special in segments(text, path):
        if special >= 0:
            out.append(np.array([special]))
        else:
            parts = leaves(part, leaf)
            out.append(tree(parts, [encode_leaf(p, path) for p in parts], path, window)[0])
    return np.concatenate(out)


def encode_documents(
    docs: DataFrame, tokenizer: str, leaf: int = LEAF, then: Finish | None = None, schema: str = CODED
) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every text, or what ``then`` makes of batches of these.

    Texts up to ``leaf`` characters are encoded where they are read. Longer ones become leaves, dealt over all
    tasks by (document, place), and meet again by document only as ids. Null texts count as empty;
    repeated rows give repeated results; other columns are ignored; no rows give no rows. ``then`` works where the
    ids are made, so that ids and texts which only it needs are not sent on; ``schema`` names its columns.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    long = F.char_length("text") > leaf
    finish = then or (lambda batch: batch)

    def whole(batches):
        code, tokens = encoder(tokenizer), _tokens(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, bounds = code.encode(part.column("text"))
                cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                decoded = [" ".join(tokens[ids[a:b]]) for a, b in cuts]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [part.column("doc_id"), lists, pa.array(decoded, pa.string())]
                yield finish(pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"]))

    short = rows.filter(~long).mapInArrow(whole, schema)
    return short.unionByName(_encode_long(rows.filter(long), tokenizer, leaf, finish, schema))


@lru_cache(4)
def _tokens(path: str) -> np.ndarray:
    """Token strings by id. Without a decoder in the file, decoding joins them by single spaces."""
    tokenizer = load(path)
    if tokenizer.decoder is not None:
        raise ValueError("decoding by joining tokens needs a file without a decoder")
    return np.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], object)


@lru_cache(1)
def _numbers() -> np.ndarray:
    """Decimal strings of all ids."""
    return np.array([str(i) for i in range(1 << 17)], object)


def _encode_long(rows: DataFrame, tokenizer: str, leaf: int, finish: Finish, schema: str) -> DataFrame:
    parts_schema = "row long, doc_id long, segment int, place int, special int, text string"

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = 0
                for segment, (text, special) in enumerate(segments(row["text"], tokenizer)):
                    out = []
                    for piece in [text] if special >= 0 else leaves(text, leaf):
                        out.append(
                            {k: row[k] for k in ("row", "doc_id")}
                            | {"segment": segment, "place": at, "special": special, "text": piece}
                        )
                        at += 1
                    yield pa.RecordBatch.from_pylist(out, schema=_arrow(parts_schema))

    def encode(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                packed = []
                for special, text in zip(part.column("special").to_pylist(), part.column("text"), strict=True):
                    one = (np.array([special]), np.zeros(1, np.int64), np.ones(1, np.int64))
                    packed.append(_packed(one if special >= 0 else encode_leaf(text.as_py(), tokenizer)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], [*part.schema.names, "code"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        segment, tokens = group.column("segment").to_numpy(), _tokens(tokenizer)
        cuts = np.append(np.flatnonzero(np.diff(segment, prepend=-1)), len(segment)).tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = group.slice(a, b - a)
            codes = [_unpacked(c.as_py()) for c in part.column("code")]
            out.append(tree(part.column("text").to_pylist(), codes, tokenizer)[0].astype(np.int32))
        ids = np.concatenate(out)
        decoded = pa.array([" ".join(tokens[ids])], pa.string())
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))
        row = pa.RecordBatch.from_arrays([pa.array(group.column("doc_id")[:1].to_pylist(), pa.int64()), lists, decoded], ["doc_id", "ids", "decoded"])
        return pa.Table.from_batches([finish(row)])

    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    parts = keyed.mapInArrow(split, parts_schema).repartition("row", "place")
    coded = parts.mapInArrow(encode, parts_schema + ", code binary")
    return coded.groupBy("row").applyInArrow(join, schema)


def _packed(code: Code) -> bytes:
    """Ids, steps between starts, and lengths as byte planes: the zero bytes of small numbers compress away."""
    ids, starts, ends = code
    flat = np.concatenate([ids, np.diff(starts, prepend=0), ends - starts]).astype("<i4")
    return np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> Code:
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    ids, steps, lengths = np.split(flat, 3)
    starts = np.cumsum(steps)
    return ids, starts, starts + lengths


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of a batch of encoded documents."""
    numbers, lists = _numbers(), batch.column("ids")
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].tolist()
    flat = lists.values.to_numpy(zero_copy_only=False)
    ids = [
        hashlib.sha256(" ".join(numbers[flat[a:b]]).encode()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)
    ]
    texts = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column("decoded")]
    columns = [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(ids), pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def with_digests(coded: DataFrame) -> DataFrame:
    """``digests`` of encoded documents."""
    return coded.mapInArrow(lambda batches: map(digests, batches), DIGESTS)
