"""Language identification by a linear-chain conditional random field over words.

A word's score for a language is the sum of the weights of its features: prefixes and suffixes of one to four
bytes, byte bigrams and trigrams with word ends, and the languages whose lexicon holds it. A learned matrix
scores the step from one word's language to the next. Forward-backward gives each word's
probability of each language; a document's language is the one with the largest share.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwise.llm.words import Words, mix, slices, tidy, words_of

BUCKETS = 1 << 17
UNKNOWN = "und"
DOCS_PER_LANG = 150  # labelled documents used for each language
MAX_BYTES = 1 << 16  # longer labelled documents are drawn last and cut to as many characters
MOST_KEYS = 100_000  # chosen texts whose keys are sent to all tasks (about 3 MB)
SPAN = 15  # mean words of a span in the code-switched training sequences
LEXICON_COUNT = 3  # times a word must be seen in a language to enter its lexicon
STEPS = 60
SMALL = 1e-30


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # feature bucket x language
    steps: np.ndarray  # language x language, log scores
    lexicon: tuple[np.ndarray, np.ndarray]  # sorted word hashes, language x word membership


class Features(NamedTuple):
    """Feature buckets of distinct words, and the word of each."""

    bucket: np.ndarray
    word: np.ndarray


def _lowered(words: Words) -> np.ndarray:
    data = words.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    return data


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Features:
    """Affixes and n-grams of words given as byte ranges of ``data``."""
    sizes = ends - starts
    n = len(sizes)
    word = np.arange(n)
    found, owner = [], []

    def add(key: np.ndarray, tag: int, words: np.ndarray) -> None:
        hashed = mix(key.astype(np.uint64) * np.uint64(64) + np.uint64(tag))
        found.append((hashed >> np.uint64(64 - 17)).astype(np.int32))
        owner.append(words.astype(np.int32))

    for k in range(1, 5):
        some = sizes >= k
        front, back = np.zeros(some.sum(), np.uint64), np.zeros(some.sum(), np.uint64)
        for j in range(k):
            front = front * np.uint64(256) + data[starts[some] + j]
            back = back * np.uint64(256) + data[ends[some] - k + j]
        add(front, k, word[some])
        add(back, 8 + k, word[some])
    # All bytes in a row with one zero byte on both sides of every word.
    total = sizes + 2
    begin = np.cumsum(total) - total
    flat = np.zeros(int(total.sum()) + 2, np.uint64)
    place = np.repeat(begin + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat[place] = data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
    own = np.repeat(word, total)
    inside = np.arange(len(own)) - np.repeat(begin, total)
    for k in (2, 3):
        at = np.flatnonzero(inside + k <= np.repeat(total, total))
        key = flat[at]
        for j in range(1, k):
            key = key * np.uint64(256) + flat[at + j]
        add(key, 16 + k, own[at])
    return Features(np.concatenate(found), np.concatenate(owner))


def _word_scores(feats: Features, n: int, weights: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(feats.word, weights[feats.bucket, k], n) for k in range(weights.shape[1])], axis=1)


def _lexical(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Lexicon membership of words as word x language; the first buckets hold the weights."""
    keys, member = model.lexicon
    if not len(keys):
        return np.zeros((len(hashes), len(model.langs)))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where((keys[at] == hashes)[:, None], member[:, at].T, 0.0)


def posteriors(
    scores: np.ndarray, bounds: np.ndarray, steps: np.ndarray, expect: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word's language, and with ``expect`` the expected steps over all documents.

    Documents run side by side, longest first, one word of each at a time.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, longest + 1), "left")
    move = np.exp(steps - steps.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    alpha = np.empty_like(local)
    for t in range(longest):
        at = first[: active[t]] + t
        now = local[at]
        if t:
            now = now * (alpha[at - 1] @ move)
        alpha[at] = now / (now.sum(axis=1, keepdims=True) + SMALL)
    gamma = alpha  # replaced from the last word back
    expected = np.zeros_like(steps)
    beta = np.ones((len(sizes), scores.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        if t + 1 < longest and active[t + 1]:
            m = active[t + 1]
            nxt = local[at[:m] + 1] * beta[:m]
            if expect:
                pair = alpha[at[:m]][:, :, None] * move * nxt[:, None, :]
                expected += (pair / (pair.sum(axis=(1, 2), keepdims=True) + SMALL)).sum(axis=0)
            back = nxt @ move.T
            beta[:m] = back / (back.sum(axis=1, keepdims=True) + SMALL)
        now = alpha[at] * beta[:n]
        gamma[at] = now / (now.sum(axis=1, keepdims=True) + SMALL)
    return gamma, expected


def draw(labelled: DataFrame, per_lang: int, seed: int) -> pd.DataFrame:
    """At most ``per_lang`` different texts of each language, the first by a hash of their content.

    Equal texts of a language count as one, so a group of copies fills one place. Texts over ``MAX_BYTES`` are
    drawn only where a language has too few others, and learned from up to that many characters. Keys are chosen without
    the texts; only the chosen texts are fetched.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("order"))
    keys = rows.groupBy("lang", "order").agg((F.min(F.octet_length("text")) > MAX_BYTES).alias("long"))
    first = Window.partitionBy("lang").orderBy("long", "order")
    chosen = keys.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_lang).select("lang", "order").collect()
    if not chosen:
        return pd.DataFrame({"lang": [], "text": []})
    wanted = labelled.sparkSession.createDataFrame(chosen, "lang string, order long")
    wanted = F.broadcast(wanted) if len(chosen) <= MOST_KEYS else wanted
    found = rows.join(wanted, ["lang", "order"]).groupBy("lang", "order").agg(F.min(F.substring("text", 1, MAX_BYTES)).alias("text"))
    return found.toPandas().sort_values(["lang", "order"], ignore_index=True)[["lang", "text"]]


def fit(labelled: DataFrame, per_lang: int = DOCS_PER_LANG, seed: int = 7) -> Model | None:
    """Learn from ``lang`` and ``text`` of labelled documents; None if there are none.

    Training uses a bounded sample: ``per_lang`` whole documents of each language. Their words are cut into spans
    and spans of all languages strung together, so the field learns steps between languages too.
    """
    sample = draw(labelled, per_lang, seed)
    if not len(sample):
        return None
    langs = sorted(sample["lang"].unique())
    words = words_of(pa.array(sample["text"]), lower=True)
    label = np.repeat(np.searchsorted(langs, sample["lang"]), words.counts)
    codes, uniques = pd.factorize(words.hashes)
    n = len(uniques)
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    feats = features(_lowered(words), words.starts[first], words.ends[first])
    seen = np.stack([np.bincount(codes[label == k], minlength=n) for k in range(len(langs))])
    # A word in hand is no evidence for its own lexicon: entries need more sightings than one.
    keep = np.flatnonzero((seen >= LEXICON_COUNT).any(axis=0))
    order = np.argsort(uniques[keep])
    lexicon = (uniques[keep][order], (seen[:, keep] >= LEXICON_COUNT)[:, order].astype(float))
    rng = np.random.default_rng(seed)
    cuts = np.flatnonzero((rng.random(len(codes)) < 1 / SPAN) | np.r_[True, label[1:] != label[:-1]])
    spans = rng.permutation(len(cuts))
    ends = np.append(cuts[1:], len(codes))
    at = np.concatenate([np.arange(cuts[s], ends[s]) for s in spans]) if len(spans) else np.zeros(0, np.int64)
    bounds = np.append(np.arange(0, len(at), 120), len(at))
    codes, label = codes[at], label[at]
    inner = np.ones(len(at), bool)
    inner[bounds[:-1]] = False
    steps_seen = np.zeros((len(langs), len(langs)))
    pos = np.flatnonzero(inner)
    np.add.at(steps_seen, (label[pos - 1], label[pos]), 1)
    weights, steps, lex = np.zeros((BUCKETS, len(langs))), np.zeros_like(steps_seen), np.zeros((len(langs), len(langs)))
    model = Model(langs, weights, steps, lexicon)
    member = _lexical(model, uniques)
    size = max(1, len(at))
    memory = [np.full(x.shape, 1e-8) for x in (weights, steps, lex)]
    gold = np.zeros((n, len(langs)))
    np.add.at(gold, (codes, label), 1)
    for _ in range(STEPS):
        by_word = _word_scores(feats, n, weights) + member @ lex
        gamma, expected = posteriors(by_word[codes], bounds, steps, expect=True)
        error = (gold - np.stack([np.bincount(codes, gamma[:, k], n) for k in range(len(langs))], axis=1)) / size
        slope = np.stack([np.bincount(feats.bucket, error[feats.word, k], BUCKETS) for k in range(len(langs))], axis=1)
        slopes = (slope - 1e-7 * weights, (steps_seen - expected) / size - 1e-6 * steps, member.T @ error - 1e-6 * lex)
        for x, g, m in zip((weights, steps, lex), slopes, memory, strict=True):
            m += g * g
            x += 0.25 * g / np.sqrt(m)
    return Model(langs, np.concatenate([lex, weights]).astype(np.float32), steps, lexicon)


def _scores(model: Model, words: Words) -> np.ndarray:
    k = len(model.langs)
    codes, uniques = pd.factorize(words.hashes)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    feats = features(_lowered(words), words.starts[first], words.ends[first])
    by_word = _word_scores(feats, len(uniques), model.weights[k:]) + _lexical(model, uniques) @ model.weights[:k]
    return by_word[codes]


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to ``docs``; with ``spans`` also the labelled runs of words.

    Only ``text`` enters a prediction. ``score`` is the predicted language's share of the letters-bearing words' probability.
    A text that is null or has no letter, and any text without a model, gets ``und`` and 0.0. ``spans`` holds
    structs ``lang, first, n`` in word order. Repeated rows get equal answers; an empty table gives an empty
    result; other columns stay, those named like a result are replaced.
    """
    added = ["lang_pred", "score", *(["spans"] if spans else [])]
    kept = [c for c in docs.columns if c not in added]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["lang_pred string", "score double"])
    schema += ", spans array<struct<lang:string,first:int,n:int>>" if spans else ""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets and lexicon of a bounded sample

    def label(batches):
        model = shared.value
        for batch in batches:
            for rows in slices(batch):
                pred, score, runs = _label(model, rows.column("text"), spans)
                columns = [rows.column(c) for c in kept] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    kind = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n", pa.int32())])
                    columns.append(pa.array(runs, pa.list_(kind)))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(tidy(label), schema)


def _label(model: Model | None, texts: pa.Array, spans: bool) -> tuple[list, np.ndarray, list]:
    n = len(texts)
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    words = words_of(texts, lower=True)
    letter = ((words.data | 0x20) >= 0x61) & ((words.data | 0x20) <= 0x7A)
    before = np.concatenate([[0], np.cumsum(letter)])
    ascii_letters = before[words.ends] > before[words.starts]
    high = np.concatenate([[0], np.cumsum(words.data >= 0xC3)])
    worded = ascii_letters | (high[words.ends] > high[words.starts])
    scores = _scores(model, words) * worded[:, None]
    gamma, _ = posteriors(scores, words.bounds, model.steps)
    doc = words.docs()
    mass = np.stack([np.bincount(doc, gamma[:, k] * worded, n) for k in range(len(model.langs))], axis=1)
    best = mass.argmax(axis=1)
    total = np.bincount(doc, worded, n)
    score = np.where(total > 0, mass[np.arange(n), best] / np.maximum(total, 1), 0.0).clip(0.0, 1.0)
    sure = np.bincount(doc, ascii_letters, n) > 0
    pred = []
    for i in range(n):
        known = sure[i] or (total[i] > 0 and any(c.isalpha() for c in texts[i].as_py() or ""))
        pred.append(model.langs[best[i]] if known else UNKNOWN)
        score[i] = score[i] if known else 0.0
    runs: list = []
    if spans:
        labels = gamma.argmax(axis=1)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            own = labels[a:b]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if b > a else np.zeros(0, np.int64)
            sizes = np.diff(np.append(cuts, b - a))
            runs.append([{"lang": model.langs[own[c]], "first": int(c), "n": int(m)} for c, m in zip(cuts, sizes, strict=True)])
    return pred, score, runs
