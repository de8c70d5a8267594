import random

import numpy as np
import pyarrow as pa
import pytest

from leafwise.llm.encoders import Encoder, tokenizer_path
from leafwise.llm.substring import pack_sorted, unpack_sorted
from leafwise.llm.words import SPAN, slices, windows_of, words_of


def test_words_are_those_of_split_and_never_cross_documents():
    texts = ["one two", "", None, " three\tfour\x0bfive ", "six", "x" * (SPAN + 5) + " end"]
    words = words_of(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    flat = [w for ws in want for w in ws]
    assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)] == flat
    assert words.counts.tolist() == [len(w) for w in want]
    again = words_of(pa.array(["end six " + "x" * (SPAN + 5), "SIX"]), lower=True)
    assert again.hashes[0] == words.hashes[-1] and again.hashes[1] == again.hashes[3] == words.hashes[5]
    assert again.hashes[2] == words.hashes[-2]


def test_windows_are_equal_where_words_are():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    words = words_of(pa.array(texts))
    found, at = windows_of(words, 4)
    seen, n = {}, 0
    for d, text in enumerate(texts):
        ws = text.split()
        for i in range(len(ws) - 3):
            assert at[n] == words.bounds[d] + i
            assert seen.setdefault(" ".join(ws[i : i + 4]), found[n]) == found[n]
            n += 1
    assert n == len(found) and len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "", "c"], "i": range(5)})
    parts = list(slices(batch, limit=20))
    assert len(parts) > 1 and [i for p in parts for i in p.column("i").to_pylist()] == list(range(5))
    assert list(slices(batch.slice(0, 0))) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_ids_of_the_library(name):
    encoder = Encoder(tokenizer_path(name))
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x250)] + ["€", "中", "é", "<|endoftext|>", "<|", "😀"]
    for _ in range(300):
        texts = [
            None if rng.random() < 0.05 else "".join(rng.choice(letters if rng.random() < odd else "abs  \n\t tLl1r.,É'") for _ in range(rng.randint(0, 25)))
            for odd in (0, 0, 0.01, 0.05, 0.3)
        ]
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
        assert encoder.counts(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]
        assert [encoder.text_ids(t or "").tolist() for t in texts] == want


def test_gap_code_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [254], [255], [256, 511], np.unique(rng.integers(0, 100_000, 500)), range(600)):
        values = np.array(list(values), np.int64)
        assert unpack_sorted(pack_sorted(values)).tolist() == values.tolist()
