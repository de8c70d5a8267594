import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from llm_helpers import clashing, docs, empty, frame, rows, rows_of  # noqa: F401

from leafwise.llm import orc_ids, packing, token_cache, tree_bpe
from leafwise.llm.encoders import Encoder, load, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def library(path, text):
    return load(path).encode(text or "", add_special_tokens=False).ids


# --- token cache ----------------------------------------------------------------------------------


def test_counts_and_cache_growth(spark, docs, rows, tmp_path):
    cache = str(tmp_path / "cache")
    got = dict(rows_of(token_cache.count_tokens(docs, WORD, cache).select("doc_id", "n_tokens")))
    assert got == {r[0]: len(library(WORD, r[1])) for r in rows}
    first = spark.read.parquet(cache).count()
    assert first == len({" ".join((r[1] or "").split()) for r in rows})
    more = frame(spark, [(1, "a new text"), (2, rows[0][1]), (3, f"  {rows[0][1]}\n")])
    counts = dict(rows_of(token_cache.count_tokens(more, WORD, cache).select("doc_id", "n_tokens")))
    assert counts == {1: 3, 2: got[0], 3: got[0]}
    assert spark.read.parquet(cache).count() == first + 1


def test_stored_counts_are_used_and_versions_kept_apart(spark, tmp_path):
    cache = str(tmp_path / "cache")
    digest = hashlib.sha256(b"some words").hexdigest()
    version = token_cache.version_digest(WORD)
    stored = spark.createDataFrame([(digest, version, 77), (digest, version, 77), (digest, "other", 5)], token_cache.CACHE_SCHEMA)
    stored.write.parquet(cache)
    docs = frame(spark, [(1, "some  words "), (1, "some words"), (2, "other")])
    assert sorted(rows_of(token_cache.count_tokens(docs, WORD, cache).select("doc_id", "n_tokens"))) == [(1, 77), (1, 77), (2, 1)]


def test_cache_edge_cases(spark, docs, tmp_path):
    assert token_cache.count_tokens(empty(spark), WORD, str(tmp_path / "a")).count() == 0
    out = token_cache.count_tokens(clashing(docs), WORD, str(tmp_path / "b"))
    assert out.columns.count("n_tokens") == 1 and out.count() == docs.count()


# --- tree concatenation ---------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_is_exact_wherever_it_cuts(path):
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice(["ab", "abcdefghij", "the quick brown'sre ll", "a's 1,.!\n", "éÉ中😀a b́ ", "aA<|endoftext|> "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        got = tree_bpe.encode_text(text, path, leaf=rng.choice([3, 10, 40]), window=rng.choice([1, 4, 16]))
        assert got.tolist() == library(path, text), text


def test_documents_by_tree(spark, docs, rows):
    coded = tree_bpe.with_digests(tree_bpe.encode_documents(docs, WORD, leaf=300))
    at_once = tree_bpe.encode_documents(docs, WORD, leaf=300, then=tree_bpe.digests, schema=tree_bpe.DIGESTS)
    assert sorted(rows_of(at_once)) == sorted(rows_of(coded))
    want = []
    for r in rows:
        ids = library(WORD, r[1])
        text = load(WORD).decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(rows_of(coded)) == sorted(want)
    twice = frame(spark, [(1, "ab <|endoftext|> cd " * 40)] * 2 + [(1, "other")])
    assert [len(r.ids) for r in tree_bpe.encode_documents(twice, WORD, leaf=50).collect()].count(len(library(WORD, "ab <|endoftext|> cd " * 40))) == 2
    assert tree_bpe.encode_documents(empty(spark), WORD).count() == 0
    assert tree_bpe.encode_documents(clashing(docs), WORD).count() == len(rows)


# --- byte encoder ---------------------------------------------------------------------------------


def test_byte_pieces_go_to_the_model_alone(monkeypatch):
    rng = random.Random(11)
    kinds = ["abcde ", "the quick'sre ll \n", "a1 2.,!\t\r\n  ", "éÉßıĕÿɏ¡¬® \xad", "<|#>~ ", "x'tve'' "]
    texts = ["", " ", "it's   two\n\n words", "¡", "¬®±ÿ", *("".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 200))) for _ in range(400))]
    plain = [t for t in texts if "<|" not in t and "\xad" not in t]
    want = [library(BYTE, t) for t in plain]
    whole = [library(BYTE, t) for t in texts]
    # Anything else, such as marks of special strings, still takes the library as a whole.
    ids, bounds = Encoder(BYTE).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole

    def unexpected(self, text):
        raise AssertionError(f"the whole library was called for {text!r}")

    monkeypatch.setattr(Encoder, "raw", unexpected)
    ids, bounds = Encoder(BYTE).encode(pa.array(plain))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


# --- ORC ------------------------------------------------------------------------------------------


def test_orc_round_trip_in_order(spark, docs, rows, tmp_path):
    path = str(tmp_path / "ids")
    orc_ids.write_ids(clashing(docs), path, BYTE, bytes_per_part=20_000)
    start, want = 0, []
    for doc_id, text, _ in sorted(rows):
        ids = [*library(BYTE, text), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows_of(orc_ids.with_crc32(orc_ids.read_ids(spark, path)))) == want
    files = sorted((tmp_path / "ids" / "ids").rglob("*.orc"))
    assert len(files) > 2
    held = [orc.ORCFile(f).read(columns=["doc_id"]).column(0).to_pylist() for f in files]
    assert [i for part in held for i in part] == [w[0] for w in want]


def test_orc_nulls_ties_and_empty_tables(spark, tmp_path):
    docs = frame(spark, [(None, "a b"), (3, None), (3, "x"), (3, "x"), (1, "")])
    orc_ids.write_ids(docs, str(tmp_path / "a"), BYTE)
    found = sorted(rows_of(orc_ids.read_ids(spark, str(tmp_path / "a")).select("start", "doc_id", "n_tokens")))
    assert found == [(0, None, 3), (3, 1, 1), (4, 3, 1), (5, 3, 2), (7, 3, 2)]
    orc_ids.write_ids(empty(spark), str(tmp_path / "b"), BYTE)
    assert orc_ids.with_crc32(orc_ids.read_ids(spark, str(tmp_path / "b"))).count() == 0


# --- packing --------------------------------------------------------------------------------------


def check_packing(found, size):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


@pytest.mark.parametrize("shard", [10, 50_000])
def test_packing_is_gapless_and_tight(spark, docs, rows, shard):
    found = packing.pack(packing.cut_pieces(docs, BYTE), shard=shard).collect()
    used = check_packing(found, packing.SEQUENCE)
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text, _ in rows:
        ids = np.array([*library(BYTE, text), 2], "<u4")
        mine = sorted(pieces[doc_id], key=lambda r: r.piece)
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert sum(r.length for r in mine) == len(ids) and all(r.length == packing.SEQUENCE for r in mine[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    bound = -(-sum(r.length for r in found) // packing.SEQUENCE)
    assert used <= bound + (1 if shard > 10 else 4)


def test_kernel_prefers_the_smallest_sum_of_squares():
    # Gaps 5, 5 and 6 are open. 3 leaves (2, 5, 6) with sum 3, or (5, 5, 3) with sum 5.
    bins, offsets, gaps = packing.sum_of_squares(np.array([15, 15, 14, 3]), 20)
    assert bins.tolist() == [0, 1, 2, 1] and offsets.tolist() == [0, 0, 0, 15] and gaps.tolist() == [5, 2, 6]
    # Gaps 5 and 7: both placements of 3 give a sum of 2, and the smaller gap wins.
    assert packing.sum_of_squares(np.array([15, 13, 3]), 20)[0].tolist() == [0, 1, 0]
    lengths = np.random.default_rng(1).integers(1, 100, 3000)
    bins, _, gaps = packing.sum_of_squares(lengths, 100)
    assert (np.bincount(bins, lengths) + gaps == 100).all()
    assert len(gaps) <= 1.01 * lengths.sum() / 100 + 1


def test_packing_edge_cases(spark):
    assert packing.pack(packing.cut_pieces(empty(spark), BYTE)).count() == 0
    found = packing.pack(packing.cut_pieces(clashing(frame(spark, [(1, None), (1, None), (None, "a")])), BYTE)).collect()
    assert check_packing(found, packing.SEQUENCE) == 1 and len(found) == 3
