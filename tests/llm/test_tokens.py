"""Token files, packing and token counts against the tokenizers library, and exact round trips."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import crc

from wattsift.llm.packing import best_fit_decreasing, pack, padded_length
from wattsift.llm.token_blocks import encode_segment, read_range, read_token_blocks, write_token_blocks
from wattsift.llm.token_counts import count_tokens, document_lengths, flat_files, id_type
from wattsift.llm.tokens import BYTE_BPE, WORD_BPE, CachedEncoder, vocabulary


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name, byte_level", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_cached_encoder_is_the_library(name, byte_level, doc_rows, rows):
    odd = ["Don't, STOP.. é, É! ÀB, x&&&& y&& 3,5. a., 'S, ß. Σας. İx, <|endoftext|>.", "a\n\nb,\n c.", "\x01 a", "ªº. ²a, é, e̸= .,. ,a, $.", " a", "a ", " x  y"]
    texts, encode = odd + [t for _, t in doc_rows + rows], library(name)
    encoder = CachedEncoder(vocabulary(name), byte_level, cache_words=3000)
    got = [x for i in range(0, len(texts), 40) for x in encoder.encode(texts[i : i + 40])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 49_408, 1 << 32])
def test_blocks_round_trip(n, top):
    g = np.random.default_rng(n)
    ids = g.integers(0, top, n).astype(np.uint32)
    ids[g.random(n) < 0.03] = top - 1
    payload = encode_segment(ids)
    assert (read_range(payload) == ids).all()
    for a, b in ((0, 1), (n // 3, n // 2), (n - 1, n + 9)):
        assert (read_range(payload, max(0, a), b) == ids[max(0, a) : b]).all()


def test_outliers_are_exceptions():
    ids = np.full(1280, 5, np.uint32)
    ids[::64] = 4_000_000_000
    assert len(encode_segment(ids)) < 1280


@pytest.mark.parametrize("segment_ids, table", [(7, "edge"), (1 << 18, "edge"), (5000, "documents")])
def test_token_blocks(edge, rows, docs, doc_rows, segment_ids, table):
    edge, rows = (edge, rows) if table == "edge" else (docs, doc_rows)
    encode, at, want = library(WORD_BPE), 0, []
    tie = lambda t: int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        ids = [*encode(t), 1]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = read_token_blocks(write_token_blocks(edge, segment_ids=segment_ids)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_tables(empty):
    assert read_token_blocks(write_token_blocks(empty)).count() == pack(empty).count() == count_tokens(empty).count() == 0


@pytest.mark.parametrize("group, table", [(3, "edge"), (16_384, "edge"), (64, "documents")])
def test_packing(edge, rows, docs, doc_rows, group, table):
    edge, rows = (edge, rows) if table == "edge" else (docs, doc_rows)
    encode = library(BYTE_BPE)
    pieces = pack(edge, group=group, with_ids=True).collect()
    want = sorted((repr(i), tuple([*encode(t), 0])) for i, t in rows)
    if group > 100:
        assert len({p["sequence_id"] for p in pieces}) <= sum(len(t) for _, t in want) // 1024 + 2
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert len(p["ids"]) == p["length"] and crc(np.array(p["ids"], np.int64)) == p["ids_crc32"]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    documents = defaultdict(list)
    for p in pieces:
        documents[p["doc_id"], p["start"]].append(tuple(p["ids"]))
    for i in {i for i, _ in rows}:
        own = [ids for j, ids in want if j == repr(i)]
        for start in range(0, max(map(len, own)), 1024):
            assert sorted(documents[i, start]) == sorted(ids[start : start + 1024] for ids in own if len(ids) > start)


def test_best_fit_takes_the_tightest_window():
    sequence, offset = best_fit_decreasing(np.array([600, 900, 400, 124, 100]), 1024)
    assert sequence.tolist() == [1, 0, 1, 0, 2] and offset.tolist() == [0, 0, 600, 900, 0]
    lengths = np.random.default_rng(3).integers(1, 1024, 4000)
    assert np.bincount(best_fit_decreasing(lengths)[0], lengths).max() <= 1024
    assert best_fit_decreasing(lengths)[0].max() + 1 <= lengths.sum() / 1024 * 1.03 + 1
    assert [padded_length(n) for n in (1, 3, 512, 700, 1024)] == [1, 1024, 512, 1024, 1024]


@pytest.mark.parametrize("block_ids, table", [(5, "edge"), (1 << 18, "edge"), (1000, "documents")])
def test_token_counts(edge, rows, docs, doc_rows, block_ids, table):
    edge, rows = (edge, rows) if table == "edge" else (docs, doc_rows)
    encode = library(BYTE_BPE)
    want = sorted((repr(i), len(encode(t)) + 1) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in count_tokens(edge, block_ids=block_ids).collect()) == want


@pytest.mark.parametrize("end_id", [50_257, 70_000])
def test_separator_scan_of_raw_files(spark, tmp_path, end_id):
    lengths = np.random.default_rng(5).integers(1, 300, 200)
    ids = np.ones(lengths.sum(), id_type(end_id))
    ids[np.cumsum(lengths) - 1] = end_id
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    found = document_lengths(flat_files(spark, f"file://{tmp_path}/*.bin", end_id, block_ids=37), end_id).orderBy("ordinal").collect()
    assert [r["n_tokens"] for r in found] == lengths.tolist()


def test_an_end_id_that_texts_have_is_refused(edge):
    with pytest.raises(Exception, match="end id"):
        count_tokens(edge, end_id=300)


def test_token_counts_with_wide_ids(edge, rows):
    encode = library(BYTE_BPE)
    assert sorted(r["n_tokens"] for r in count_tokens(edge, end_id=1 << 20).collect()) == sorted(len(encode(t)) + 1 for _, t in rows)
