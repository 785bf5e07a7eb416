import base64
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from aqlens.llm import bpe, packing  # noqa: E402

RANKS = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_equals_tiktoken(spark, odd_docs, odd_rows, clash, tiktoken_encoding):
    ids = bpe.encode(clash(odd_docs), P.path(RANKS), P.PATTERN)
    out = bpe.decode(ids, P.path(RANKS), P.PATTERN).collect()
    want = sorted((str(r[0]), tiktoken_encoding.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows)
    assert sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in out) == want


def test_encode_mixed_stretches(tiktoken_encoding):
    encoder = bpe.Encoder(bpe.Vocabulary(open(P.path(RANKS), "rb").read(), P.PATTERN))
    bits = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "12", "'s", "'", "%%%", "日本", "\x1c", "\x85", "\xa0", "𝕏", "ABC", "\r\n", "=====", "-", "́"]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(rng.choice(bits, rng.integers(0, 30)))
        assert np.frombuffer(encoder.packed(text), np.int32).tolist() == tiktoken_encoding.encode_ordinary(text), repr(text)


def test_encode_empty_table(no_docs):
    assert bpe.encode(no_docs, P.path(RANKS), P.PATTERN).collect() == []


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 10)
    encoder = bpe.Encoder(bpe.Vocabulary(open(P.path(RANKS), "rb").read(), P.PATTERN))
    text = " ".join(f"word{i}x" for i in range(200))
    assert encoder.packed(text) == encoder.packed(text) and len(encoder.spaced) <= 10 and len(encoder.spaced.old) <= 10


def _expected_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for i, t, *_ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            out.append((str(i), k, at, len(cut), zlib.crc32(cut.tobytes())))
    return sorted(out)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(odd_docs, odd_rows, clash, capacity):
    out = packing.pack(clash(odd_docs), P.path("word_bpe_49k.json"), capacity, with_ids=True)
    rows = out.collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == _expected_pieces(odd_rows, capacity)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // capacity) + 1
    whole = {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    for r in rows:
        ids = bytes(whole[r["sequence_id"]]["ids"])[4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert zlib.crc32(ids) == r["ids_crc32"]


def test_packing_empty_table(no_docs):
    assert packing.pack(no_docs, P.path("word_bpe_49k.json")).collect() == []


def test_fullest_is_the_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(100):
        supply = [(int(k), int(rng.integers(1, 4))) for k in sorted(set(rng.integers(1, 40, 6).tolist()), reverse=True)]
        room = int(rng.integers(1, 90))
        sums = {0}
        for k, n in supply:
            sums = {s + k * c for s in sums for c in range(n + 1) if s + k * c <= room}
        chosen = packing.fullest(supply, room)
        assert sum(k * c for k, c in chosen) == max(sums)
        assert all(c <= dict(supply)[k] for k, c in chosen)


def test_special_strings_as_the_library_has_them(spark):
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", "word", "Wörd", " ", "\n", "<", "İ", "don't", "!!", "日本"]
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(bits, rng.integers(0, 12)))) for i in range(400)] + [(400, None), (401, "a<|endoftext|>b")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json"))
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect())
    assert got == _expected_pieces(rows, packing.CAPACITY)


def test_packed_ids_of_odd_batches():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    words, plain = packing._Words(Tokenizer.from_file(path)), Tokenizer.from_file(path)
    texts = [None, "", " ", "  lead", "trail \t", "a\x0bb\x0cc\x1cd", "x" * 300, "é" * 50 + " É", None, "A B a b"]
    for part in (texts, texts[:1], [], texts[3:7]):
        binary = pa.array([t.encode() if t is not None else None for t in part], pa.binary())
        want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, np.uint32).tobytes() for t in part]
        assert words.packed(binary) == want
        assert words.packed(pa.concat_arrays([pa.array([b"zero"], pa.binary()), binary]).slice(1)) == want
