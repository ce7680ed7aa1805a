"""Operators 1, 4 and 8 against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tests.llm import fixtures
from tokenizers import Tokenizer

from quarry.llm import byte_bpe, pretokens, token_count, token_store


def samples(n=600):
    rng = random.Random(1)
    parts = ["a", "ab", " ", "  ", "é", "\n", "x" * 40, "ing", "th", "0", "12", "漢", "字", "'s", "!", "aaaa", "՘", "\U00010940", "\x1c", "　", "<|endoftext|>", "▁", "<s>", "🙂", "\t"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, "\n" * 900 + " " * 77, ""]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    v = np.random.default_rng(0).integers(0, 1 << bits, 777, dtype=np.uint32)
    assert (token_store.unpack(token_store.pack(v, bits), bits, len(v)) == v).all()
    b = token_store.Block(token_store.to_block([5, None, 9], [700, 0, 77], v, bits))
    assert b.doc_ids == [5, None, 9]
    assert (b.document(2) == v[700:]).all() and (b.ids(300, 400) == v[300:400]).all() and len(b.document(1)) == 0


def test_bits_for():
    assert [token_store.bits_for(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_library_ids(library):
    texts = samples()
    got = token_store.encode(token_store.vocabulary(), texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_tiktoken_ids(encoding):
    texts = samples()
    got = byte_bpe.encode(byte_bpe.vocabulary(), texts)
    vocab = byte_bpe.ranks(byte_bpe.vocabulary())
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()


def test_queue_takes_lowest_rank():
    rng = random.Random(3)
    q, want = byte_bpe.RankQueue(300_000), {}
    for i in range(500):
        r = rng.randrange(300_000)
        q.push(r, np.array([i]))
        want.setdefault(r, []).append(i)
    for r in sorted(want):
        rank, at = q.pop()
        assert (rank, at.tolist()) == (r, want[r])
    assert q.pop() is None


def test_whole_tokens():
    c = token_count.counter(token_count.vocabulary())
    assert c.cuts and len(c.whole) > 20_000
    texts = samples()
    model = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary())
    assert c.count(texts) == [len(model.encode(x)) for x in texts]


def test_memo_forgets_rarely():
    m = pretokens.Memo(lambda x: {y: y.encode() for y in x}, most=3)
    for i in range(10):
        m.fill(["hot", f"x{i}"])
        assert m["hot"] == b"hot" and m[f"x{i}"] == f"x{i}".encode()
    assert len(m) <= 5


def expected(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_store_query(spark, tmp_path, library):
    rows = fixtures.edge_rows()
    d = fixtures.save(spark, tmp_path / "in", rows)
    got = {(r.start): r for r in token_store.op1_token_store(spark, d).collect()}
    at = 0
    for r in expected(rows):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        g = got[at]
        assert (g.doc_id, g.n_tokens) == (r[0], len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(got) == len(rows)


def test_store_some_documents(spark, tmp_path, library):
    docs = fixtures.frame(spark, fixtures.edge_rows())
    token_store.write_tokens(docs, f"file://{tmp_path}/store")
    got = token_store.read_ids(spark, f"file://{tmp_path}/store", [8]).collect()
    assert [r.ids[:-1] for r in got] == [library.encode(fixtures.edge_rows()[7][1], add_special_tokens=False).ids]


def test_count_query(spark, tmp_path):
    rows = fixtures.edge_rows()
    d = fixtures.save(spark, tmp_path / "in", rows)
    model = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary())
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in rows), key=str)
    assert sorted((tuple(r) for r in token_count.op4_token_count(spark, d).collect()), key=str) == want


def test_bpe_query(spark, tmp_path, encoding):
    rows = fixtures.edge_rows()
    d = fixtures.save(spark, tmp_path / "in", rows)
    want = []
    for r in rows:
        ids = np.array(encoding.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.op8_byte_bpe(spark, d).collect()), key=str) == sorted(want, key=str)


def test_decode_docs(spark):
    docs = fixtures.frame(spark, fixtures.edge_rows())
    back = byte_bpe.decode_docs(byte_bpe.encode_docs(docs)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in fixtures.edge_rows())


@pytest.mark.parametrize("query", [token_store.op1_token_store, token_count.op4_token_count, byte_bpe.op8_byte_bpe])
def test_empty(spark, tmp_path, query):
    assert query(spark, fixtures.save(spark, tmp_path / "in", [])).collect() == []
