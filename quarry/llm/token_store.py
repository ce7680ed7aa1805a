"""Token-ID output (operator 1): ids in the vocabulary's fewest bits, in blocks with offsets.

A stored table is a Parquet folder of self-contained binary blocks, written by Spark's own committer, so lost
executors and retried tasks leave no partial file. A block holds whole documents:

    "QTB1", bits (u8), flags (u8, 0), pad (u16, 0), n_docs (u32), n_frames (u32), n_ids (u64)
    doc_ids     n_docs * i64        present  n_docs * u8 (0: the doc_id is null)
    offsets     (n_docs + 1) * u64  ids of the block before each document
    frames      n_frames * bits * u64: each frame holds 64 ids, id j at bit j * bits, lowest bits first

Frame f is at a fixed place, so any id is read without the ones before it, and numpy unpacks 64 lanes at once.
Columns beside the block: part (its range of doc_ids), block, first (ids of the part before it), n_docs, n_ids, least and
most (of its doc_ids, null without any). A reader of some documents skips the files and row groups that can't hold them.

Defined results: a null text is empty (the end id only); a null doc_id sorts first; rows with equal doc_ids are in
order of a hash of their texts, so that an id that a large part of the rows has is dealt over many parts; an empty table gives an empty store; other columns of the input are ignored. Texts of any length
are encoded whole. The vocabulary's special string inside a text is one special token, as the library's default has it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, pretokens

HEAD = struct.Struct("<4sBBHIIQ")
MAGIC = b"QTB1"
BLOCK_IDS = 1 << 19
#: Characters of text that are encoded at once.
CHUNK_CHARS = 8_000_000
BLOCKS_SCHEMA = "part int, block int, first long, n_docs long, n_ids long, bits int, least long, most long, payload binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bits_for(n: int) -> int:
    """The fewest bits that hold ids 0 to n - 1."""
    return max(1, (n - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Frames of 64 ids as rows of `bits` 64-bit words."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out


def unpack(frames: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of frames, as unsigned 32-bit integers."""
    out = np.empty((len(frames), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = frames[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (frames[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def to_block(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    frames = pack(ids, bits)
    present = np.array([x is not None and x == x for x in doc_ids], np.uint8)
    names = np.array([int(x) if p else 0 for x, p in zip(doc_ids, present, strict=True)], "<i8")
    offsets = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum(lengths, out=offsets[1:])
    head = HEAD.pack(MAGIC, bits, 0, 0, len(doc_ids), len(frames), len(ids))
    return b"".join((head, names.tobytes(), present.tobytes(), offsets.tobytes(), frames.tobytes()))


class Block:
    """A stored block; nothing is unpacked before it is asked for."""

    def __init__(self, payload: bytes):
        magic, self.bits, _, _, n, frames, self.n_ids = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        names = np.frombuffer(payload, "<i8", n, at)
        present = np.frombuffer(payload, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(x) if p else None for x, p in zip(names, present, strict=True)]
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.frames = np.frombuffer(payload, "<u8", frames * self.bits, at + 9 * n + 8 * (n + 1)).reshape(frames, self.bits)

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids first to end - 1 of the block; only their frames are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        a = first // 64
        return unpack(self.frames[a : -(-end // 64)], self.bits, end - 64 * a)[first - 64 * a :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def special(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in library(path).get_added_tokens_decoder().values())


def _encode(path: str, texts: list[str]) -> list[bytes]:
    return [struct.pack(f"<{len(x)}I", *x.ids) for x in library(path).encode_batch_fast(texts, add_special_tokens=False)]


#: Pieces that are given to the library as the lines of one text.
LINES = 96


@cache
def _feed(path: str) -> int | None:
    """The id of a line feed, if it is one token; as a piece of its own it then parts the pieces around it."""
    ids = library(path).encode("\n", add_special_tokens=False).ids
    return ids[0] if len(ids) == 1 else None


def _encode_pieces(path: str, pieces: list[str]) -> dict[str, bytes]:
    """The ids of each piece. Pieces without white space at their end are encoded as lines, which the pattern keeps apart."""
    feed = _feed(path)
    lined = [x for x in pieces if not x[-1].isspace()] if feed is not None else []
    found: dict[str, bytes] = {}
    joined = library(path).encode_batch_fast(["\n".join(lined[i : i + LINES]) for i in range(0, len(lined), LINES)], add_special_tokens=False)
    raw = [np.array(x.ids, "<u4") for x in joined]
    if raw:
        end = np.array([feed], "<u4")
        ids = np.concatenate([x for line in raw for x in (line, end)])
        cuts = (np.flatnonzero(ids == feed) * 4).tolist()
        flat = ids.tobytes()
        found = {x: flat[a:b] for x, a, b in zip(lined, [0, *(c + 4 for c in cuts[:-1])], cuts, strict=True)}
    rest = [x for x in pieces if x not in found] if len(found) < len(pieces) else []
    found.update(zip(rest, _encode(path, rest), strict=True))
    return found


@cache
def _memo(path: str) -> pretokens.Memo:
    return pretokens.Memo(partial(_encode_pieces, path))


common.forgets("token_store", _memo.cache_clear)


def encode(path: str, batch: list[str]) -> list[np.ndarray]:
    """The ids of each text. The library encodes each distinct piece once.

    A byte-level vocabulary never merges across the pieces of its pattern, so the ids of the pieces are the text's. Texts
    that hold a special token's string are given to the library whole."""
    marks = special(path)
    whole = [any(m in x for m in marks) for x in batch]
    out = pretokens.encode_texts(["" if w else x for x, w in zip(batch, whole, strict=True)], _memo(path))
    return [np.frombuffer(_encode(path, [x])[0], "<u4") if w else ids for x, w, ids in zip(batch, whole, out, strict=True)]


def _write(frames: Iterator[pd.DataFrame], path: str, end_id: int, bits: int) -> Iterator[pd.DataFrame]:
    common.enter("token_store")
    part, first, block, n_ids = TaskContext.get().partitionId(), 0, 0, 0
    tail = np.array([end_id], "<u4")
    names, lengths, held = [], [], []

    def out() -> pd.DataFrame:
        nonlocal first, block, n_ids
        ids = np.concatenate(held)
        known = [int(x) for x in names if x is not None and x == x]
        row = (part, block, first, len(names), len(ids), bits, min(known, default=None), max(known, default=None), to_block(names, lengths, ids, bits))
        first, block, n_ids = first + len(ids), block + 1, 0
        for x in (names, lengths, held):
            x.clear()
        return pd.DataFrame([row], columns=["part", "block", "first", "n_docs", "n_ids", "bits", "least", "most", "payload"])

    for frame in common.chunks(frames, most=CHUNK_CHARS):
        for name, ids in zip(frame["doc_id"].tolist(), encode(path, common.texts(frame)), strict=True):
            names.append(name)
            held += (ids, tail)
            lengths.append(len(ids) + 1)
            n_ids += lengths[-1]
            if n_ids >= BLOCK_IDS:
                yield out()
    if names:
        yield out()


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0) -> None:
    """Encodes docs (doc_id, text) and writes their blocks to path, in ascending doc_id order over the parts."""
    common.ship(docs.sparkSession)
    vocab = vocab or vocabulary()
    bits = bits_for(library(vocab).get_vocab_size(with_added_tokens=True))
    # the null flag: mapInPandas would turn a long column with nulls into floats
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("doc_id").alias("at"), F.xxhash64("text").alias("hash"))
    # rows that are alike in all are as good in any order
    ordered = named.repartitionByRange("at", "hash", F.rand(1)).sortWithinPartitions("at", "hash", "text").select("doc_id", "text")
    ordered.mapInPandas(partial(_write, path=vocab, end_id=end_id, bits=bits), BLOCKS_SCHEMA).write.parquet(path)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, first, payload in zip(frame["part"], frame["first"], frame["payload"], strict=True):
            b = Block(payload)
            ids, at = b.ids(), b.offsets
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(b.doc_ids, dtype="Int64"),
                    "part": np.full(len(b.doc_ids), part, np.int32),
                    "first": first + at[:-1],
                    "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)],
                }
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the unpacked blocks."""
    common.ship(spark)
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(path)
    # one row for each part, so no more rows than the write had tasks
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    bases = spark.createDataFrame(starts, "part int, base long")
    docs = blocks.select("part", "first", "payload").mapInPandas(_read, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


#: Ranges of doc_ids that a reader asks the files for.
RANGES = 64


def ranges(doc_ids: set[int]) -> list[tuple[int, int]]:
    """At most RANGES ranges that hold the ids, parted at the widest gaps."""
    ordered = sorted(doc_ids)
    gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])[: RANGES - 1]
    cuts = [0, *sorted(gaps), len(ordered)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def read_ids(spark: SparkSession, path: str, doc_ids: list[int | None] | None = None) -> DataFrame:
    """doc_id and its ids (array<int>), for all or some documents; of these only the blocks that may hold them are read, and
    only their own frames unpacked."""
    common.ship(spark)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(path)
    if wanted is not None:
        held = F.lit(False)
        for a, b in ranges({x for x in wanted if x is not None}):
            held = held | ((F.col("least") <= b) & (F.col("most") >= a))
        # a block with a null doc_id may have others too
        blocks = blocks.filter(held if None not in wanted else F.lit(True))

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for payload in frame["payload"]:
                b = Block(payload)
                keep = [k for k, x in enumerate(b.doc_ids) if wanted is None or x in wanted]
                yield pd.DataFrame({"doc_id": pd.array([b.doc_ids[k] for k in keep], dtype="Int64"), "ids": [b.document(k).astype(np.int32) for k in keep]})

    return blocks.select("payload").mapInPandas(ids, "doc_id long, ids array<int>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark)
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path)
