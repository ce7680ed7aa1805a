"""Byte-level BPE encoding and decoding (operator 8) by a hierarchical-bitmap rank queue.

All pieces of a batch that the memo lacks are laid end to end as one linked list of byte positions. A bucket per merge
rank holds the positions whose pair has that rank; a three-level bitmap over the ranks gives the lowest occupied one by
find-first-set. A bucket's entries that have gone stale, because their pair has changed, are skipped. The rest merge
together, leftmost first within a piece: entries that overlap an earlier one wait, and where a merge would make a pair of
a lower rank than the one at hand, only that piece's first entry merges. A piece of any length takes steps by its merges,
not by rescans.

Defined results: a null text is empty (no ids); texts of any length are encoded whole; special strings are ordinary text.
Equal rows give equal results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, pretokens

NONE = np.int64(1 << 40)
#: Half the pieces of the other memos, since encoding by rounds over a batch is cheap.
MEMO_PIECES = 150_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class RankQueue:
    """Positions in a bucket for each rank, and three levels of 64-bit words that say which buckets hold any."""

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            rank, bit = rank >> 6, rank & 63
            before = level[rank]
            level[rank] = before | 1 << bit
            if before:
                break

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, x in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else (), np.split(positions, cuts), strict=False):
            self.push(rank, x)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest occupied rank and its entries, in order of position; None if all is empty."""
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            if not word:
                return None
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        held = self.buckets.pop(rank)
        return rank, np.unique(np.concatenate(held) if len(held) > 1 else held[0])


class Ranks:
    """A vocabulary of ranks: which pairs of tokens merge, and into what."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.rank.values()) + 1
        self.bytes = [b""] * self.size
        for b, r in self.rank.items():
            self.bytes[r] = b
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for b, r in self.rank.items():
            for i in range(1, len(b)):
                left, right = self.rank.get(b[:i]), self.rank.get(b[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge; a token of -1 is an end."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as bytes of little-endian unsigned 32-bit integers."""
        raw = [x.encode() for x in pieces]
        out: list[bytes] = [b""] * len(raw)
        rest = []
        for k, b in enumerate(raw):
            r = self.rank.get(b)
            if r is None:
                rest.append(k)
            else:
                out[k] = r.to_bytes(4, "little")
        if rest:
            for k, ids in zip(rest, self.merge([raw[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def merge(self, raw: list[bytes]) -> list[bytes]:
        sizes = np.array([len(b) for b in raw], np.int64)
        n = int(sizes.sum())
        owner = np.repeat(np.arange(len(raw)), sizes)
        token = np.concatenate((self.byte[np.frombuffer(b"".join(raw), np.uint8)], [-1]))  # at n: an end
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(sizes)[sizes > 0] - 1
        after[last], before[(last + 1)[:-1]], before[0] = n, n, n
        before = np.concatenate((before, [n]))
        after[n] = n
        pair = self.of(token[:n], token[after[:n]])
        queue = RankQueue(self.size)
        live = np.flatnonzero(pair < NONE)
        queue.push_all(pair[live], live)
        while (x := queue.pop()) is not None:
            rank, at = x
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # of entries that overlap in a row, each second one waits; it will be stale, its left half being gone
                joined = np.concatenate(([False], after[at[:-1]] == at[1:]))
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
                right = token[after[after[at]]]
                left = before[at]
                is_merged = np.zeros(len(at), bool)
                is_merged[1:] = after[after[at[:-1]]] == at[1:]
                left_token = np.where(is_merged, rank, token[left])
                merged = np.full(len(at), rank)
                early = np.minimum(self.of(left_token, merged), self.of(merged, right)) < rank
                if early.any():
                    who = owner[at]
                    first = np.concatenate(([True], who[1:] != who[:-1]))
                    wait = np.isin(who, who[early]) & ~first
                    if wait.any():
                        queue.push(rank, at[wait])
                        at = at[~wait]
            gone = after[at]
            token[at], token[gone], pair[gone] = rank, -1, NONE
            beyond = after[gone]
            after[at] = beyond
            real = beyond < n
            before[beyond[real]] = at[real]
            left = before[at]
            real = left < n
            touched = np.unique(np.concatenate((at, left[real])))
            fresh = self.of(token[touched], token[after[touched]])
            pair[touched] = fresh
            some = fresh < NONE
            if some.any():
                queue.push_all(fresh[some], touched[some])
        kept = np.flatnonzero(token[:n] >= 0)
        ids = token[kept].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner[kept], minlength=len(raw))) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


@cache
def _memo(path: str) -> pretokens.Memo:
    vocab = ranks(path)
    return pretokens.Memo(lambda pieces: dict(zip(pieces, vocab.encode(pieces), strict=True)), MEMO_PIECES)


common.forgets("byte_bpe", _memo.cache_clear)


def encode(path: str, batch: list[str]) -> list[np.ndarray]:
    """The ids of each text, each match of the pattern encoded separately."""
    return pretokens.encode_texts(batch, _memo(path))


def _digests(frames: Iterator[pd.DataFrame], path: str, with_ids: bool) -> Iterator[pd.DataFrame]:
    common.enter("byte_bpe")
    for frame in common.chunks(frames):
        ids = [x.astype("<u4").tobytes() for x in encode(path, common.texts(frame))]
        vocab = ranks(path)
        out = {
            "doc_id": frame["doc_id"].to_numpy(),
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(vocab.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids],
        }
        yield pd.DataFrame(out | {"ids": ids} if with_ids else out)


def digests(docs: DataFrame, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the bytes that they decode to, and the ids' bytes if asked for."""
    common.ship(docs.sparkSession)
    # doc_id travels as text: a long column with nulls would become floats
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    out = named.mapInPandas(partial(_digests, path=vocab or vocabulary(), with_ids=with_ids), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _ids(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    common.enter("byte_bpe")
    for frame in common.chunks(frames):
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "ids": [x.astype(np.int32) for x in encode(path, common.texts(frame))]})


def encode_docs(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id and the ids of its text (array<int>)."""
    common.ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = named.mapInPandas(partial(_ids, path=vocab or vocabulary()), "doc_id string, ids array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _texts(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    vocab = ranks(path)
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "text": [vocab.decode(np.asarray(x)).decode("utf-8", "replace") for x in frame["ids"]]})


def decode_docs(ids: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; bytes that are no UTF-8 become U+FFFD."""
    common.ship(ids.sparkSession)
    named = ids.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    out = named.mapInPandas(partial(_texts, path=vocab or vocabulary()), "doc_id string, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
