"""Token counts (operator 4) by the whole-token shortcut.

Offline, from the model file alone, two things are proved. First, where a text can be cut: the pieces of the vocabulary
never hold the space mark after another character, nor a line feed, so no merge crosses the start of a run of spaces or
a line feed, and a text's count is the sum over its segments. Second, which segments are one token: each vocabulary
string is encoded alone by the library, and those that come back as a single piece enter a table. Counting then looks
segments up; only the rest are merged, by the library, each distinct segment once (a bounded memo).

If a vocabulary breaks the first rule, its texts are encoded whole instead.

Defined results: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; special strings
inside texts are ordinary text, as the library's default has it; equal rows give equal results; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, pretokens

MARK = "▁"
#: A run of spaces with what follows it up to the next one, or such a stretch after a line feed, or a line feed.
SEGMENT = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
LIMIT = 4096


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Token counts under one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        # cutting needs a model that leaves spaces as they are and starts each text with a mark
        as_is = model.encode("a  b ", out_type=str)
        self.cuts = "".join(as_is) == f"{MARK}a{MARK}{MARK}b{MARK}" and not any(MARK in x.lstrip(MARK) or "\n" in x for x in pieces)
        self.whole = self.prove(pieces) if self.cuts else {}
        self.memo = pretokens.Memo(lambda rest: dict(zip(rest, self.merge(rest), strict=True)))

    def merge(self, segments: list[str]) -> list[int]:
        """Tokens of each segment as it stands inside a text."""
        # a leading mark is what the library adds itself; any other segment stands after a line feed, which is
        # encoded with the mark in front of it, in as many tokens as a line feed alone has
        feed = len(self.model.encode("\n"))
        marked = [x[0] == " " or x[0] == MARK for x in segments]
        ids = self.model.encode([x[1:] if m else "\n" + x for x, m in zip(segments, marked, strict=True)], num_threads=1)
        # a segment of one mark alone leaves nothing for the library to add it to
        return [1 if len(x) == 1 and m else len(i) - (0 if m else feed) for x, m, i in zip(segments, marked, ids, strict=True)]

    def prove(self, pieces: list[str]) -> dict[str, int]:
        """The vocabulary strings that encode alone as one token."""
        found = {}
        for x, n in zip(pieces, self.merge(pieces), strict=True):
            if n == 1:
                found[x] = 1
                found[x.replace(MARK, " ")] = 1
        return found

    def count(self, batch: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(batch, num_threads=1)]
        segments = [SEGMENT.findall(" " + x) if x else [] for x in batch]
        whole, memo = self.whole, self.memo
        memo.fill(set().union(*segments) - whole.keys())
        get = whole.get
        return [sum([get(s) or memo[s] for s in x]) for x in segments]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


common.forgets("token_count", counter.cache_clear)


def _count(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    common.enter("token_count")
    for frame in common.chunks(frames):
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_bytes": frame["n_bytes"].to_numpy(), "n_tokens": counter(path).count(common.texts(frame))})


def count_tokens(docs: DataFrame, vocab: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text has more than `limit` tokens."""
    common.ship(docs.sparkSession)
    # doc_id travels as text: a long column with nulls would become floats
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = named.mapInPandas(partial(_count, path=vocab or vocabulary()), "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
