"""Splitting of texts by the pattern of the public byte-level vocabularies, and a bounded memo of encoded pieces."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: Pieces that a memo holds before its older half is forgotten.
MEMO_PIECES = 400_000


@cache
def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


@cache
def unsettled() -> re.Pattern:
    """Characters that this module's Unicode tables may class otherwise than the tokenizer libraries' do.

    They are those which Python's own, older tables don't know yet; text without them is split alike by all."""
    new = "".join(x for x in map(chr, range(0x530, sys.maxunicode + 1)) if unicodedata.category(x) == "Cn")
    spans: list[list[int]] = []
    for m in regex.finditer(r"[\p{L}\p{N}\s]+", new):
        for c in map(ord, m[0]):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]") if spans else re.compile(r"(?!)")


@cache
def stand_in(char: str) -> str:
    """A character of the class in which the tokenizer library itself holds char: letter, digit or other."""
    import public_tokenizers
    import tiktoken

    for stand, mark in (("é", "a"), ("²", "1")):
        # a vocabulary of the bytes and this one pair: the pair is one token only if the pattern keeps it together
        ids = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_chain(mark + char), special_tokens={}).encode_ordinary(mark + char)
        if len(ids) == 1:
            return stand
    return "§"


def _chain(word: str) -> dict[bytes, int]:
    """Ranks of all bytes and of all prefixes of word."""
    b = word.encode()
    out = {bytes([i]): i for i in range(256)}
    for n in range(2, len(b) + 1):
        out.setdefault(b[:n], len(out))
    return out


#: Letters of Latin text; with printable ASCII and its white space they need no Unicode tables.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ƿ"
BEYOND = re.compile(rf"[^\t-\r -~{LATIN}]")
PLAIN = re.compile(rf" ?[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    """The pattern's matches, in order; together they are the whole text."""
    if not BEYOND.search(text):
        return PLAIN.findall(text)
    if not unsettled().search(text):
        return pattern().findall(text)
    shown = unsettled().sub(lambda m: stand_in(m[0]), text)
    return [text[m.start() : m.end()] for m in pattern().finditer(shown)]


class Memo(dict):
    """Encoded pieces by piece; bounded, in two generations, so that frequent pieces stay.

    encode maps distinct pieces to their encodings."""

    def __init__(self, encode: Callable[[list[str]], dict], most: int = MEMO_PIECES):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def fill(self, pieces: Iterable[str]) -> None:
        """Makes all pieces, which are distinct, present until the next fill."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        missing = [x for x in pieces if x not in self]
        if missing and self.old:
            known = {x: y for x in missing if (y := self.old.get(x)) is not None}
            self.update(known)
            missing = [x for x in missing if x not in known]
        if missing:
            self.update(self.encode(missing))


def encode_texts(batch: list[str], memo: Memo) -> list[np.ndarray]:
    """The ids of each text, from memoised pieces: Arrow finds the distinct pieces, and only these are looked up."""
    pieces = [split(x) for x in batch]
    found = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
    distinct = found.dictionary.to_pylist()
    memo.fill(distinct)
    blobs = [memo[x] for x in distinct]
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    starts = np.cumsum(sizes) - sizes
    at = found.indices.to_numpy()
    n = sizes[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    ids = np.frombuffer(b"".join(blobs), "<u4")[np.repeat(starts[at] - (ends - n), n) + np.arange(total)]
    cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, pieces)])]
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
