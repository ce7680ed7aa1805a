"""Secret scans (operator 6): fixed base patterns, and password guess-cost for values in credential contexts.

Base kinds, leftmost and non-overlapping each: `assign` (a credential word, a separator and a value of 12 characters or
more), `access` (AKIA keys of 18 or more) and `hex` (runs of 16 or more). Matches that fail their length are dropped
after they have been consumed.

`guess`: a value in a credential context (CONTEXT, then SIGNED or BARE) whose cheapest segmentation still takes 10^LEAST
guesses or more. The segmentation is a dynamic program over the value's positions. A segment is a dictionary word in any
case or with common letter swaps (its rank, times its spellings), a date, a unit repeated as often as it goes or up to
SHY times less, a run of letters or digits in steps, a walk over neighbouring keys, or a brute-force span; the cost of a
password is the product of its segments' guesses times the factorial of their number, as an attacker does not know where
they meet. Costs are kept as logarithms. Words come from the vocabulary file of a public byte-level tokenizer, whose merge
order is an order of frequency; its path is a parameter.

The program goes forward from the value's start and drops what has reached 10^LEAST guesses, which no segment makes less;
so it is exact, and a value of any length costs a bounded number of steps beside looking for the ends of its repeats.

Defined results: a null or empty text has no spans; a null doc_id stays null; spans count code points, ends exclusive,
and are in order of start, then kind (of guesses that end together, the shortest); texts and values of any length are
scanned whole; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

KINDS = ("assign", "access", "hex", "guess")
# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run is matched whole, so asking for its least length at once drops what a match of any length would
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: Words after which a value may be a credential, alone or as a part of a name joined by underscores or hyphens.
CONTEXT = re.compile(r"(?i:(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|credentials?|auth|bearer|login|private[_-]?key)(?![A-Za-z0-9]))", re.ASCII)
_GAP, _VALUE = r"[\x20\t-\r]", r"""["']?([^\s"'<>,;]{6,})"""
_NAME = r"""(?:[_-][A-Za-z0-9]{1,24}){0,3}["']?"""
#: What may follow such a word: up to three plain words and a separator, or white space with up to three words of a list.
SIGNED = re.compile(rf"(?i:{_NAME}(?:{_GAP}{{1,40}}[A-Za-z]{{1,24}}){{0,3}}?(?:{_GAP}{{0,40}}[:=]{_GAP}{{0,40}}|{_GAP}{{1,40}}(?:is|was){_GAP}{{1,40}})){_VALUE}", re.ASCII)
BARE = re.compile(rf"(?i:{_NAME}(?:{_GAP}{{1,40}}(?:is|was|for|to|the|my|your)){{0,3}}{_GAP}{{1,40}}){_VALUE}", re.ASCII)
TRIM = ".?)]}"
#: Guesses, as a power of ten, that a credential takes at least.
LEAST = 10.0
#: A repeat may end this many units before it has to.
SHY = 3
#: Values up to this length are remembered with their verdict.
REMEMBERED = 64
# fixed values: rows of a keyboard, each key's neighbours being those beside it and above or below
KEY_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SWAPS = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d)")
COMMON = "password passwd secret admin welcome letmein monkey dragon master login token test guest root user default changeme hello love summer winter spring autumn".split()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def words(path: str) -> dict[str, int]:
    """Words of three letters or more, with their ranks: the common passwords first, then by merge order."""
    rank = {w: i + 1 for i, w in enumerate(COMMON)}
    with open(path, "rb") as lines:
        for line in lines:
            w = base64.b64decode(line.split()[0]).strip().lower()
            if len(w) >= 3 and w.isalpha() and w.isascii():
                rank.setdefault(w.decode(), len(rank) + 1)
    return rank


@cache
def longest_word(path: str) -> int:
    return max(map(len, words(path)), default=0)


@cache
def places() -> dict[str, tuple[int, int]]:
    return {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row) if c != " "}


def _alphabet(c: str) -> int:
    """The bit of a character's class: digits, lower case, upper case, all else."""
    return 1 if "0" <= c <= "9" else 2 if c.islower() else 4 if c.isupper() else 8


#: log10 of the number of characters in the classes of a set of bits.
BRUTE = [math.log10(max(1, 10 * (m & 1) + 26 * (m >> 1 & 1) + 26 * (m >> 2 & 1) + 33 * (m >> 3 & 1))) for m in range(16)]


def _brute(segment: str) -> float:
    """log10 of the guesses for a brute-force span: its alphabet to the power of its length."""
    m = 0
    for c in segment:
        m |= _alphabet(c)
    return len(segment) * BRUTE[m]


class Segments:
    """What a value can be cut into."""

    def __init__(self, value: str, rank: dict[str, int], longest: int):
        self.value, self.rank, self.longest = value, rank, longest
        low = value.lower()
        self.low = low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)
        self.plain = self.low.translate(SWAPS)
        self.runs: dict[int, tuple[int, int]] = {}

    def run(self, i: int, unit: int) -> int:
        """How many characters from i on equal those `unit` places further."""
        start, end = self.runs.get(unit, (0, 0))
        if start <= i < end:
            return end - i
        v, n, at, step = self.value, len(self.value), i, 1
        while step:
            if at + unit + step <= n and v[at : at + step] == v[at + unit : at + unit + step]:
                at, step = at + step, step * 2
            else:
                step //= 2
        self.runs[unit] = (i, at)
        return at - i

    def structured(self, i: int, limit: float) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses below limit) of the segments with structure that start at i."""
        value, low, n = self.value, self.low, len(self.value)
        for j in range(i + 3, min(n, i + self.longest) + 1):
            for form, extra in ((low[i:j], 0.0), (self.plain[i:j], 0.3)):
                if r := self.rank.get(form):
                    cased = value[i:j]
                    spell = 0.0 if cased == form or cased.islower() else 0.3 if cased.istitle() or cased.isupper() else 1.0
                    yield j, math.log10(r) + spell + extra
                    break
        if m := DATE.match(value, i):
            yield m.end(), math.log10(365 * 119 if m.end() - i > 4 else 119)
        # a unit said again and again
        for unit in range(1, (n - i) // 2 + 1):
            said = _brute(value[i : i + unit])
            if said >= limit:
                break
            most = 1 + self.run(i, unit) // unit
            for times in range(max(2, most - SHY), most + 1):
                if times * unit >= 3:
                    yield i + times * unit, said + math.log10(times)
        # steps of one size through letters or digits
        step = ord(value[i + 1]) - ord(value[i]) if i + 2 < n else 0
        if 0 < abs(step) <= 2 and value[i].isascii() and value[i].isalnum():
            j = i + 1
            while j < n and ord(value[j]) - ord(value[j - 1]) == step and value[j].isascii() and value[j].isalnum():
                j += 1
                if j - i >= 3:
                    yield j, math.log10((10 if value[i].isdigit() else 26) * 4 * (j - i))
        # a walk over neighbouring keys, costed by its turns
        key, j, turns, last = places(), i + 1, 1, None
        while j < n and (a := key.get(low[j - 1])) and (b := key.get(low[j])):
            way = (b[0] - a[0], b[1] - a[1])
            if way == (0, 0) or max(map(abs, way)) > 1:
                break
            turns += last is not None and way != last
            last, j = way, j + 1
            cost = math.log10(47 * (j - i)) + turns * math.log10(4.6)
            if cost >= limit:
                break
            if j - i >= 4:
                yield j, cost

    def brute(self, i: int, limit: float) -> Iterator[tuple[int, float]]:
        mask = 0
        for j in range(i + 1, len(self.value) + 1):
            mask |= _alphabet(self.value[j - 1])
            if (cost := (j - i) * BRUTE[mask]) >= limit:
                return
            yield j, cost


def guesses(value: str, rank: dict[str, int], longest: int, limit: float = LEAST) -> float:
    """log10 of the guesses that the cheapest segmentation takes, or limit where that is no less.

    A state is a number of segments at a position, with its least cost, and its least cost where the last segment isn't a
    brute-force span, as two of them in a row count as one. Positions without states are passed over."""
    n, parts = len(value), Segments(value, rank, longest)
    states: dict[int, dict[int, list[float]]] = {0: {0: [0.0, 0.0]}}
    ahead = [0]
    while ahead:
        i = heapq.heappop(ahead)
        here = states.pop(i)
        if i == n:
            return min(total + math.lgamma(k + 1) / math.log(10) for k, (total, _) in here.items())
        for clean, segments in ((False, parts.structured(i, limit)), (True, parts.brute(i, limit))):
            for j, cost in segments:
                for k, before in here.items():
                    total = before[clean] + cost
                    if total + math.lgamma(k + 2) / math.log(10) < limit:
                        if j not in states:
                            states[j] = {}
                            heapq.heappush(ahead, j)
                        slot = states[j].setdefault(k + 1, [math.inf, math.inf])
                        slot[0] = min(slot[0], total)
                        if not clean:
                            slot[1] = min(slot[1], total)
    return limit


@lru_cache(100_000)
def _remembered(value: str, path: str) -> bool:
    return guesses(value, words(path), longest_word(path)) >= LEAST


def costly(value: str, path: str) -> bool:
    return (_remembered if len(value) <= REMEMBERED else _remembered.__wrapped__)(value, path)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, path: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the costly values; of values that end together, the shortest."""
    out: dict[int, int] = {}
    closed = 0
    # the next context word is sought just after the last one, which may be what follows it
    for word in CONTEXT.finditer(text):
        if word.start() < closed:
            continue
        for after in (SIGNED, BARE):
            if m := after.match(text, word.end()):
                value = m[1].rstrip(TRIM)
                # words of prose too are costed: those of the dictionary are cheap
                if len(value) >= 6 and costly(value, path):
                    start, end = m.start(1), m.start(1) + len(value)
                    out[end] = max(start, out.get(end, 0))
                    if after is SIGNED:
                        closed = end
                        break
    return sorted((start, 3, end) for end, start in out.items())


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


common.forgets("secrets", _remembered.cache_clear, words.cache_clear)


def _scan(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    common.enter("secrets")
    for frame in common.chunks(frames):
        rows = []
        for name, text in zip(frame["doc_id"].tolist(), common.texts(frame), strict=True):
            base = base_spans(text)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            spans = sorted(base + guess_spans(text, path))
            rows.append((name, *n, hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans."""
    common.ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = named.mapInPandas(partial(_scan, path=vocab or vocabulary()), "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
