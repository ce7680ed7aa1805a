"""Text functions as column expressions. CJK is the range U+4E00 to U+9FFF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def tokens(c: Column) -> Column:
    """CJK unigrams, bigrams over the CJK characters alone (they bridge what lies between), then lower-case words of two ASCII letters or more. Repeats stay; null gives null."""
    cjk = F.filter(F.split(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""), ""), lambda x: x != "")
    pairs = let(cjk, lambda u: F.when(F.size(u) > 1, F.transform(F.slice(u, 1, F.size(u) - 1), lambda x, i: F.concat(x, F.get(u, i + 1)))).otherwise(F.array().cast("array<string>")))
    latin = F.regexp_extract_all(F.lower(c), F.lit("([a-z]{2,})"), F.lit(1))
    return F.when(c.rlike(CJK), F.concat(cjk, pairs, latin)).otherwise(latin)


def chunk_language(c: Column) -> Column:
    """zh above 0.6 CJK of CJK and Latin letters, en below 0.1 or without letters, else mixed."""
    z, a = F.regexp_count(c, F.lit(CJK)), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = z / (z + a)
    return F.when(z + a == 0, "en").when(share > 0.6, "zh").when(share < 0.1, "en").otherwise("mixed")


def query_language(c: Column) -> Column:
    """zh if CJK are above half of CJK and Latin letters, en if Latin are above 0.8 or there are none, else mixed."""
    z, a = F.regexp_count(c, F.lit(CJK)), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(z + a == 0, "en").when(z / (z + a) > 0.5, "zh").when(a / (z + a) > 0.8, "en").otherwise("mixed")


def is_chinese(c: Column) -> Column:
    """CJK characters above 0.3 of the length."""
    return F.coalesce(F.regexp_count(c, F.lit(CJK)) > 0.3 * F.length(c), F.lit(False))


def sentences(c: Column) -> Column:
    """Pieces after CJK terminators, or ASCII ones that white space follows; blank ones dropped."""
    return F.filter(F.split(c, r"(?<=[。！？；])|(?<=[.!?;])\s+"), lambda x: F.trim(x) != "")


def soft_wraps(c: Column) -> Column:
    """Joins Latin words hyphenated over a line end, and lines that break between CJK characters."""
    return F.regexp_replace(F.regexp_replace(c, r"([A-Za-z])-\n([a-z])", "$1$2"), rf"({CJK})\n({CJK})", "$1$2")


def parse_year(c: Column) -> Column:
    """The first run of four digits that stands alone, else 0."""
    alone = r"(?<![0-9A-Za-z_])([0-9]{4})(?![0-9A-Za-z_])"
    return F.coalesce(F.when(c.rlike(alone), F.regexp_extract(c, alone, 1).cast("int")), F.lit(0))


def loose_year(c: Column) -> Column:
    """The first 19xx or 20xx anywhere, else 0."""
    return F.coalesce(F.when(c.rlike("(19|20)[0-9]{2}"), F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1).cast("int")), F.lit(0))


def normalised_title(c: Column) -> Column:
    """Lower case with a-z, 0-9 and CJK kept; Latin accents are folded by a fixed table of the letters in use."""
    folded = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(folded, r"[^a-z0-9\x{4e00}-\x{9fff}]", "")


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_garbled(c: Column) -> Column:
    """20 characters or more, and above 0.4 of them neither printable ASCII, white space nor CJK."""
    odd = F.regexp_count(c, F.lit(r"[^\x20-\x7e\s\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"))
    return F.coalesce((F.length(c) >= 20) & (odd > 0.4 * F.length(c)), F.lit(False))


def snippet(c: Column, most: int = 300) -> Column:
    """At most `most` characters: cut after the last CJK terminator, else sentence end, else before a line feed, in the second half, else hard, with an ellipsis."""
    head = F.substring(c, 1, most)

    def last(pattern: str) -> Column:
        return F.length(F.regexp_extract(head, pattern, 0))

    ends = [last(r"(?s)^.*[。！？；]"), last(r"(?s)^.*[.!?](?=\s)"), last(r"(?s)^.*(?=\n)")]
    at = F.coalesce(*(F.when(e >= most // 2, e) for e in ends), F.lit(most))
    return F.when(F.length(c) <= most, c).otherwise(let(at, lambda n: F.concat(F.rtrim(F.substr(c, F.lit(1), n)), F.lit("…"))))


def stance_counts(c: Column, supporting: tuple[str, ...], opposing: tuple[str, ...], neutral: tuple[str, ...], stems: bool = False) -> Column:
    """struct(pos, neg, neu) of whole-word cue counts; with stems, words that begin with a cue count too."""
    end = r"\w*" if stems else ""
    count = lambda words: F.regexp_count(F.lower(c), F.lit(r"\b(?:" + "|".join(words) + ")" + end + r"\b"))
    return F.struct(count(supporting).alias("pos"), count(opposing).alias("neg"), count(neutral).alias("neu"))


def stance(counts: Column) -> Column:
    """A strict majority of cues, else neutral."""
    return F.when((counts["pos"] > counts["neg"]) & (counts["pos"] > counts["neu"]), "supporting").when((counts["neg"] > counts["pos"]) & (counts["neg"] > counts["neu"]), "opposing").otherwise("neutral")
