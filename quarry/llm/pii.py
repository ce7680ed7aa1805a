"""Format-preserving pseudonyms for personal data (operator 3), in DataFrame functions alone.

Kinds: e-mail addresses, payment cards (Luhn), IBANs (mod 97), US social security numbers (valid areas, groups and
serials), IPv4 and IPv6 addresses, telephone numbers, and calendar dates from 1900 to 2099-12-30 as yyyy-mm-dd, yyyy/mm/dd,
day first, month first (where the day is above 12) or with the month's English name. A value that fails its kind's
validation stays as it is. A valid one is permuted within its format by a keyed Feistel network of ROUNDS rounds, so its
length, separators and letter case stay, check digits are valid again, dates are dates, and equal values have equal
pseudonyms in all documents; with the key the permutation can be undone. Addresses are equal in any letter case, and dates
in any of the forms; a month-first date whose new day is below 13 has to be known as such to be undone, and a month's
name and one-digit days may change a date's length.

The key is an argument. `configured_key` takes it from the session's spark.quarry.pii.key, which links the runs that
share it; where it is unset, a random one is drawn for the application, so that nobody can undo its pseudonyms.

The round function is SHA-256 of key, kind, round and the other half. Strings are halved, and each letter or digit of one
half moves within its own class (digits, letters; in IPv6 digits, a to f) by the round's bytes. Addresses are two 16-bit halves;
numbers with other ranges, dates among them, add modulo the range of each half.

A text without a match is passed through; otherwise it is split at its matches and put together again with their
pseudonyms, so texts of any length are read whole. Card and social security numbers are recognised with their usual
separators, and equal digits give equal pseudonym digits whatever the separators.

Defined results: a null text stays null with counts of 0, an empty one empty; other columns stay as they are, whatever
their names (counts are added only by `report`); repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

ROUNDS = 6
#: Lengths of IBANs by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: IBANs of their country's length; others may have any, and take what is behind them if it looks alike.
IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in LENGTHS.items())
#: The setting that holds the key.
KEY = "spark.quarry.pii.key"

# fixed values: the patterns, in the order in which they are tried at a place; loops without a bound are possessive, so
# that Java runs them without recursion or second tries
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
_YEAR, _MM, _DD = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_DAY, _HEX = "(?:0?[1-9]|[12][0-9]|3[01])", "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "date": rf"(?<![A-Za-z0-9./-])(?:{_YEAR}-{_MM}-{_DD}|{_YEAR}/{_MM}/{_DD}|{_DD}[./]{_MM}[./]{_YEAR}|{_MM}/(?:1[3-9]|2[0-9]|3[01])/{_YEAR}|{_DAY} (?:{_MONTH}) {_YEAR}|(?:{_MONTH}) {_DAY}, {_YEAR})(?![A-Za-z0-9/-]|\.[0-9])",
    "ipv6": rf"(?<![A-Za-z0-9:.])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![A-Za-z0-9:]|\.[0-9])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})(?![A-Za-z0-9]|[.-][0-9])",
    "card": r"(?<![A-Za-z0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]|[.-][0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
DIGIT = "[^0-9]"
#: Days from 1900-01-01 to 2099-12-30 are 184 * 397, so a date is a pair of numbers below these; one day later stays.
FIRST_DAY, SIDES = "1900-01-01", (184, 397)
#: The ranges of the two halves of kinds that are numbers: area and group, and serial; two pairs of octets; a day.
RANGES = {"ssn": (898 * 99, 9999), "ip": (65536, 65536), "date": SIDES}
#: The last label of an address's domain, which stays.
TOP = r"\.[\p{L}\p{N}-]+$"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def _moved(part: Column, digest: Column, letters: Column) -> Column:
    """part with each lower-case letter, of the first `letters`, and digit moved within its class by the digest's bytes."""

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(first: str, size: Column) -> Column:
            return F.chr((F.ascii(c) - ord(first) + step) % size + ord(first))

        return F.when(c.between("0", "9"), within("0", F.lit(10))).when(c.between("a", "z"), within("a", letters)).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def laid(value: Column, fresh: Column, pattern: str) -> Column:
    """value with its characters outside `pattern` (a negated class) replaced, in order, by those of fresh."""
    place = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), pattern, ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(pattern), c).otherwise(F.substr(fresh, place(i), F.lit(1)))), "")


def cased(value: Column, fresh: Column) -> Column:
    """fresh with the letters in upper case that are so in value."""
    return F.array_join(F.zip_with(F.split(value, ""), F.split(fresh, ""), lambda v, c: F.when(v.between("A", "Z"), F.upper(c)).otherwise(c)), "")


def lowered(value: Column) -> Column:
    """A to Z in lower case; other letters stay, as their forms may differ in length."""
    return F.translate(value, UPPER, LOWER)


def date_form(v: Column) -> Column:
    """The date pattern of a match."""
    full = "|".join(MONTHS)
    forms = {
        "yyyy-MM-dd": "^[0-9]{4}-",
        "yyyy/MM/dd": "^[0-9]{4}/",
        "MM/dd/yyyy": "^[0-9]{2}/(?:1[3-9]|2|3)",
        "dd/MM/yyyy": "^[0-9]{2}/[0-9]{2}/",
        "dd.MM/yyyy": r"^[0-9]{2}\.[0-9]{2}/",
        "dd/MM.yyyy": r"^[0-9]{2}/[0-9]{2}\.",
        "dd.MM.yyyy": r"^[0-9]{2}\.",
        "dd MMMM yyyy": f"^0[1-9] (?:{full}) ",
        "d MMMM yyyy": f"^[0-9]{{1,2}} (?:{full}) ",
        "dd MMM yyyy": "^0[1-9] ",
        "d MMM yyyy": "^[0-9]{1,2} ",
        "MMMM dd, yyyy": f"^(?:{full}) 0[1-9],",
        "MMMM d, yyyy": f"^(?:{full}) ",
        "MMM dd, yyyy": "^[A-Z][a-z]{2} 0[1-9],",
        "MMM d, yyyy": "^[A-Z]",
    }
    return F.coalesce(*(F.when(v.rlike(p), F.lit(f)) for f, p in forms.items()))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last one a check digit."""
    doubled = lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*(F.lit((2 * k) // 10 + (2 * k) % 10) for k in range(10))), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x)


def _mod97(code: Column) -> Column:
    """An IBAN's remainder: the first four characters last, letters as two digits."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def kind_of(v: Column) -> Column:
    """The kind of a match: the first whose pattern it is, whole."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _by_kind(x: Column, **of: Column) -> Column:
    return F.coalesce(*(F.when(x["kind"] == k, c) for k, c in of.items()))


# Each step below turns an element of the working column, one match, into the next; as steps of their own columns they
# stay flat, where nesting them would take the analyzer a pass for each level.


def _named(v: Column) -> Column:
    return F.struct(v.alias("v"), kind_of(v).alias("kind"))


def _bare(x: Column) -> Column:
    """Without separators (s), and what comes before the part that is permuted (head)."""
    v = x["v"]
    digits = F.regexp_replace(v, DIGIT, "")
    day = F.try_to_timestamp(v, date_form(v)).cast("date")
    s = _by_kind(x, email=lowered(v), phone=v, card=digits, iban=F.regexp_replace(v, " ", ""), ssn=v, ip=v, ipv6=lowered(v), date=F.datediff(day, F.to_date(F.lit(FIRST_DAY))).cast("string"))
    head = _by_kind(x, phone=F.regexp_extract(v, r"^\+(?:1|[2-9][0-9]?)(?=[^0-9])|^\+[0-9]", 0))
    return F.struct(v.alias("v"), x["kind"].alias("kind"), s.alias("s"), F.coalesce(head, F.lit("")).alias("head"))


def _checked(x: Column) -> Column:
    """The permuted part (body), null where the value isn't valid."""
    s = x["s"]
    area, group, serial = (F.get(F.split(s, "-"), k).cast("int") for k in range(3))
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != ""))
    body = _by_kind(
        x,
        email=F.substr(s, F.lit(1), F.length(s) - F.length(F.regexp_extract(s, TOP, 0))),
        phone=F.regexp_replace(F.substr(s, F.length(x["head"]) + 1), DIGIT, ""),
        card=F.when(_luhn(s) % 10 == 0, F.substr(s, F.lit(1), F.length(s) - 1)),
        iban=F.when(_mod97(s) == 1, F.substr(F.translate(s, UPPER, LOWER), F.lit(5))),
        ssn=F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), s),
        ip=s,
        # eight groups, or fewer with a gap; a digit, since words may look like the rest
        ipv6=F.when(s.rlike("[0-9]") & ((groups == 8) | (s.contains("::") & groups.between(2, 7))), s),
        date=F.when(s.cast("int").between(0, SIDES[0] * SIDES[1] - 1), s),
    )
    return F.struct(x["v"].alias("v"), x["kind"].alias("kind"), s.alias("s"), x["head"].alias("head"), body.alias("body"))


def _halved(x: Column) -> Column:
    body = x["body"]
    half = F.floor(F.length(body) / 2).cast("int")
    part = lambda mark, k: F.get(F.split(body, mark), k).cast("long")
    # areas are 1 to 899 without 666
    area = part("-", 0)
    a = _by_kind(x, ssn=(area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + part("-", 1) - 1, ip=part(r"\.", 0) * 256 + part(r"\.", 1), date=F.floor(body.cast("long") / SIDES[1]))
    b = _by_kind(x, ssn=part("-", 2) - 1, ip=part(r"\.", 2) * 256 + part(r"\.", 3), date=body.cast("long") % SIDES[1])
    number = x["kind"].isin(*RANGES)
    a = F.when(number, a.cast("string")).otherwise(F.substr(body, F.lit(1), half))
    b = F.when(number, b.cast("string")).otherwise(F.substr(body, half + 1))
    return F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["s"].alias("s"), x["head"].alias("head"), a.alias("a"), b.alias("b"))


def _round(x: Column, key: str, r: int) -> Column:
    """One round: a half moves by the digest of the other. Numbers add modulo their range, strings move by classes."""
    own, other = ("a", "b") if r % 2 == 0 else ("b", "a")
    digest = F.sha2(F.concat(F.lit(f"{key}\x1f"), x["kind"], F.lit(f"\x1f{r}\x1f"), x[other]).cast("binary"), 256)
    side = _by_kind(x, **{k: F.lit(n[r % 2]) for k, n in RANGES.items()})
    added = ((x[own].cast("long") + _number(digest)) % side).cast("string")
    moved = F.when(x["kind"].isin(*RANGES), added).otherwise(_moved(x[own], digest, F.when(x["kind"] == "ipv6", 6).otherwise(26)))
    return F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["s"].alias("s"), x["head"].alias("head"), *((moved if h == own else x[h]).alias(h) for h in "ab"))


def _rounds(key: str, r: int) -> Callable[[Column], Column]:
    return lambda x: _round(x, key, r)


def _joined(x: Column) -> Column:
    """The permuted characters of strings, with new check digits; numbers stay as they are."""
    body, s = F.concat(x["a"], x["b"]), x["s"]
    country = F.substr(s, F.lit(1), F.lit(2))
    t = _by_kind(
        x,
        card=F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")),
        iban=F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), F.upper(body)))).cast("string"), 2, "0"), F.upper(body)),
        email=F.concat(body, F.regexp_extract(s, TOP, 0)),
        phone=body,
        ipv6=body,
    )
    return F.struct(x["v"].alias("v"), x["kind"].alias("kind"), x["head"].alias("head"), x["a"].cast("string").alias("a"), x["b"].alias("b"), t.alias("t"))


def _shown(x: Column) -> Column:
    """v and its pseudonym p, in its own format; v itself where it isn't valid."""
    v, number = x["v"], x["kind"].isin(*RANGES)
    a, b = (F.when(number, x[h]).cast("long") for h in "ab")
    area = F.floor(a / 99) + 1
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (a * SIDES[1] + b).cast("int"))
    rest = F.substr(v, F.length(x["head"]) + 1)
    p = _by_kind(
        x,
        card=laid(v, x["t"], DIGIT),
        iban=laid(v, x["t"], "[^A-Z0-9]"),
        email=cased(v, x["t"]),
        ipv6=cased(v, x["t"]),
        phone=F.concat(x["head"], laid(rest, x["t"], DIGIT)),
        ssn=F.format_string("%03d-%02d-%04d", area + F.when(area >= 666, 1).otherwise(0), a % 99 + 1, b + 1),
        ip=F.concat_ws(".", F.floor(a / 256), a % 256, F.floor(b / 256), b % 256),
        date=F.call_function("date_format", day, date_form(v)),
    )
    return F.struct(v.alias("v"), x["kind"].alias("kind"), F.when(x["a"].isNull(), v).otherwise(F.coalesce(p, v)).alias("p"))


_drawn = ""


def configured_key(spark: SparkSession) -> str:
    """The session's key; a random one, the same throughout this process, where none is set."""
    global _drawn
    key = spark.conf.get(KEY, "")
    if not key:
        key = _drawn = _drawn or secrets.token_hex(32)
    return key


def worked(docs: DataFrame, key: str, work: str) -> DataFrame:
    """docs with the working column: for each match v, its kind and its pseudonym p."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col("text")
    matched = F.coalesce(text.rlike("[@0-9]") & text.rlike(ANY), F.lit(False))
    found = F.when(matched, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    steps = [_named, _bare, _checked, _halved, *(_rounds(key, r) for r in range(ROUNDS)), _joined, _shown]
    out = docs.withColumn(work, found)
    for step in steps:
        out = out.withColumn(work, F.transform(work, step))
    return out


def rebuilt(work: str) -> Column:
    """The text with its matches replaced by their pseudonyms."""
    fresh = F.concat(F.transform(work, lambda x: x["p"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split("text", ANY, -1), fresh, lambda gap, p: F.concat(gap, p)), "")
    return F.when(F.size(work) > 0, whole).otherwise(F.col("text"))


def redact(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in `text`; all other columns as they are."""
    (work,) = common.unused(docs, "work")
    return worked(docs, key, work).withColumn("text", rebuilt(work)).drop(work)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the number of pseudonyms of each kind, and the text that holds them."""

    def count(kind: str) -> Column:
        return F.size(F.filter("work", lambda x: (x["kind"] == kind) & (x["v"] != x["p"]))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return worked(docs.select("doc_id", "text"), key, "work").select("doc_id", *counts, rebuilt("work").alias("text"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), configured_key(spark))
