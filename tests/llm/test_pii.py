"""Operator 3 against a plain Feistel network."""

import datetime
import hashlib

import pytest
import regex as re
from pyspark.sql import functions as F
from tests.llm import fixtures

from quarry.llm import pii


KEY = "key of these tests"


def digest(kind, r, other, key=KEY):
    return hashlib.sha256(f"{key}\x1f{kind}\x1f{r}\x1f{other}".encode()).hexdigest()


def moved(part, h, letters=26):
    out = ""
    for i, c in enumerate(part):
        step = int(h[(i % 32) * 2 : (i % 32) * 2 + 2], 16)
        for first, size in (("0", 10), ("a", letters)):
            if first <= c <= chr(ord(first) + size - 1):
                c = chr((ord(c) - ord(first) + step) % size + ord(first))
                break
        out += c
    return out


def permuted(s, kind):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    letters = 6 if kind == "ipv6" else 26
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = moved(a, digest(kind, r, b), letters)
        else:
            b = moved(b, digest(kind, r, a), letters)
    return a + b


def lowered(v):
    return "".join(c.lower() if c.isascii() else c for c in v)


def cased(v, fresh):
    return "".join(f.upper() if "A" <= c <= "Z" else f for c, f in zip(v, fresh, strict=True))


def read_date(v):
    """The date and what writes another like it; None where it isn't one."""
    two = lambda x, like: f"{x:02}" if like[0] == "0" else str(x)
    full = lambda m, like: pii.MONTHS[m - 1] if like in pii.MONTHS else pii.MONTHS[m - 1][:3]
    month = lambda name: [m[:3] for m in pii.MONTHS].index(name[:3]) + 1
    try:
        if m := re.fullmatch(r"(\d{4})([-/])(\d\d)[-/](\d\d)", v):
            return datetime.date(int(m[1]), int(m[3]), int(m[4])), lambda d: f"{d.year}{m[2]}{d.month:02}{m[2]}{d.day:02}"
        if (m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})", v)) and int(m[2]) > 12:
            return datetime.date(int(m[3]), int(m[1]), int(m[2])), lambda d: f"{d.month:02}/{d.day:02}/{d.year}"
        if m := re.fullmatch(r"(\d\d)([./])(\d\d)([./])(\d{4})", v):
            return datetime.date(int(m[5]), int(m[3]), int(m[1])), lambda d: f"{d.day:02}{m[2]}{d.month:02}{m[4]}{d.year}"
        if m := re.fullmatch(r"(\d+) (\w+) (\d{4})", v):
            return datetime.date(int(m[3]), month(m[2]), int(m[1])), lambda d: f"{two(d.day, m[1])} {full(d.month, m[2])} {d.year}"
        m = re.fullmatch(r"(\w+) (\d+), (\d{4})", v)
        return datetime.date(int(m[3]), month(m[1]), int(m[2])), lambda d: f"{full(d.month, m[1])} {two(d.day, m[2])}, {d.year}"
    except ValueError:
        return None


def pair(a, b, sizes, kind):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + int(digest(kind, r, b)[:14], 16)) % sizes[0]
        else:
            b = (b + int(digest(kind, r, a)[:14], 16)) % sizes[1]
    return a, b


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(s[::-1])) % 10 == 0


def brute(text):
    """The text's pseudonyms, kind by kind; each place belongs to the first pattern that matches there."""

    def one(m):
        v = m[0]
        kind = next(k for k in pii.KINDS if re.match(f"(?:{pii.PATTERNS[k]})$", v))
        digits = re.sub("[^0-9]", "", v)
        lay = lambda f, keep: "".join(next(f) if re.match(keep, c) else c for c in v)
        if kind == "card":
            if not luhn(digits):
                return v
            body = permuted(digits[:-1], "card")
            check = next(str(c) for c in range(10) if luhn(body + str(c)))
            return lay(iter(body + check), "[0-9]")
        if kind == "email":
            end = v[v.rindex(".") :]
            return cased(v, permuted(lowered(v[: -len(end)]), "email") + lowered(end))
        if kind == "ip":
            o = list(map(int, v.split(".")))
            a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if kind == "date":
            found = read_date(v)
            if not found:
                return v
            n = (found[0] - datetime.date(1900, 1, 1)).days
            if not 0 <= n < pii.SIDES[0] * pii.SIDES[1]:
                return v
            a, b = pair(n // pii.SIDES[1], n % pii.SIDES[1], pii.SIDES, "date")
            return found[1](datetime.date(1900, 1, 1) + datetime.timedelta(days=a * pii.SIDES[1] + b))
        if kind == "ipv6":
            groups = len([g for g in v.split(":") if g])
            if not (re.search("[0-9]", v) and (groups == 8 or ("::" in v and 2 <= groups <= 7))):
                return v
            return cased(v, permuted(lowered(v), "ipv6"))
        if kind == "ssn":
            a, g, s = map(int, v.split("-"))
            if not (0 < a < 900 and a != 666 and g and s):
                return v
            x, y = pair((a - 1 - (a > 666)) * 99 + g - 1, s - 1, (898 * 99, 9999), "ssn")
            n = x // 99 + 1
            return f"{n + (n >= 666):03}-{x % 99 + 1:02}-{y + 1:04}"
        if kind == "phone":
            head = re.match(r"\+(?:1|[2-9][0-9]?)(?=[^0-9])|\+[0-9]|", v)[0]
            fresh = iter(permuted(re.sub("[^0-9]", "", v[len(head) :]), "phone"))
            return head + "".join(next(fresh) if c.isdigit() else c for c in v[len(head) :])
        code = v.replace(" ", "")
        rest = int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97
        if rest != 1:
            return v
        body = permuted(code[4:].lower(), "iban").upper()
        check = 98 - int("".join(str(int(c, 36)) for c in body + code[:2] + "00")) % 97
        return lay(iter(f"{code[:2]}{check:02}{body}"), "[A-Z0-9]")

    return re.sub(pii.ANY, one, text)


TEXTS = [
    "mail bob.smith99@mail9.example.com, or A_b@b.co. x a@b @c.de",
    "call +1 (469) 555-8958 4111111111111111 now, +44 20 7946 0958 and 555-123-4567",
    "4111 1111 1111 1111 and 4111-1111-1111-1111; bad 4111111111111112",
    "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432 but GB83WEST12345698765432",
    "ssn 123-45-6789 000-12-3456 667-01-0001 899-99-9999",
    "ip 10.0.0.1 and 42.144.35.254. 999.1.1.1 1.2.3.4.5",
    "born 1987-05-12, 31.02.1999 29.02.2000 12/11/2010 1900-01-01 2099-12-31",
    "12/31/1999 3 March 1984, 03 Mar 1984, March 3, 1984; Mar 03, 1984 31 June 1990 May 5, 2001 25/12/1990 12/13/2050x",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334 FE80::1 a::b std::x 1:2:3 2001:DB8::8:800:200C:417A 12:30:45 1::2:3:4:5:6:7:8",
    "Bob@Example.com bob@example.COM üser.Ä9@exämple.com",
    "+1 (234) 555-9999 378282246310005 23.45.67.8",
    "@" * 50 + "x@y.zz" + "1" * 500 + " " + "a.b" * 3000 + "@q." + "w." * 3000 + "com",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, t in rows:
        assert got[i].text == brute(t), t[:80]
    assert got[2].n_card == 2 and got[3].n_iban == 2 and got[4].n_ssn == 3 and got[6].n_date == 4


def test_formats_and_links(spark):
    got = pii.report(spark.createDataFrame([(1, TEXTS[2]), (2, "card 4111111111111111")], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    first, second = re.findall(r"[\d -]{16,}\d", got[0].text)[:2]
    bare = re.search(r"\d{16}", got[1].text)[0]
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) == bare and luhn(bare) and bare != "4111111111111111"


def test_distinct_stay_distinct(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("10.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("text"))
    assert pii.report(rows, KEY).select("text").distinct().count() == 3000


def test_edges(spark, tmp_path):
    rows = fixtures.edge_rows()
    got = pii.redact(fixtures.frame(spark, rows), KEY)
    assert got.columns == fixtures.COLUMNS
    assert sorted(map(str, got.collect())) == sorted(map(str, fixtures.frame(spark, rows).collect()))
    assert pii.op3_pii(spark, fixtures.save(spark, tmp_path / "a", [])).collect() == []
    assert pii.op3_pii(spark, fixtures.save(spark, tmp_path / "b", rows)).count() == len(rows)


def test_iban_before_a_word_and_dates_with_slashes(spark):
    rows = [(1, "AT611904300234573201 BIC"), (2, "BE68 5390 0754 7034 BIC"), (3, "born 1990/12/25."), (4, "XX 1990/02/30")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, start in ((1, "AT"), (2, "BE")):
        assert got[i].n_iban == 1 and got[i].text != rows[i - 1][1] and got[i].text.startswith(start) and got[i].text.endswith(" BIC")
        code = got[i].text[:-4].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    assert got[3].n_date == 1 and re.fullmatch(r"born \d{4}/\d\d/\d\d\.", got[3].text) and got[3].text != rows[2][1]
    assert got[4].text == rows[3][1]


def test_equal_values_in_other_forms_stay_linked(spark):
    rows = [(1, "Bob@Example.com 1984-03-03"), (2, "bob@example.COM 3 March 1984"), (3, "BOB@EXAMPLE.COM March 3, 1984")]
    got = [r.text.split(" ", 1) for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert len({m.lower() for m, _ in got}) == 1 and got[0][0].lower() != "bob@example.com"
    assert got[0][0][0].isupper() and got[1][0][0].islower() and got[2][0].isupper()
    day = datetime.date.fromisoformat(got[0][1])
    assert got[1][1] == f"{day.day} {pii.MONTHS[day.month - 1]} {day.year}"
    assert got[2][1] == f"{pii.MONTHS[day.month - 1]} {day.day}, {day.year}"


def test_keys(spark):
    """The session's key if there is one, else one that stays the same for the process; never an empty one."""
    a, b = pii.configured_key(spark), pii.configured_key(spark)
    assert a == b and len(a) == 64
    spark.conf.set(pii.KEY, "mine")
    assert pii.configured_key(spark) == "mine"
    spark.conf.unset(pii.KEY)
    assert pii.configured_key(spark) == a
    with pytest.raises(ValueError, match="key"):
        pii.redact(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")


def test_clashing_columns(spark):
    rows = [("mail bob@example.com", 5, "x")]
    got = pii.redact(spark.createDataFrame(rows, "text string, work int, work_ string"), KEY)
    assert got.columns == ["text", "work", "work_"] and got.first().work == 5 and got.first().work_ == "x"
