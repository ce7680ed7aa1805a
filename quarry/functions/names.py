"""Authors, citations and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK_NAME = r"^[\x{4e00}-\x{9fff}·]+$"


def surname(author: Column) -> Column:
    """The first character of a CJK name, what precedes a comma, the first word if the rest are initials, else the last word."""
    words = F.split(F.trim(author), r"\s+")
    comma = F.trim(F.substring_index(author, ",", 1))
    initials = F.trim(author).rlike(r"^\S+(?:\s+(?:[A-Z]\.?){1,3})+$")
    return F.when(F.trim(author).rlike(CJK_NAME), F.substring(F.trim(author), 1, 1)).when(author.contains(","), comma).when(initials, F.get(words, 0)).otherwise(F.element_at(words, -1))


def short_authors(authors: Column) -> Column:
    """One name, "A & B", or "A et al."; empty without any."""
    n = F.coalesce(F.size(authors), F.lit(0))
    a, b = F.get(authors, 0), F.get(authors, 1)
    return F.when(n <= 0, "").when(n == 1, a).when(n == 2, F.concat(a, F.lit(" & "), b)).otherwise(F.concat(a, F.lit(" et al.")))


def inline_citation(authors: Column, year: Column, page: Column) -> Column:
    """(Last, Year, p.N), (A & B, …) for two, (A et al., …) for more; n.d. without a year."""
    last = lambda i: F.element_at(F.split(F.get(authors, i), " "), -1)
    n = F.coalesce(F.size(authors), F.lit(0))
    who = F.when(n <= 0, "Unknown").when(n == 1, last(0)).when(n == 2, F.concat(last(0), F.lit(" & "), last(1))).otherwise(F.concat(last(0), F.lit(" et al.")))
    when = F.when(F.coalesce(year, F.lit(0)) > 0, year.cast("string")).otherwise("n.d.")
    where = F.when(F.coalesce(page, F.lit(0)) > 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise("")
    return F.concat(F.lit("("), who, F.lit(", "), when, where, F.lit(")"))


def merge_key(doi: Column, source: Column, source_id: Column, title: Column) -> Column:
    """doi:…, else source:id, else title:… (120 characters, lower case)."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(some(doi))), F.concat(source, F.lit(":"), some(source_id)), F.concat(F.lit("title:"), F.substring(F.lower(F.trim(title)), 1, 120)))


def identifier_kind(c: Column) -> Column:
    """bibtex, url, arxiv, doi, isbn or doi, in this order; bare arXiv ids and hyphenated ISBNs count too."""
    s = F.trim(c)
    bare = F.regexp_replace(s, "[- ]", "")
    return (
        F.when(s.rlike(r"^@\w+\s*\{"), "bibtex")
        .when(s.rlike(r"^https?://"), "url")
        .when(s.rlike(r"(?i)^(arxiv:)?[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$"), "arxiv")
        .when(s.rlike(r"^10\.[0-9]{4,9}/\S+$"), "doi")
        .when(bare.rlike(r"^(97[89])?[0-9]{9}[0-9Xx]$"), "isbn")
        .otherwise("doi")
    )


def doi_from_url(url: Column, html: Column) -> Column:
    """A DOI in the path, else one of three meta tags in the first 50 000 characters of the page, else null."""
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.substring(html, 1, 50_000)
    doi = r"(10\.[0-9]{4,9}/[^\s?#\"'<>]+)"
    tags = [rf"(?i)<meta[^>]+name=[\"'](?:citation_doi|dc\.identifier|prism\.doi)[\"'][^>]+content=[\"'](?:doi:)?{doi}"]
    return F.coalesce(some(F.regexp_extract(url, doi, 1)), *(some(F.regexp_extract(head, t, 1)) for t in tags))


def bibtex_fields(entry: Column) -> Column:
    """Lower-case field names to values of one BibTeX entry; empty values are dropped."""
    pattern = r"(\w+)\s*=\s*[{\"]([^{}\"]*)[}\"]"
    names = F.transform(F.regexp_extract_all(entry, F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(entry, F.lit(pattern), F.lit(2)), lambda x: F.trim(x))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: x["v"] != "")
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))


def stars(tier: Column) -> Column:
    return F.when(tier == "high", "★★★").when(tier == "medium", "★★").otherwise("★")


def iso_date(c: Column) -> Column:
    """Three ISO forms, read as UTC; null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))
