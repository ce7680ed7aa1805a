"""Formatters and parsers of records: reference lists, BibTeX, labelled exports, diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: substrings of an error, in order, and what they mean
DIAGNOSES = (("timeout", "timeout"), ("timed out", "timeout"), ("connection", "network"), ("refused", "network"), ("401", "auth"), ("403", "auth"), ("unauthorized", "auth"), ("404", "not_found"), ("not found", "not_found"), ("429", "rate_limit"), ("memory", "resources"))
EXPORT_LABELS = ("Title", "Author", "Source", "Year", "Keyword", "Summary", "DOI", "PubTime", "Volume", "Period", "Page")


def reference_list(papers: DataFrame, by: str, order: list[str], most: int = 3) -> DataFrame:
    """by, refs: "[n] A, B, C, et al. Title. Year." lines in order, of papers (by, authors, title, year)."""
    names = F.when(F.size("authors") > most, F.concat(F.array_join(F.slice("authors", 1, most), ", "), F.lit(", et al."))).otherwise(F.array_join("authors", ", "))
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    line = F.format_string("[%d] %s. %s. %s.", "n", names, F.col("title"), F.when(F.col("year") > 0, F.col("year").cast("string")).otherwise("n.d."))
    rows = papers.withColumn("n", n).select(by, "n", line.alias("line"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x")).select(by, F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("refs"))


def bibtex(key: Column, title: Column, authors: Column, year: Column, doi: Column) -> Column:
    """An @article entry; empty fields are left out."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    fields = F.concat_ws(",\n", some("title", title), some("author", F.array_join(authors, " and ")), F.when(year > 0, F.concat(F.lit("  year = {"), year.cast("string"), F.lit("}"))), some("doi", doi))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), fields, F.lit("\n}"))


def export_fields(text: Column) -> Column:
    """Label to value of a labelled export, lines parted by <br> or line feeds; values keep their ';' lists."""
    clean = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    pairs = F.filter(F.transform(F.split(clean, "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"))), lambda p: F.regexp_replace(p["k"], r"-.*$", "").isin(*EXPORT_LABELS))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.when(F.map_contains_key(m, F.regexp_replace(p["k"], r"-.*$", "")), m).otherwise(F.map_concat(m, F.create_map(F.regexp_replace(p["k"], r"-.*$", ""), p["v"]))))


def count(raw: Column) -> Column:
    """The digits of a count as a number, 0 without any."""
    return F.coalesce(F.regexp_replace(raw, "[^0-9]", "").try_cast("bigint"), F.lit(0))


def as_list(value: Column) -> Column:
    """A JSON array of strings, else a comma-separated list; blanks dropped; null gives an empty list."""
    parts = F.coalesce(F.from_json(value, "array<string>"), F.split(value, ","))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def diagnosis(error: Column) -> Column:
    out = F.lit("unknown")
    for part, name in reversed(DIAGNOSES):
        out = F.when(F.lower(error).contains(part), name).otherwise(out)
    return out


def truncated(rows: Column, most: int = 15, chars: int = 300) -> Column:
    """The first texts of a list, each cut."""
    return F.transform(F.slice(rows, 1, most), lambda x: F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars), F.lit("…"))).otherwise(x))
