"""Sources: PDF pages through an injected parser, JSON settings, golden queries, traces, external records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = "trace_id string, ts string, query string, strategy string, success boolean, error string, latency_ms double, results array<struct<item_key: string, score: double, rank: int, source: string>>"
QRELS_SCHEMA = "queries array<struct<query_id: string, query_text: string, expected_item_keys: array<string>, category: string, difficulty: string, notes: string>>"


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], most: int | None = None) -> DataFrame:
    """item_key (the file's name), page_num from 1, text of each page that isn't blank. `parse` turns a file into page texts."""

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                key = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(key, i, x) for i, x in enumerate(parse(content)[:most], 1) if x.strip()]
            yield pd.DataFrame(rows, columns=["item_key", "page_num", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "item_key string, page_num int, text string")


def pdf_outline(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[int, str, int]]]) -> DataFrame:
    """item_key (the file's name), place from 0, level, title, page of each outline entry, as `parse` reads them."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                key = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(key, i, *x) for i, x in enumerate(parse(content))]
            yield pd.DataFrame(rows, columns=["item_key", "place", "level", "title", "page"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "item_key string, place int, level int, title string, page int")


def full_text(pages: DataFrame, most: int = 50) -> DataFrame:
    """item_key and its first pages under markers, with a note if there are more."""
    rows = pages.groupBy("item_key").agg(F.array_sort(F.collect_list(F.when(F.col("page_num") <= most, F.struct("page_num", "text")))).alias("p"), F.max("page_num").alias("last"))
    whole = F.array_join(F.transform("p", lambda x: F.concat(F.lit("--- page "), x["page_num"].cast("string"), F.lit(" ---\n"), x["text"])), "\n\n")
    return rows.select("item_key", F.when(F.col("last") > most, F.concat(whole, F.lit("\n\n[truncated]"))).otherwise(whole).alias("text"))


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id (Q000 and so on where there is none), query_text, expected, category, difficulty from a JSON file with `queries`."""
    q = spark.read.schema(QRELS_SCHEMA).option("multiLine", True).json(path).select(F.posexplode("queries").alias("i", "q"))
    return q.select(F.coalesce("q.query_id", F.format_string("Q%03d", "i")).alias("query_id"), "q.query_text", F.coalesce("q.expected_item_keys", F.array().cast("array<string>")).alias("expected"), "q.category", "q.difficulty")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, expansion from a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("term", "all"))
    return pairs.select("term", F.explode("all").alias("expansion"))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines trace; malformed lines are skipped, times that can't be read are null."""
    return spark.read.schema(TRACE_SCHEMA).option("mode", "DROPMALFORMED").json(path).withColumn("ts", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word to positions)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def title_matches(seeds: DataFrame, works: DataFrame, least: float = 0.6) -> DataFrame:
    """seed_id, work_id: works whose title has `least` of the seed title's distinct words (seed_id, title; work_id, title).

    Pairs meet on the seed's rarest words only: a match must have one of the first n - ceil(least n) + 1."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    s, w = seeds.select("seed_id", words("title").alias("ws")), works.select("work_id", words("title").alias("ww"))
    df = w.select(F.explode("ww").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = s.select("seed_id", "ws", F.explode("ws").alias("word")).join(df, "word", "left").groupBy("seed_id", "ws").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("r"))
    n = F.size("ws")
    first = ranked.select("seed_id", "ws", F.explode(F.slice("r", F.lit(1), (n - F.ceil(n * least) + 1).cast("int"))).alias("x")).select("seed_id", "ws", F.col("x.word").alias("word"))
    have = w.select("work_id", "ww", F.explode("ww").alias("word"))
    return first.join(have, "word").filter(F.size(F.array_intersect("ws", "ww")) >= least * F.size("ws")).select("seed_id", "work_id").distinct()


RECORD_SCHEMA = "id string, title string, year int, doi string, citations long"


def records(spark: SparkSession, path: str, source: str = "records") -> DataFrame:
    """source, source_id, rank, title, year, doi, citation_count of external records kept as JSON lines, in their order.

    Each file is one list, as a service gave it; lines that can't be read are passed over."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\r?\n")).alias("i", "line"))
    rows = lines.select("i", F.from_json("line", RECORD_SCHEMA).alias("x")).filter(F.coalesce("x.id", "x.title").isNotNull())
    return rows.select(F.lit(source).alias("source"), F.col("x.id").alias("source_id"), (F.col("i") + 1).alias("rank"), "x.title", F.coalesce("x.year", F.lit(0)).alias("year"), "x.doi", F.coalesce("x.citations", F.lit(0)).alias("citation_count"))


WORK_SCHEMA = (
    "id string, title string, display_name string, doi string, publication_year int, cited_by_count long, abstract string, abstract_inverted_index map<string, array<int>>,"
    " authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string, host_organization_name: string>>, open_access struct<is_oa: boolean, oa_url: string>"
)


def works(raw: DataFrame) -> DataFrame:
    """Nested work records (value: JSON) as flat ones: source, source_id, title, authors, year, doi, abstract, venue, publisher,
    citation_count, is_open_access, oa_pdf_url. Missing values are empty, 0 or false."""
    x = raw.select(F.from_json("value", WORK_SCHEMA).alias("x")).select("x.*")
    some = lambda c: F.coalesce(c, F.lit(""))
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: some(n) != "")
    place = F.col("primary_location.source")
    return x.select(
        F.lit("openalex").alias("source"),
        some(F.col("id")).alias("source_id"),
        some(F.coalesce("title", "display_name")).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.coalesce("publication_year", F.lit(0)).alias("year"),
        F.trim(F.replace(some(F.col("doi")), F.lit("https://doi.org/"), F.lit(""))).alias("doi"),
        some(F.coalesce("abstract", abstract_from_index(F.col("abstract_inverted_index")))).alias("abstract"),
        some(place["display_name"]).alias("venue"),
        some(place["host_organization_name"]).alias("publisher"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        some(F.col("open_access.oa_url")).alias("oa_pdf_url"),
    )
