"""Small made tables beside the driver's: Chinese and mixed texts, papers with tables and figures, nested records; as rows and as SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Texts in Chinese, English and both.
TEXTS = (
    (1, "城市扩张与土地利用变化的遥感监测研究"),
    (2, "但是，城市扩张的驱动机制仍不清楚。因此需要进一步研究！"),
    (3, "GIS 城市 network analysis of 土地"),
    (4, "However, urban growth is fast; and it lasts."),
    (5, "12 345 67.8"),
    (6, "基于遥感数据的城市热岛效应分析及其影响因素"),
    (7, "Also. 并且，面积为 120 km2，人口 3000 万。"),
    (8, "urban heat island 热岛"),
)
#: item_key, title, keywords, year of papers to be enriched.
PAPERS = (
    ("p1", "城市扩张与土地利用", "城市; 土地利用", 2019),
    ("p2", "Urban growth: a review", "urban; growth", 2020),
    ("p3", "热岛效应 heat island", "", 0),
    ("p4", "", "nothing", 2001),
)
#: item_key, page_num, text of papers with tables, figures and references.
PAGES = (
    ("x1", 1, "This study compares two cities in detail over many years of data. As Table 1 shows, growth was fast, and Figure 2 shows where. It went on for decades in both places, as has been said.\n\nMore of it is told in Tables 1 and 2 and in Fig. 2 of this paper, which is long enough to be a paragraph of its own. It has a second sentence, too, so that it is not short at all."),
    ("x1", 2, "Table 1. Growth by city\nCity A 12 14 15\nCity B 22 24 25\nCity C 32 34 35\nCity D 42 44 45\n\n\nFigure 2. Where the growth went\n\nThe last paragraph speaks of neither of them but closes the paper with some words, which make up for a length of more than two hundred characters, as the text goes on and on without an end, until it ends."),
    ("x2", 1, "Nothing is cited here, but the text has a paragraph that is long enough to stand alone, with more than fifty characters.\n\nAnd another paragraph that is long enough to stand alone, as it also has more than fifty characters in it."),
)
#: Nested records of an external index, as JSON.
WORKS = (
    {"id": "W1", "title": "One", "doi": "https://doi.org/10.1/a", "publication_year": 2020, "cited_by_count": 5, "authorships": [{"author": {"display_name": "Ann Lee"}}, {"author": {"display_name": ""}}, {"author": {"display_name": "Bo Ek"}}], "primary_location": {"source": {"display_name": "Journal"}}, "open_access": {"is_oa": True, "oa_url": "https://x.org/a.pdf"}, "abstract_inverted_index": {"is": [1], "This": [0], "good": [2, 3]}},
    {"id": "W2", "display_name": "Two", "doi": None, "publication_year": None, "cited_by_count": None, "authorships": [], "primary_location": None, "open_access": None, "abstract": "Told."},
)
WORKS_WANT = (
    ("W1", "One", "Ann Lee;Bo Ek", 2020, "10.1/a", "This is good good", "Journal", 5, True, "https://x.org/a.pdf"),
    ("W2", "Two", "", 0, "", "Told.", "", 0, False, ""),
)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "id long, text string")


def papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAPERS, "item_key string, title string, keywords string, year int")


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "item_key string, page_num int, text string")


def works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(json.dumps(x),) for x in WORKS], "value string")


def _sql(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: tuple, columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({columns})"


TEXTS_SQL = f"made AS ({values(TEXTS, 'id, text')})"
PAPERS_SQL = f"papers AS ({values(PAPERS, 'item_key, title, keywords, year')})"
