"""Queries of chunking, sparse and dense retrieval, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vectors import dot
from quarry.operators import chunking, measure, search
from quarry.plans import made
from quarry.plans import tables as t
from quarry.sources import sinks

ENTRIES: dict = {}


def entry(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return add


#: Hits of a query that go into paper ranks, fusion and evaluation.
BEST = 50


#: Where the sparse index of a folder's documents is stored, by the session and the files as they are.
_stored: dict[tuple, str] = {}


def stored_index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sparse index of all chunks and its tokens' weights, built once for the documents as they are and then read."""
    jvm, conf = s.sparkContext._jvm, s.sparkContext._jsc.hadoopConfiguration()
    stamp = [s.sparkContext.applicationId, d]
    for name in sorted(t.table(s, d, "documents").inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        stamp += [name, status.getModificationTime(), status.getLen()]
    key = tuple(stamp)
    if key not in _stored:
        path = sinks.scratch(s, "index")
        sinks.write_index(search.tokenised(t.chunks(s, d)), path)
        _stored[key] = path
    return sinks.read_index(s, _stored[key])


def _hits(s: SparkSession, d: str, k: int | None = None, by: str = "chunk_id", asked: DataFrame | None = None) -> DataFrame:
    index, known = stored_index(s, d)
    return search.bm25(t.passages(s, d) if asked is None else asked, index, k, by, known)


def _best(s: SparkSession, d: str) -> DataFrame:
    return search.top(_hits(s, d, BEST), BEST, "chunk_id")


def _papers(s: SparkSession, d: str) -> DataFrame:
    return search.best_per_paper(_best(s, d), "chunk_id").select("query_id", "item_key", "rank", "score")


def _shared(s: SparkSession, d: str) -> DataFrame:
    """A second list of papers: by how many of the query's distinct tokens they have."""
    asked = t.passages(s, d).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    have = t.pages(s, d).select("item_key", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    n = asked.join(have, "token").groupBy("query_id", "item_key").agg(F.count("*").cast("double").alias("score"))
    return search.top(n, 20, "item_key")


SHARED = r""", a2 AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM benchmark),
h2 AS (SELECT DISTINCT doc_id::VARCHAR AS item_key, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents),
shared AS (SELECT * FROM (SELECT query_id, item_key, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, item_key) AS rank
  FROM a2 JOIN h2 USING (token) GROUP BY query_id, item_key) WHERE rank <= 20)"""
FUSED = SHARED + """, fused AS (SELECT query_id, item_key, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS score,
  CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN b.rank IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source
  FROM shared a FULL JOIN papers b USING (query_id, item_key))"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    return search.rrf(_shared(s, d), _papers(s, d))


@entry("H8_sliding_window", f"WITH {t.WINDOWS} SELECT item_key, chunk_idx, text FROM windows")
def h8(s, d):
    return chunking.sliding(t.pages(s, d)).select("item_key", "chunk_idx", "text")


@entry("H14_merge_short", f"WITH {t.CHUNKS} SELECT item_key, chunk_idx, text FROM chunks")
def h14(s, d):
    return t.chunks(s, d).select("item_key", "chunk_idx", "text")


@entry(
    "H15_chunk_tags",
    f"""WITH {t.CHUNKS}, c AS (SELECT *, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS z, len(regexp_extract_all(text, '[A-Za-z]')) AS a, lower(regexp_replace(regexp_extract(text, '^\\S+'), '^[.!?;,:…，。！？；、：]+|[.!?;,:…，。！？；、：]+$', '', 'g')) AS w,
  len(list_filter(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS n FROM chunks)
  SELECT chunk_id, CASE WHEN z + a = 0 THEN 'en' WHEN z / (z + a) > 0.6 THEN 'zh' WHEN z / (z + a) < 0.1 THEN 'en' ELSE 'mixed' END AS language, n AS sentence_count,
  w IN ('and', 'but', 'or', 'however', 'therefore', 'thus', 'moreover', 'furthermore', 'additionally', 'also', 'meanwhile') AS starts_with_conjunction, CASE WHEN length(text) < 40 OR n = 0 THEN 'incomplete' ELSE 'good' END AS quality_flag FROM c""",
)
def h15(s, d):
    return chunking.tagged(t.chunks(s, d)).select("chunk_id", "language", "sentence_count", "starts_with_conjunction", "quality_flag")


@entry("H12_sentences", r"""SELECT doc_id, len(x) AS n_sentences, coalesce(max_len, 0) AS longest FROM (SELECT doc_id, x, list_max(list_transform(x, lambda y: length(y))) AS max_len
  FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y) <> '') AS x FROM documents))""")
def h12(s, d):
    x = t.table(s, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("x", F.length)), F.lit(0)).cast("long").alias("longest"))


@entry("H6_soft_wraps", r"""SELECT doc_id, length(regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g')) AS n FROM documents""")
def h6(s, d):
    return t.table(s, d, "documents").select("doc_id", F.length(T.soft_wraps(F.col("text"))).cast("long").alias("n"))


@entry("H16_captions", f"WITH {t.CHUNKS} SELECT item_key, count(*) AS n_chunks, count(*) FILTER (WHERE regexp_matches(text, '(?m)^\\s*(?:(?i:table|figure|fig\\.)\\s*\\d+)')) AS n_captions FROM chunks GROUP BY item_key")
def h16(s, d):
    c = t.chunks(s, d)
    return c.groupBy("item_key").agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("text").rlike(chunking.CAPTION), 1)).alias("n_captions"))


@entry(
    "H18_page_at",
    """WITH p AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER w, 0) AS a, coalesce(sum(length(text) + 1) OVER w, 0) + length(text) + 1 AS b FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spots AS (SELECT conv_id, unnest(generate_series(0, max(b)::BIGINT - 1, 97)) AS pos FROM p GROUP BY conv_id)
SELECT conv_id AS item_key, pos, turn AS page_num FROM spots JOIN p USING (conv_id) WHERE a <= pos AND pos < b""",
)
def h18(s, d):
    """Places every 97 characters of each item."""
    p = t.turns(s, d).select(F.col("section_id").alias("item_key"), F.col("chunk_idx").alias("page_num"), "text")
    offsets = chunking.page_offsets(p)
    at = offsets.groupBy("item_key").agg(F.max("end").alias("end")).select("item_key", F.explode(F.expr("sequence(0L, end - 1, 97L)")).alias("pos"))
    return chunking.page_at(at, offsets)


_TYPES = ", ".join(f"({i}, '{kind}', '{word}')" for i, (kind, words) in enumerate(chunking.SECTION_TYPES.items()) for word in words.split("|"))


@entry("H20_section_type", f"WITH k AS (SELECT * FROM (VALUES {_TYPES}) AS v(o, kind, word)), h AS (SELECT conv_id, turn, lower(text) AS l FROM conversations UNION ALL SELECT -row_number() OVER (), 0, '3. ' || word || ' x' FROM k) SELECT conv_id, turn, coalesce((SELECT arg_min(kind, o) FROM k WHERE contains(l, word)), 'unknown') AS section_type FROM h")
def h20(s, d):
    words = [word for every in chunking.SECTION_TYPES.values() for word in every.split("|")]
    heads = s.createDataFrame([(-i - 1, 0, f"3. {w} x") for i, w in enumerate(words)], "conv_id long, turn int, text string")
    rows = t.table(s, d, "conversations").select("conv_id", "turn", "text").union(heads)
    return rows.select("conv_id", "turn", chunking.section_type(F.col("text")).alias("section_type"))


SECTIONED = (
    ("a", 0, "Some title and authors of this paper"), ("a", 1, "1. Introduction\nIt begins."), ("a", 2, "it goes on with words"), ("a", 3, "2.1 Study area\nHere."), ("a", 4, "2.1.3 Sampling design\nThere."), ("a", 5, "III. Results and findings"),
    ("a", 6, "Chapter 4: Discussion"), ("a", 7, "§5 Conclusions"), ("a", 8, "参考文献"), ("a", 9, "（一）研究区域概况"), ("a", 10, "① 数据来源说明"), ("a", 11, "A. Data sources"), ("a", 12, "二、研究方法与数据"), ("a", 13, "12 345 678\nplain"),
    ("b", 0, "3.\nplain text here"), ("b", 1, "more of it"), ("b", 2, "（二）\nand more"), ("c", 0, "nothing at all"), ("c", 1, "still nothing"),
)
SECTIONS = (
    ("a", 0, "", "unknown", 1, None, 0, 0), ("a", 1, "Introduction", "introduction", 1, None, 1, 2), ("a", 2, "Study area", "methods", 2, 1, 3, 3), ("a", 3, "Sampling design", "unknown", 3, 2, 4, 4), ("a", 4, "Results and findings", "results", 1, None, 5, 5),
    ("a", 5, "Discussion", "discussion", 1, None, 6, 6), ("a", 6, "Conclusions", "conclusion", 1, None, 7, 7), ("a", 7, "参考文献", "references", 1, None, 8, 8), ("a", 8, "研究区域概况", "methods", 1, None, 9, 9), ("a", 9, "数据来源说明", "methods", 1, None, 10, 10), ("a", 10, "Data sources", "methods", 1, None, 11, 11),
    ("a", 11, "研究方法与数据", "methods", 1, None, 12, 13), ("b", 1, "3", "unknown", 1, None, 0, 1), ("b", 2, "二", "unknown", 1, None, 2, 2), ("c", 0, "", "unknown", 1, None, 0, 1),
)


@entry("H19_sections", made.values(SECTIONS, "item_key, section_idx, heading, section_type, level, parent_idx, chunk_start_idx, chunk_end_idx"))
def h19(s, d):
    """The sections of made papers; of the driver's chunks, which have no headings but by chance, H22 maps each."""
    rows = s.createDataFrame([(*x, "good") for x in SECTIONED], "item_key string, chunk_idx int, text string, quality_flag string")
    return chunking.sections(rows)


@entry("H22_section_map", f"WITH {t.CHUNKS} SELECT item_key, chunk_idx FROM chunks")
def h22(s, d):
    c = chunking.tagged(t.chunks(s, d))
    return chunking.section_map(c, chunking.sections(c)).select("item_key", "chunk_idx")


@entry("H23_enriched", f"WITH {t.ITEMS} SELECT item_key, md5('[Keywords: ' || lang || ', ' || source || '] [Title: ' || substr(trim(title), 1, 150) || CASE WHEN year > 0 THEN ' (' || year || ')' ELSE '' END || ']' || chr(10) || abstract) AS digest FROM items WHERE trim(title) <> ''")
def h23(s, d):
    x = t.items(s, d).filter("trim(title) <> ''")
    out = chunking.enriched(F.col("abstract"), F.col("title"), F.col("year"), F.array_join("tags", ", "), F.lit("content"))
    return x.select("item_key", F.md5(out.cast("binary")).alias("digest"))


@entry("H26_keyword_tags", f"WITH {t.ITEMS} SELECT item_key, array_to_string(list_filter(tags, lambda x: length(x) >= 3), ', ') AS keywords FROM items")
def h26(s, d):
    return t.items(s, d).select("item_key", chunking.keyword_tags(F.col("tags")).alias("keywords"))


@entry("H0_chunker")
def h0(s, d):
    return chunking.chunked(t.pages(s, d))


@entry("R1_tokens", r"SELECT doc_id, len(x) AS n_tokens, len(list_distinct(x)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS x FROM documents)")
def r1(s, d):
    x = t.table(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"))


@entry("R2_bm25_build", f"WITH {t.POSTINGS} SELECT token, df, round(idf, 6) AS idf FROM idf")
def r2(s, d):
    return search.idf(search.tokenised(t.chunks(s, d))).select("token", "df", F.round("idf", 6).alias("idf"))


@entry("R3_bm25_topk", f"WITH {t.HITS} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM best WHERE rank <= 20")
def r3(s, d):
    return search.top(_hits(s, d, 20), 20, "chunk_id").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@entry("R12_paper_rank", f"WITH {t.HITS} SELECT query_id, item_key, rank FROM papers")
def r12(s, d):
    return _papers(s, d).select("query_id", "item_key", F.col("rank").cast("long").alias("rank"))


@entry("R9_rrf", f"WITH {t.HITS}{FUSED} SELECT query_id, item_key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_key DESC) AS rank FROM fused) WHERE rank <= 10")
def r9(s, d):
    return search.ranked(_fused(s, d), 10).select("query_id", "item_key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@entry("R17_source_label", f"WITH {t.HITS}{FUSED} SELECT query_id, source, count(*) AS n FROM fused GROUP BY ALL")
def r17(s, d):
    return _fused(s, d).groupBy("query_id", "source").agg(F.count("*").alias("n"))


@entry("J7_fusion_join", f"WITH {t.HITS}{FUSED} SELECT query_id, count(*) AS n, round(sum(score), 6) AS total FROM fused GROUP BY ALL")
def j7(s, d):
    return _fused(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@entry("R18_fallback", f"WITH {t.HITS} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM papers WHERE score > 60)")
def r18(s, d):
    return t.passages(s, d).join(_papers(s, d).filter("score > 60"), "query_id", "left_anti").select("query_id")


@entry("R4_dense_topk", f"WITH {t.VECTORS} SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT query_id, id, list_dot_product(e, qe) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e, qe), 9) DESC, id) AS rank FROM v, vq) WHERE rank <= 8")
def r4(s, d):
    return search.dense(t.vectors(s, d), t.vector_queries(s, d).select("query_id", "embedding"), 8).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@entry(
    "R19_similar_papers",
    f"WITH {t.VECTORS}, r AS (SELECT query_id, id, item_key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, item_key, list_dot_product(e, qe) AS score FROM v, vq WHERE item_key <> own))"
    " SELECT query_id, item_key, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY rank) AS n FROM r WHERE rank <= 200) WHERE n = 1",
)
def r19(s, d):
    q = t.vector_queries(s, d).select("query_id", "embedding", F.col("item_key").alias("own"))
    return search.best_per_paper(search.dense(t.vectors(s, d), q, 200, own="own"), "id").select("query_id", "item_key", "id", F.col("rank").cast("long").alias("rank"))


@entry("R22_recall_test", f"WITH {t.VECTORS}, r AS (SELECT query_id, own, item_key, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e, qe), 9) DESC, id) AS rank FROM v, vq) SELECT query_id, count(*) FILTER (WHERE own = item_key) AS own_hits, min(rank) FILTER (WHERE own = item_key) AS best_rank FROM r WHERE rank <= 20 GROUP BY query_id")
def r22(s, d):
    q = t.vector_queries(s, d)
    hits = search.dense(t.vectors(s, d), q.select("query_id", "embedding"), 20).join(q.select("query_id", F.col("item_key").alias("own")), "query_id")
    mine = F.col("own") == F.col("item_key")
    return hits.groupBy("query_id").agg(F.count(F.when(mine, 1)).alias("own_hits"), F.min(F.when(mine, F.col("rank"))).cast("long").alias("best_rank"))


@entry("R13_multi_query", f"WITH {t.VECTORS}, r AS (SELECT query_id, item_key, w * list_dot_product(e, qe) AS score FROM v, vq, (SELECT unnest([1.0, 0.4, 0.2]) AS w)) SELECT query_id, item_key, round(max(score), 6) AS score FROM r GROUP BY ALL")
def r13(s, d):
    hits = search.dense_papers(t.vectors(s, d), t.vector_queries(s, d).select("query_id", "embedding"))
    weighed = hits.withColumn("weight", F.explode(F.array(F.lit(1.0), F.lit(0.4), F.lit(0.2))))
    return search.merged_queries(weighed).withColumn("score", F.round("score", 6))


@entry(
    "R15_tiers",
    f"WITH {t.HITS}, p AS (SELECT * REPLACE (round(score, 9) AS score), count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), item_key) - 1 AS pl FROM papers),"
    " c AS (SELECT query_id, max(n) AS n, max(score) AS hi, min(score) AS lo, max(score) FILTER (WHERE pl = floor(n * 0.75)) AS h, max(score) FILTER (WHERE pl = floor(n * 0.25)) AS l FROM p GROUP BY query_id)"
    " SELECT query_id, item_key, CASE WHEN score >= CASE WHEN c.n >= 4 THEN h ELSE hi END THEN 'high' WHEN score >= CASE WHEN c.n >= 4 THEN l ELSE lo END THEN 'medium' ELSE 'low' END AS tier FROM p JOIN c USING (query_id)",
)
def r15(s, d):
    return search.tiers(_papers(s, d)).select("query_id", "item_key", "tier")


@entry("R14_mmr")
def r14(s, d):
    hits = search.dense(t.vectors(s, d), t.vector_queries(s, d).select("query_id", "embedding"), 60)
    return search.mmr(hits.join(t.vectors(s, d).select("id", "embedding"), "id"))


@entry(
    "R20_suggest_citations",
    f"WITH {t.POSTINGS}, sent AS (SELECT item_id * 1000 + i AS query_id, s FROM (SELECT item_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS i FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM benchmark)) WHERE length(s) >= 10),"
    " asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(s), '[a-z]{2,}')) AS token FROM sent) GROUP BY ALL),"
    " hits AS (SELECT query_id, chunk_id, item_key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM stats)))) AS score FROM asked JOIN idf USING (token) JOIN posted USING (token) JOIN stats USING (chunk_id) GROUP BY ALL HAVING score > 0),"
    " per AS (SELECT query_id, item_key, max(score) AS score FROM hits GROUP BY ALL)"
    " SELECT query_id, item_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_key) AS rank FROM per) WHERE rank <= 5",
)
def r20(s, d):
    q = t.passages(s, d).select("query_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "text")).filter("length(text) >= 10").select((F.col("query_id") * 1000 + F.col("i")).alias("query_id"), "text")
    per = _hits(s, d, 5, "item_key", q)
    return search.top(per, 5, "item_key").select("query_id", "item_key", F.col("rank").cast("long").alias("rank"))


@entry("R25_review_evidence", f"WITH {t.CHUNKS}, {t.ITEMS} SELECT i.year, count(DISTINCT item_key) AS n_papers, count(*) AS n_passages, sum(length(text))::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY chunk_idx) AS n FROM chunks) JOIN items i USING (item_key) WHERE n <= 3 GROUP BY i.year")
def r25(s, d):
    w = Window.partitionBy("item_key").orderBy("chunk_idx")
    first = t.chunks(s, d).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return first.join(t.items(s, d).select("item_key", "year"), "item_key").groupBy("year").agg(F.countDistinct("item_key").alias("n_papers"), F.count("*").alias("n_passages"), F.sum(F.length("text")).alias("n_chars"))


@entry("R10_within_item", f"WITH {t.HITS}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM hits) SELECT query_id, item_key, chunk_id, round(1 / (60 + row_number() OVER (PARTITION BY query_id, item_key ORDER BY r)), 6) AS score FROM g WHERE r <= 200")
def r10(s, d):
    held = search.top(_hits(s, d, 200), 200, "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id", "item_key").orderBy("rank"))
    return held.select("query_id", "item_key", "chunk_id", F.round(1 / (search.RRF + place), 6).alias("score"))


LISTS_SQL = """lists AS (SELECT * FROM (SELECT 1 AS list_order, 'a' AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, * EXCLUDE (source) FROM items WHERE doc_id % 2 = 0
  UNION ALL SELECT 2, 'b', row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC), * EXCLUDE (source) FROM items WHERE doc_id % 3 = 0)),
keyed AS (SELECT *, coalesce('doi:' || lower(nullif(trim(doi), '')), 'title:' || substr(lower(trim(title)), 1, 120)) AS merge_key FROM lists)"""


@entry("R11_consolidate", f"WITH {t.ITEMS}, {LISTS_SQL} SELECT merge_key, round(sum(1 / (60 + rank)), 6) AS score, max(version) AS citation_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM keyed GROUP BY merge_key")
def r11(s, d):
    from quarry.functions.names import merge_key

    i = t.items(s, d)
    w = Window.partitionBy("lang")
    a = i.filter("doc_id % 2 = 0").withColumns({"list_order": F.lit(1), "rank": F.row_number().over(w.orderBy("doc_id"))}).withColumn("source", F.lit("a"))
    b = i.filter("doc_id % 3 = 0").withColumns({"list_order": F.lit(2), "rank": F.row_number().over(w.orderBy(F.desc("doc_id")))}).withColumn("source", F.lit("b"))
    lists = a.unionByName(b).withColumns({"merge_key": merge_key(F.col("doi"), F.col("source"), F.lit(None).cast("string"), F.col("title")), "publisher": F.col("lang"), "citation_count": F.col("version")})
    return search.consolidated(lists).select("merge_key", F.round("score", 6).alias("score"), "citation_count", F.array_join("sources", ",").alias("sources"))


QRELS_SQL = ", qrels AS (SELECT b.item_id AS query_id, d.doc_id::VARCHAR AS item_key FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text))"
PER_SQL = """, f AS (SELECT query_id, item_key, min(rank) AS rank FROM papers GROUP BY ALL), per AS (SELECT query_id, count(q.item_key) AS n, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 20) AS h20,
  min(rank) AS first, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS gain FROM qrels q LEFT JOIN f USING (query_id, item_key) GROUP BY query_id),
metrics AS (SELECT query_id, CASE WHEN n = 0 THEN 1.0 ELSE h5 / n END AS recall5, CASE WHEN n = 0 THEN 1.0 ELSE h10 / n END AS recall10, CASE WHEN n = 0 THEN 1.0 ELSE h20 / n END AS recall20, coalesce(1 / first, 0) AS rr,
  CASE WHEN n = 0 THEN 1.0 ELSE gain / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) END AS ndcg10, CASE WHEN n = 0 THEN 'no_answer' ELSE 'direct' END AS category FROM per)"""


def _qrels(s: SparkSession, d: str) -> DataFrame:
    """A passage's expected documents hold it verbatim, its first five words among theirs. Only places and keys meet on
    those; texts are compared where the keys did."""
    asked = t.passages(s, d).withColumn("head", F.xxhash64(F.array_join(F.slice(F.split("text", r"\s+"), 1, 5), " ")))
    words = F.split("text", r"\s+")
    runs = T.let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 5), " ")))))
    pages = t.pages(s, d)
    at = pages.select("item_key", F.explode(runs).alias("head")).join(asked.select("query_id", "head"), "head").select("query_id", "item_key").distinct()
    found = pages.select("item_key", F.col("text").alias("body")).join(at, "item_key").join(asked.select("query_id", "text"), "query_id").filter(F.col("body").contains(F.col("text"))).select("query_id", "item_key").distinct()
    return t.passages(s, d).select("query_id").join(found, "query_id", "left")


def _metrics(s: SparkSession, d: str) -> DataFrame:
    q = _qrels(s, d)
    kind = q.groupBy("query_id").agg(F.when(F.count("item_key") == 0, "no_answer").otherwise("direct").alias("category"))
    return measure.per_query(q, _papers(s, d)).join(kind, "query_id")


ROUND6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall5", "recall10", "recall20", "rr", "ndcg10"))


@entry("A14_recall_rr_ndcg", f"WITH {t.HITS}{QRELS_SQL}{PER_SQL} SELECT query_id, category, {ROUND6} FROM metrics")
def a14(s, d):
    return _metrics(s, d).select("query_id", "category", *(F.round(c, 6).alias(c) for c in ("recall5", "recall10", "recall20", "rr", "ndcg10")))


@entry("J14_qrels_join", f"WITH {t.HITS}{QRELS_SQL} SELECT query_id, count(item_key) AS n_expected, count(rank) AS n_found FROM qrels LEFT JOIN papers USING (query_id, item_key) GROUP BY query_id")
def j14(s, d):
    return _qrels(s, d).join(_papers(s, d), ["query_id", "item_key"], "left").groupBy("query_id").agg(F.count("item_key").alias("n_expected"), F.count("rank").alias("n_found"))


@entry("A16_macro", f"WITH {t.HITS}{QRELS_SQL}{PER_SQL} SELECT category, count(*) AS n_queries, {ROUND6.replace('round(', 'round(avg(').replace(', 6)', '), 4)')} FROM metrics GROUP BY ROLLUP (category)")
def a16(s, d):
    return measure.macro(_metrics(s, d))


@entry("A18_compare_runs", f"WITH {t.HITS}{SHARED}{QRELS_SQL}{PER_SQL}, f2 AS (SELECT query_id, item_key, rank FROM shared), per2 AS (SELECT query_id, count(q.item_key) AS n, count(*) FILTER (WHERE rank <= 5) AS h5, min(rank) AS first FROM qrels q LEFT JOIN f2 USING (query_id, item_key) GROUP BY query_id), m2 AS (SELECT query_id, CASE WHEN n = 0 THEN 1.0 ELSE h5 / n END AS r2, coalesce(1 / first, 0) AS rr2 FROM per2) SELECT round(avg(r2 - recall5), 4) AS recall5_delta, round(avg(rr2 - rr), 4) AS mrr_delta, count(*) FILTER (WHERE rr2 > rr) AS improved, count(*) FILTER (WHERE rr2 < rr) AS regressed FROM metrics JOIN m2 USING (query_id)")
def a18(s, d):
    q = _qrels(s, d)
    return measure.compared(measure.per_query(q, _papers(s, d)), measure.per_query(q, _shared(s, d)))


@entry("A34_rank_overlap", f"WITH {t.HITS}{SHARED}, b AS (SELECT query_id, item_key, a.rank AS ra, p.rank AS rb FROM shared a JOIN papers p USING (query_id, item_key) WHERE a.rank <= 10 AND p.rank <= 10), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ra) AS pa, row_number() OVER (PARTITION BY query_id ORDER BY rb) AS pb FROM b) SELECT query_id, round(count(*) / 10, 6) AS overlap, round(CASE WHEN count(*) > 1 THEN 1 - 6 * sum((pa - pb) * (pa - pb)) / (count(*) * (count(*) * count(*) - 1)) END, 6) AS spearman FROM z GROUP BY query_id")
def a34(s, d):
    return measure.overlap(_shared(s, d), _papers(s, d), 10).select("query_id", F.round("overlap", 6).alias("overlap"), F.round("spearman", 6).alias("spearman"))


