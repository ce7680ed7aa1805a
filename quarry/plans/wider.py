"""Queries over made tables (Chinese and mixed texts, papers with tables, nested records) beside the driver's, and what builds on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.functions import text as T
from quarry.operators import chunking, expand, library, measure, search
from quarry.plans import made
from quarry.plans import retrieval as r
from quarry.plans import tables as t
from quarry.sources import readers, sinks

ENTRIES: dict = {}
I = f"WITH {t.ITEMS}"  # noqa: E741
CJK = r"[\x{4e00}-\x{9fff}]"


def entry(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return add


def texts(s, d):  # noqa: ANN001, ANN201
    """The made texts, and those of benchmark."""
    return made.texts(s).union(t.passages(s, d).select((F.col("query_id") + 1000).alias("id"), "text"))


TEXTS = f"{made.TEXTS_SQL}, texts AS (SELECT id, text FROM made UNION ALL SELECT item_id + 1000, text FROM benchmark), shares AS (SELECT id, text, len(regexp_extract_all(text, '{CJK}')) AS z, len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM texts)"


@entry("Q1_query_language", f"WITH {TEXTS} SELECT id, CASE WHEN z + a = 0 THEN 'en' WHEN z / (z + a) > 0.5 THEN 'zh' WHEN a / (z + a) > 0.8 THEN 'en' ELSE 'mixed' END AS language FROM shares")
def q1(s, d):
    return texts(s, d).select("id", T.query_language(F.col("text")).alias("language"))


@entry("X5_is_chinese", f"WITH {TEXTS} SELECT id, z > 0.3 * length(text) AS chinese FROM shares")
def x5(s, d):
    return texts(s, d).select("id", T.is_chinese(F.col("text")).alias("chinese"))


@entry("H15_languages", f"WITH {TEXTS} SELECT id, CASE WHEN z + a = 0 THEN 'en' WHEN z / (z + a) > 0.6 THEN 'zh' WHEN z / (z + a) < 0.1 THEN 'en' ELSE 'mixed' END AS language, lower(regexp_extract(text, '^[A-Za-z]+')) IN ('but', 'also', 'however') AS conjunction FROM shares WHERE id < 1000")
def h15(s, d):
    c = made.texts(s).select(F.col("id").cast("string").alias("item_key"), F.lit(0).alias("chunk_idx"), "text")
    return chunking.tagged(c).select(F.col("item_key").cast("long").alias("id"), "language", F.col("starts_with_conjunction").alias("conjunction"))


@entry("R1_tokens_cjk", f"WITH {TEXTS}, u AS (SELECT id, regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS c, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM texts) SELECT id, array_to_string(list_concat(list_concat(CASE WHEN c = '' THEN [] ELSE string_split(c, '') END, list_transform(generate_series(1, length(c) - 1), lambda i: substr(c, i, 2))), w), ' ') AS tokens FROM u")
def r1(s, d):
    return texts(s, d).select("id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@entry("Q9_chinese_terms", f"WITH {made.TEXTS_SQL}, runs AS (SELECT id, list_filter(string_split_regex(text, '[，。、；：！？\\s,;:!?\\-—–/()（）【】\\[\\]\"”“’‘]+'), lambda x: x <> '') AS x FROM made), parts AS (SELECT id, flatten(list_transform(x, lambda y: CASE WHEN length(y) <= 8 THEN [y] ELSE string_split_regex(y, '[的了是在有对与及其]') END)) AS x FROM runs) SELECT id, array_to_string(list_filter(x, lambda y: length(y) BETWEEN 2 AND 8 AND length(translate(y, '{expand.STOP_CHARACTERS}', '')) > 0), ';') AS terms FROM parts")
def q9(s, d):
    return made.texts(s).select("id", F.array_join(expand.chinese_terms(F.col("text")), ";").alias("terms"))


TAGS = (("urban growth",), ("城市规划",), ("land use",), ("heat",), ("遥感",), (" Urban Growth ",))
WORDS_SQL = f"list_distinct(list_concat(list_filter(regexp_extract_all(lower(x), '[a-z][\\w-]*'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in expand.STOP)})), list_transform(generate_series(1, length(regexp_replace(x, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) - 1), lambda i: substr(regexp_replace(x, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'), i, 2))))"


@entry(
    "Q3_tag_expansion",
    f"WITH {TEXTS}, tags AS (SELECT DISTINCT trim(tag) AS tag FROM ({made.values(TAGS, 'tag')})), w AS (SELECT id, text, unnest({WORDS_SQL.replace('(x', '(text')}) AS w FROM texts), k AS (SELECT tag, unnest({WORDS_SQL.replace('(x', '(tag')}) AS w FROM tags)"
    f" SELECT DISTINCT w.id AS query_id, k.tag AS expansion FROM w JOIN k USING (w) JOIN shares USING (id) WHERE NOT contains(lower(w.text), lower(k.tag)) AND NOT ((z + a = 0 OR (z / (z + a) <= 0.5 AND a / (z + a) > 0.8)) AND regexp_matches(k.tag, '{CJK}'))",
)
def q3(s, d):
    return expand.tag_expansions(texts(s, d).withColumnRenamed("id", "query_id"), s.createDataFrame(TAGS, "tag string"))


@entry("H24_bilingual", f"WITH {made.PAPERS_SQL} SELECT item_key, 'EN ' || title AS title_en, CASE WHEN len(regexp_extract_all(keywords, '{CJK}')) > 0.3 * length(keywords) THEN 'EN ' || keywords ELSE '' END AS keywords_en FROM papers WHERE len(regexp_extract_all(title, '{CJK}')) > 0.3 * length(title)")
def h24(s, d):
    return chunking.bilingual(made.papers(s), _english)


def _english(text: str) -> str:
    """Stands for a translation model."""
    return f"EN {text}"


def _index(s):  # noqa: ANN001, ANN202
    """Enriched chunks of the made papers: chunk_id, item_key, document, title, year, section."""
    p = made.papers(s).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("section", F.when(F.col("n") == 0, "content").otherwise("结果"))
    body = F.concat(F.lit("body\n of "), "item_key", F.col("n").cast("string"))
    return p.select(F.concat_ws(":", "item_key", F.col("n").cast("string")).alias("chunk_id"), "item_key", chunking.enriched(body, F.col("title"), F.col("year"), F.col("keywords"), F.col("section")).alias("document"), "title", "year", "section", "keywords")


_HEAD = "concat_ws(' ', CASE WHEN keywords <> '' THEN '[Keywords: ' || keywords || ']' END, CASE WHEN title <> '' THEN '[Title: ' || title || CASE WHEN year > 0 THEN ' (' || year || ')' ELSE '' END || ']' END, CASE WHEN n = 1 THEN '[Section: 结果]' END"
INDEX_SQL = f"{made.PAPERS_SQL}, i AS (SELECT *, item_key || ':' || n AS chunk_id, 'body' || chr(10) || ' of ' || item_key || n AS body FROM papers, (SELECT unnest([0, 1]) AS n))"


@entry("H23_headers", f"WITH {INDEX_SQL} SELECT chunk_id, {_HEAD}) || chr(10) || body AS document FROM i")
def h23(s, d):
    return _index(s).select("chunk_id", "document")


@entry("H25_re_enriched", f"WITH {INDEX_SQL} SELECT chunk_id, {_HEAD}, '[Title_EN: EN ' || title || ']', CASE WHEN item_key = 'p1' THEN '[Keywords_EN: EN ' || keywords || ']' END) || chr(10) || body AS document FROM i WHERE item_key = 'p1'")
def h25(s, d):
    i = _index(s)
    return chunking.re_enriched(i.drop("keywords"), chunking.bilingual(made.papers(s), _english))


@entry("X10_header_parts", f"WITH {INDEX_SQL} SELECT chunk_id, keywords, body AS text FROM i")
def x10(s, d):
    return _index(s).select("chunk_id", chunking.header_keywords(F.col("document")).alias("keywords"), chunking.without_header(F.col("document")).alias("text"))


@entry("J5_cited_records", "SELECT 'x1' AS item_key, 0 AS chunk_idx, '1' AS ref, 'Table 1. Growth by city' AS caption")
def j5(s, d):
    c = chunking.chunked(made.pages(s).union(t.pages(s, d)))
    refs = c.filter("kind = 'prose'").select("item_key", "chunk_idx", F.explode("table_refs").alias("ref"))
    return library.cited_records(refs, c.filter("kind = 'table'").select("item_key", "ref", F.col("text").alias("body"))).select("item_key", "chunk_idx", "ref", F.substring_index("body", "\n", 1).alias("caption"))


@entry("J6_reference_bridge", "SELECT * FROM (VALUES ('x1', 0, '1', 'table'), ('x1', 0, '2', 'figure')) AS v(item_key, chunk_idx, ref, kind)")
def j6(s, d):
    c = chunking.chunked(made.pages(s).union(t.pages(s, d))).filter("kind = 'prose'")
    one = lambda kind: c.select("item_key", "chunk_idx", F.explode(f"{kind}_refs").alias("ref"), F.lit(kind).alias("kind"))
    return one("table").union(one("figure"))


@entry("X8_works", made.values(made.WORKS_WANT, "source_id, title, authors, year, doi, abstract, venue, citation_count, is_open_access, oa_pdf_url"))
def x8(s, d):
    return readers.works(made.works(s)).withColumn("authors", F.array_join("authors", ";")).drop("publisher", "source")


ISSUES_IN = ((1, 1.1, 2, 100, 0.0, 0.5), (2, 2.0, 11, 100, -0.4, 0.9), (3, 1.3, 10, 100, 0.3, 0.85), (4, 1.29, 0, 0, 0.31, None))


@entry(
    "A13_issues",
    "WITH s AS (SELECT * FROM (VALUES (1, 1.1, 2, 100, 0.0, 0.5), (2, 2.0, 11, 100, -0.4, 0.9), (3, 1.3, 10, 100, 0.3, 0.85), (4, 1.29, 0, 0, 0.31, NULL)) AS v(run, ratio, outliers, sampled, r, top)) SELECT run, 'weak_separation' AS issue FROM s WHERE ratio < 1.3"
    " UNION ALL SELECT run, 'outliers' FROM s WHERE outliers > sampled * 0.1 UNION ALL SELECT run, 'long_chunks_drift' FROM s WHERE r < -0.3 UNION ALL SELECT run, 'short_chunks_lack_context' FROM s WHERE r > 0.3 UNION ALL SELECT run, 'similar_papers' FROM s WHERE top > 0.85",
)
def a13(s, d):
    rows = s.createDataFrame(ISSUES_IN, "run int, separation_ratio double, outliers long, sampled long, length_correlation double, top_similarity double")
    return measure.issues(rows).select("run", "issue")


@entry("A13_weak_sections", "SELECT role AS section, round(avg(length(text)) / 1000, 6) AS mean FROM conversations GROUP BY role HAVING avg(length(text)) / 1000 < 0.4 AND role <> 'content'")
def a13b(s, d):
    by = t.table(s, d, "conversations").groupBy(F.col("role").alias("section")).agg((F.avg(F.length("text")) / 1000).alias("mean"))
    return measure.weak_sections(by).select("section", F.round("mean", 6).alias("mean"))


@entry("X6_fetch_depth", "SELECT item_id, least(greatest(3 * (item_id % 30), 30), 50) AS depth FROM benchmark")
def x6(s, d):
    return t.passages(s, d).select(F.col("query_id").alias("item_id"), library.fetch_depth(F.col("query_id") % 30).alias("depth"))


@entry("X7_recommendations", f"{I}, e AS (SELECT doi, item_key AS hit, 'related' AS source FROM items WHERE doc_id % 2 = 1 UNION ALL SELECT doi, item_key, 'similar' FROM items WHERE doc_id % 5 = 0) SELECT s.item_key AS seed, e.hit, e.source FROM items s JOIN e USING (doi) WHERE s.doc_id % 7 = 0 AND s.doi IS NOT NULL")
def x7(s, d):
    i = t.items(s, d)
    edges = lambda rows: rows.select("doi", F.col("item_key").alias("hit"))
    return library.recommended(i.filter("doc_id % 7 = 0").select(F.col("item_key").alias("seed"), "doi"), edges(i.filter("doc_id % 2 = 1")), edges(i.filter("doc_id % 5 = 0")))


@entry("X11_items_with_files", f"{I} SELECT item_key, title, url FROM items JOIN (SELECT doc_id, arg_min(url, page_id) AS url FROM (SELECT page_id, url, page_id // 2 AS doc_id FROM pages WHERE html LIKE '%<html%') GROUP BY doc_id) USING (doc_id) WHERE item_type NOT IN ('attachment', 'note', 'annotation')")
def x11(s, d):
    files = t.table(s, d, "pages").filter(F.col("html").contains("<html")).select(F.expr("page_id div 2").cast("string").alias("item_key"), F.col("page_id").alias("place"), "url")
    return library.with_files(t.items(s, d).filter(~F.col("item_type").isin(*library.NON_PAPERS)), files).select("item_key", "title", "url")


@entry("T4_surname", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'Lee' || c_custkey WHEN 2 THEN 'Ek' WHEN 3 THEN '王' ELSE c_name END AS surname FROM customer")
def t4(s, d):
    k = F.col("c_custkey")
    spelt = [F.concat(F.lit("Ann "), "c_name"), F.concat(F.lit("Lee"), k.cast("string"), F.lit(", A. B.")), F.lit("Ek A. B."), F.lit("王小明"), F.col("c_name")]
    name = F.get(F.array(*spelt), (k % 5).cast("int"))
    return t.table(s, d, "customer").select("c_custkey", names.surname(name).alias("surname"))


@entry("R6_cosine", f"WITH {t.VECTORS} SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1 UNION ALL SELECT -1, 0.0")
def r6(s, d):
    from quarry.functions.vectors import dot

    v = t.vectors(s, d).select("id", "embedding")
    pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id")
    # vectors of unequal lengths have nothing in common
    odd = s.createDataFrame([(-1, [1.0], [1.0, 2.0])], "id long, embedding array<float>, other array<float>")
    return pairs.union(odd).select("id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@entry("T18_json_fields", "SELECT event_type, sum((props->>'$.k')::INT)::BIGINT AS total, count(*) FILTER (WHERE coalesce((props->>'$.k')::INT, (props->>'$.year')::INT, 0) > 50) AS n FROM events GROUP BY event_type")
def t18(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    first = F.coalesce(k, F.get_json_object("props", "$.year").cast("int"), F.lit(0))
    return t.table(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(first > 50).alias("n"))


@entry("T3_snippet", r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(substr(text, 1, CASE WHEN a >= 150 THEN a WHEN b >= 150 THEN b WHEN c >= 150 THEN c ELSE 300 END)) || '…' END AS snippet
FROM (SELECT doc_id, text, length(regexp_extract(h, '(?s)^.*[。！？；]')) AS a, length(regexp_extract(h, '(?s)^(.*[.!?])\s', 1)) AS b, length(regexp_extract(h, '(?s)^(.*)\n', 1)) AS c FROM (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents))""")
def t3(s, d):
    return t.table(s, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_STOP = ", ".join(repr(w) for w in expand.STOP)
TERMS = f"terms AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z][0-9A-Za-z_-]*') AS ws FROM items)) WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL)"


@entry("Q8_seed_queries", f"{I}, {TERMS}, title AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM terms) WHERE n <= 6 GROUP BY doc_id), q AS (SELECT doc_id, 0 AS o, lang || ' ' || source AS q FROM items UNION ALL SELECT doc_id, 1, q FROM title) SELECT doc_id AS query_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS ordinal, q AS text FROM q WHERE q IS NOT NULL AND q <> ''")
def q8(s, d):
    return expand.seed_queries(t.items(s, d).select(F.col("doc_id").alias("query_id"), "title", F.col("tags").alias("keywords")))


@entry("Q9_terms", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][0-9A-Za-z_-]*'), lambda x: length(x) > 2 AND x NOT IN ({_STOP})))) AS n FROM documents")
def q9b(s, d):
    return t.table(s, d, "documents").select("doc_id", F.size(expand.terms(F.col("text"))).cast("long").alias("n"))


R20 = r.FUSED + ", r20 AS (SELECT * FROM (SELECT query_id, item_key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_key DESC) AS rank FROM fused) WHERE rank <= 20)"


@entry("A17_full_pipeline", f"WITH {t.HITS}{R20}{r.QRELS_SQL}{r.PER_SQL.replace('FROM papers', 'FROM r20')} SELECT query_id, {r.ROUND6} FROM metrics")
def a17(s, d):
    per = measure.per_query(r._qrels(s, d), search.ranked(r._fused(s, d), 20))
    return per.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall5", "recall10", "recall20", "rr", "ndcg10")))


HYBRID = """, dq AS (SELECT id AS query_id, e AS qe FROM v WHERE id IN (SELECT item_id FROM benchmark)),
dense AS (SELECT * FROM (SELECT query_id, id::VARCHAR AS item_key, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e, qe), 9) DESC, id) AS rank FROM v, dq) WHERE rank <= 50),
hybrid AS (SELECT query_id, item_key, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS score, CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'hybrid' WHEN b.rank IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source FROM dense a FULL JOIN papers b USING (query_id, item_key)),
placed AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score, item_key) - 1 AS pl FROM hybrid),
cuts AS (SELECT query_id, max(n) AS n, max(score) AS hi, min(score) AS lo, max(score) FILTER (WHERE pl = floor(n * 0.75)) AS h, max(score) FILTER (WHERE pl = floor(n * 0.25)) AS l FROM placed GROUP BY query_id),
tiered AS (SELECT p.query_id, item_key, score, source, CASE WHEN score >= CASE WHEN c.n >= 4 THEN h ELSE hi END THEN 'high' WHEN score >= CASE WHEN c.n >= 4 THEN l ELSE lo END THEN 'medium' ELSE 'low' END AS tier FROM placed p JOIN cuts c USING (query_id)),
found AS (SELECT * FROM (SELECT t.*, i.title, i.year, i.doi, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_key DESC) AS rank FROM tiered t JOIN items i USING (item_key) WHERE i.year >= 2015) WHERE rank <= 10),
newest AS (SELECT item_key, title, year, doi, row_number() OVER (ORDER BY year DESC, item_key DESC) AS rank FROM items WHERE year >= 2015 QUALIFY rank <= 10),
asked AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1)"""


@entry(
    "R16_hybrid_search",
    f"WITH {t.HITS.replace('asked AS', 'asked_tokens AS').replace('FROM asked JOIN', 'FROM asked_tokens JOIN')}, {t.VECTORS}, {t.ITEMS}{HYBRID} SELECT query_id, item_key, title, year, doi, round(score, 6) AS score, rank, source, tier FROM found"
    " UNION ALL SELECT query_id, item_key, title, year, doi, 0.0, rank, 'recency', 'low' FROM asked, newest WHERE query_id NOT IN (SELECT query_id FROM found)",
)
def r16(s, d):
    """Sparse ranks of the passages and dense ranks of their vectors, fused, tiered, joined with metadata and filtered by year,
    ten a query; the newest papers for a query (-1, of no known word) that has none."""
    asked = t.passages(s, d).union(s.createDataFrame([(-1, "漢")], "query_id long, text string"))
    hits = search.top(r._hits(s, d, r.BEST, asked=asked), r.BEST, "chunk_id")
    sparse = search.best_per_paper(hits, "chunk_id").select("query_id", "item_key", "rank")
    v = t.vectors(s, d).withColumn("item_key", F.col("id").cast("string"))
    dense = search.dense(v, v.select(F.col("id").alias("query_id"), "embedding").join(t.passages(s, d).select("query_id"), "query_id", "left_semi"), 50)
    out = search.hybrid(asked.select("query_id"), dense, sparse, t.items(s, d).filter("year >= 2015").select("item_key", "title", "year", "doi"), 10)
    return out.select("query_id", "item_key", "title", "year", "doi", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "source", "tier")


@entry("K1_replace_in_store", f"WITH {t.CHUNKS} SELECT item_key, chunk_idx, md5(text) AS digest FROM chunks WHERE item_key NOT IN (SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 10 = 3) UNION ALL SELECT doc_id::VARCHAR, 0, md5(text) FROM documents WHERE doc_id % 10 = 3")
def k1(s, d):
    """Through the sink: chunks are written, some items replaced, and the table is read back."""
    path, work = sinks.scratch(s, "chunks"), sinks.scratch(s, "work")
    parts = sinks.write_chunks(t.chunks(s, d).select("item_key", "chunk_idx", "text"), path, 8)
    fresh = t.table(s, d, "documents").filter("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("item_key"), F.lit(0).alias("chunk_idx"), "text")
    sinks.replace_items(fresh, path, work, parts)
    return s.read.parquet(path).select("item_key", "chunk_idx", F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("K5_stored_index", f"WITH {t.HITS} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM best WHERE rank <= 20")
def k5(s, d):
    """BM25 from the stored index."""
    path = sinks.scratch(s, "index")
    sinks.write_index(search.tokenised(t.chunks(s, d)), path)
    index, known = sinks.read_index(s, path)
    hits = search.top(search.bm25(t.passages(s, d), index, 20, known=known), 20, "chunk_id")
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@entry("K6_traces", f"WITH {t.LOG} SELECT trace_id::VARCHAR AS trace_id, strategy, latency_ms FROM log WHERE trace_id IN (SELECT item_id FROM benchmark)")
def k6(s, d):
    """Traces appended in folders by day, in two batches, and found by id."""
    path = sinks.scratch(s, "traces")
    log = t.log(s, d).select(F.col("trace_id").cast("string").alias("trace_id"), "ts", "strategy", "latency_ms")
    for batch in (log.filter("trace_id % 2 = 0"), log.filter("trace_id % 2 = 1")):
        sinks.append_traces(batch, path)
    ids = [str(r.query_id) for r in t.passages(s, d).select("query_id").collect()]
    return sinks.find_traces(s, path, ids).select("trace_id", "strategy", "latency_ms")


@entry("S24_open_access", "SELECT item_key, stage, url FROM (SELECT user_id::VARCHAR AS item_key, event_type AS stage, 'u' || event_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['signup', 'click', 'purchase'], event_type), 'u' || event_id) AS n FROM events WHERE event_type IN ('signup', 'click', 'purchase') AND event_id % 3 > 0) WHERE n = 1")
def s24(s, d):
    e = t.table(s, d, "events")
    url = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).otherwise("")
    return library.first_open(e.select(F.col("user_id").cast("string").alias("item_key"), F.col("event_type").alias("stage"), url.alias("url")), ["signup", "click", "purchase"])
