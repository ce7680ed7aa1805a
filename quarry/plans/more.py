"""Further queries: sinks, read modes, audits, samples, formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import formats, names
from quarry.functions import text as T
from quarry.operators import chunking, library, measure, search
from quarry.plans import retrieval as r
from quarry.plans import tables as t
from quarry.plans.library_plans import MANIFESTS_SQL, PEOPLE, _people

ENTRIES: dict = {}
I = f"WITH {t.ITEMS}"  # noqa: E741


def entry(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return add


@entry("S4_keyword_scan", f"{I} SELECT item_key FROM items WHERE contains(lower(title), 'the') AND list_contains(tags, 'en') AND list_contains(collections, 'src4')")
def s4(s, d):
    return t.items(s, d).filter(F.lower("title").contains("the") & F.array_contains("tags", "en") & F.array_contains("collections", "src4")).select("item_key")


@entry("K3_metadata_tables", f"WITH {t.CHUNKS}, {t.ITEMS} SELECT 'papers' AS name, count(*) AS n FROM items UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'captioned', count(*) FROM chunks WHERE regexp_matches(text, '(?m)^\\s*(?:(?i:table|figure|fig\\.)\\s*\\d+)')")
def k3(s, d):
    c = chunking.tagged(t.chunks(s, d))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("papers", t.items(s, d)).union(one("chunks", c)).union(one("captioned", c.filter("has_figure_table")))


@entry("K4_insert_or_ignore", "SELECT doc_id, min(n_chars) AS n_chars FROM (SELECT doc_id, n_chars FROM documents UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id")
def k4(s, d):
    x = t.table(s, d, "documents").select("doc_id", "n_chars")
    return x.union(x.filter("doc_id % 2 = 0")).dropDuplicates(["doc_id"])


@entry("R5_where_references", f"WITH {t.CHUNKS} SELECT chunk_id FROM chunks WHERE NOT contains(lower(text), 'references') AND item_key <> '0'")
def r5(s, d):
    section = F.when(F.lower("text").contains("references"), "references").otherwise("content")
    return t.chunks(s, d).withColumn("section", section).filter((F.col("section") != "references") & (F.col("item_key") != "0")).select("chunk_id")


@entry("R23_read_first", f"WITH {t.CHUNKS} SELECT item_key, chunk_idx, md5(text) AS digest FROM chunks WHERE chunk_idx < 5")
def r23(s, d):
    return t.chunks(s, d).filter("chunk_idx < 5").select("item_key", "chunk_idx", F.md5(F.col("text").cast("binary")).alias("digest"))


@entry("R24_reading_note", f"WITH {t.HITS} SELECT item_key, query_id, chunk_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY round(score, 9) DESC, chunk_id) AS n FROM hits) WHERE n <= 3")
def r24(s, d):
    n = F.row_number().over(Window.partitionBy("query_id", "item_key").orderBy(F.round("score", 9).desc(), "chunk_id"))
    return r._hits(s, d).withColumn("place", n.cast("long")).filter("place <= 3").select("item_key", "query_id", "chunk_id", "place")


@entry("F6_captioned", f"WITH {t.CHUNKS} SELECT chunk_id FROM chunks WHERE regexp_matches(text, '(?m)^\\s*(?:(?i:table|figure|fig\\.)\\s*\\d+)')")
def f6(s, d):
    return t.chunks(s, d).filter(F.col("text").rlike(chunking.CAPTION)).select("chunk_id")


@entry("F13_scope", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'user') >= 1")
def f13(s, d):
    return t.table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("u")).filter("u >= 1").drop("u")


@entry("A6_audit", f"WITH {t.CHUNKS} SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 1200 THEN 'long' ELSE 'ok' END AS kind, count(*) AS n FROM chunks GROUP BY kind")
def a6(s, d):
    n = F.length("text")
    return t.chunks(s, d).groupBy(F.when(n < 200, "short").when(n > 1200, "long").otherwise("ok").alias("kind")).agg(F.count("*").alias("n"))


@entry("A7_grade", f"WITH {t.CHUNKS}, q AS (SELECT item_key, count(*) AS n_chunks, count(*) FILTER (WHERE length(text) < 200) / count(*) AS sh, count(*) FILTER (WHERE length(text) >= 20 AND length(regexp_replace(text, '[\\x20-\\x7e\\s]', '', 'g')) > 0.4 * length(text)) / count(*) AS ga FROM chunks GROUP BY item_key), z AS (SELECT round(least(100.0, greatest(0.0, 100 - 40 * sh - 50 * ga - CASE WHEN n_chunks < 2 THEN 30 ELSE 0 END + CASE WHEN n_chunks >= 10 THEN 5 ELSE 0 END)), 2) AS score FROM q) SELECT CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade, count(*) AS n FROM z GROUP BY grade")
def a7(s, d):
    q = measure.quality(t.chunks(s, d), 200, T.is_garbled(F.col("text")))
    return q.groupBy(measure.grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"))


@entry("A8_separation", f"WITH {t.VECTORS}, p AS (SELECT a.item_key = b.item_key AS same, list_dot_product(a.e, b.e) AS x FROM v a JOIN v b ON a.id < b.id) SELECT round(avg(x) FILTER (WHERE same), 6) AS intra, round(avg(x) FILTER (WHERE NOT same), 6) AS inter FROM p")
def a8(s, d):
    """All pairs, from sums of vectors: no pair is formed."""
    v = t.vectors(s, d).select("item_key", "id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    sums = lambda *by: v.groupBy(*by, "i").agg(F.sum("x").alias("sx"), F.count("*").alias("n")).groupBy(*by).agg(F.sum(F.col("sx") * F.col("sx")).alias("s2"), F.max("n").alias("n"))
    own = v.agg(F.sum(F.col("x") * F.col("x")).alias("q"))
    within = sums("item_key").agg(F.sum("s2").alias("w2"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("wp"))
    # three single rows
    one = sums().crossJoin(own).crossJoin(within)
    intra, every = (F.col("w2") - F.col("q")) / 2, (F.col("s2") - F.col("q")) / 2
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return one.select(F.round(intra / F.col("wp"), 6).alias("intra"), F.round((every - intra) / (pairs - F.col("wp")), 6).alias("inter"))


@entry("A33_chunk_grid", r"""WITH g AS (SELECT unnest([300, 600, 900]) AS size), b AS (SELECT length(text || chr(10)) AS n FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0) SELECT size, sum(greatest(0, ceil((n - size) / (size * 0.8))) + 1)::BIGINT AS n_windows FROM g, b GROUP BY size""")
def a33(s, d):
    body = t.pages(s, d).filter(F.length(T.stripped("text")) > 0).select((F.length("text") + 1).alias("n"), F.explode(F.array(F.lit(300), F.lit(600), F.lit(900))).alias("size"))
    windows = F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("size")) / (F.col("size") * 0.8))) + 1
    return body.groupBy("size").agg(F.sum(windows).cast("long").alias("n_windows"))


@entry("O2_sort_score", f"WITH {t.HITS} SELECT query_id, item_key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS place FROM papers")
def o2(s, d):
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank"))
    return r._papers(s, d).select("query_id", "item_key", n.cast("long").alias("place"))


@entry("O4_by_citations", "SELECT p_partkey FROM (SELECT p_partkey, count(l_partkey) AS n, p_retailprice FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL ORDER BY n DESC, p_retailprice DESC, p_partkey LIMIT 25)")
def o4(s, d):
    n = t.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.table(s, d, "part").join(n, "p_partkey", "left").orderBy(F.coalesce("n", F.lit(0)).desc(), F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey")


@entry("O6_filter_then_limit", f"{I} SELECT item_key FROM items WHERE year >= 2010 ORDER BY doc_id LIMIT 30")
def o6(s, d):
    return t.items(s, d).filter("year >= 2010").orderBy("doc_id").limit(30).select("item_key")


@entry("O7_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 25")
def o7(s, d):
    return t.table(s, d, "documents").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(25).select("doc_id")


@entry("U3_incremental_sync", f"WITH {MANIFESTS_SQL} SELECT item_key, version FROM now")
def u3(s, d):
    """The index after a sync: deleted items gone, new and modified ones replaced."""
    x = t.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_key"), F.col("n_chars").alias("version"))
    stored, now = x.filter("doc_id % 5 <> 0").drop("doc_id"), x.filter("doc_id % 4 <> 0").withColumn("version", F.col("version") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).drop("doc_id")
    diff = library.sync_diff(stored, now)
    changed = now.join(diff.filter("status in ('new', 'modified')"), "item_key", "left_semi")
    return library.replaced(library.without(stored, diff.filter("status = 'deleted'")), changed)


@entry("U6_doi_overlap", f"{I} SELECT a.doi FROM (SELECT DISTINCT doi FROM items WHERE lang = 'en' AND doi IS NOT NULL) a JOIN (SELECT DISTINCT doi FROM items WHERE lang <> 'en' AND doi IS NOT NULL) b USING (doi)")
def u6(s, d):
    i = t.items(s, d).filter("doi is not null")
    return i.filter("lang = 'en'").select("doi").intersect(i.filter("lang <> 'en'").select("doi"))


@entry("T7_reference_list", f"WITH {PEOPLE}, z AS (SELECT *, c_custkey % 9 AS g, row_number() OVER (PARTITION BY c_custkey % 9 ORDER BY c_custkey) AS n FROM people WHERE len(authors) > 0) SELECT g, md5(string_agg('[' || n || '] ' || array_to_string(authors, ', ') || '. T' || c_custkey || '. ' || CASE WHEN year > 0 THEN year::VARCHAR ELSE 'n.d.' END || '.', chr(10) ORDER BY n)) AS digest FROM z GROUP BY g")
def t7(s, d):
    p = _people(s, d).filter("size(authors) > 0").select((F.col("c_custkey") % 9).alias("g"), "c_custkey", "authors", "year", F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("title"))
    return formats.reference_list(p, "g", ["c_custkey"]).select("g", F.md5(F.col("refs").cast("binary")).alias("digest"))


@entry("T10_bibtex", f"WITH {PEOPLE} SELECT c_custkey, '@article{{k' || c_custkey || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {{T}}', CASE WHEN len(authors) > 0 THEN '  author = {{' || array_to_string(authors, ' and ') || '}}' END, CASE WHEN year > 0 THEN '  year = {{' || year || '}}' END) || chr(10) || '}}' AS entry FROM people")
def t10(s, d):
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    return _people(s, d).select("c_custkey", formats.bibtex(key, F.lit("T"), F.col("authors"), F.col("year"), F.lit(None).cast("string")).alias("entry"))


@entry("T12_bibtex_fields", "SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '2020' END AS year FROM customer")
def t12(s, d):
    year = F.when(F.col("c_custkey") % 2 == 0, "2020").otherwise("")
    x = F.concat(F.lit("@article{k, Title = {"), F.col("c_name"), F.lit('}, year = "'), year, F.lit('"}'))
    f = t.table(s, d, "customer").select("c_custkey", names.bibtex_fields(x).alias("f"))
    return f.select("c_custkey", F.try_element_at("f", F.lit("title")).alias("title"), F.try_element_at("f", F.lit("year")).alias("year"))


@entry("T17_inverted_index", r"SELECT item_id, array_to_string(string_split_regex(trim(text), '\s+'), ' ') AS text FROM benchmark")
def t17(s, d):
    from quarry.sources.readers import abstract_from_index

    words = t.passages(s, d).select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("p", "w"))
    index = words.groupBy("query_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("i"))
    return index.select(F.col("query_id").alias("item_id"), abstract_from_index(F.col("i")).alias("text"))


@entry("T19_counts", "SELECT c_custkey, coalesce(try_cast(nullif(regexp_replace(c_phone, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS n FROM (SELECT c_custkey, c_name AS c_phone FROM customer)")
def t19(s, d):
    return t.table(s, d, "customer").select("c_custkey", formats.count(F.col("c_name")).alias("n"))


@entry("T20_export", "SELECT c_custkey, c_name AS title, 'A;B' AS author FROM customer")
def t20(s, d):
    x = F.concat(F.lit("Title-题名: "), F.col("c_name"), F.lit("<br>Author-作者: A;B<br>Other: z"))
    f = t.table(s, d, "customer").select("c_custkey", formats.export_fields(x).alias("f"))
    return f.select("c_custkey", F.col("f")["Title"].alias("title"), F.col("f")["Author"].alias("author"))


@entry("T21_as_list", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'a,' || c_name END AS items FROM customer")
def t21(s, d):
    k = F.col("c_custkey") % 3
    x = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.to_json(F.array(F.lit("a"), F.col("c_name")))).otherwise(F.concat(F.lit(" a, "), F.col("c_name"), F.lit(" ,")))
    return t.table(s, d, "customer").select("c_custkey", F.array_join(formats.as_list(x), ",").alias("items"))


@entry("T23_iso_dates", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS ts FROM orders")
def t23(s, d):
    o = t.table(s, d, "orders")
    iso = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select("o_orderkey", names.iso_date(iso).cast("timestamp_ntz").alias("ts"))


@entry("T24_round", "SELECT vec_id, round(sqrt(vec_id), 3) AS x FROM embeddings")
def t24(s, d):
    return t.table(s, d, "embeddings").select("vec_id", F.round(F.sqrt("vec_id"), 3).alias("x"))


@entry("T27_diagnosis", f"WITH {t.LOG} SELECT strategy, CASE WHEN strategy = 'error' THEN 'timeout' ELSE 'unknown' END AS cause, count(*) AS n FROM log GROUP BY ALL")
def t27(s, d):
    e = F.when(F.col("strategy") == "error", "Request timed out (503)").otherwise("ok")
    return t.log(s, d).groupBy("strategy", formats.diagnosis(e).alias("cause")).agg(F.count("*").alias("n"))


@entry("X2_trace_lookup", f"WITH {t.LOG} SELECT trace_id, strategy, latency_ms FROM log WHERE trace_id IN (SELECT item_id FROM benchmark)")
def x2(s, d):
    ids = t.passages(s, d).select(F.col("query_id").alias("trace_id"))
    return t.log(s, d).join(ids, "trace_id", "left_semi").select("trace_id", "strategy", "latency_ms")


@entry("X4_golden_titles", f"{I} SELECT item_key, CASE WHEN contains(title, ':') THEN trim(split_part(title, ':', 1)) ELSE substr(title, 1, 80) END AS query FROM items WHERE length(title) >= 20")
def x4(s, d):
    cut = F.when(F.col("title").contains(":"), F.trim(F.substring_index("title", ":", 1))).otherwise(F.substring("title", 1, 80))
    return t.items(s, d).filter("length(title) >= 20").select("item_key", cut.alias("query"))


@entry("X13_to_json", f"WITH {t.LOG} SELECT trace_id, '{{\"strategy\":\"' || strategy || '\",\"success\":' || success || '}}' AS doc FROM log")
def x13(s, d):
    return t.log(s, d).select("trace_id", F.to_json(F.struct("strategy", "success")).alias("doc"))


@entry("Q4_user_synonyms", "SELECT item_id AS query_id, 'ALSO' AS expansion FROM benchmark WHERE contains(lower(text), 'tion')")
def q4(s, d):
    from quarry.operators.expand import contained

    return contained(t.passages(s, d), s.createDataFrame([("tion", "ALSO")], "term string, expansion string")).select("query_id", "expansion")
