"""Queries of sources, cleaning, metadata joins, sync, audits, text functions and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import names
from quarry.functions import text as T
from quarry.operators import cleaning, expand, library, measure
from quarry.plans import journal
from quarry.plans import tables as t

ENTRIES: dict = {}
I = f"WITH {t.ITEMS}"  # noqa: E741


def entry(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        ENTRIES[name] = (f, sql)
        return f

    return add


def long(c):  # noqa: ANN001, ANN201
    return F.col(c).cast("long").alias(c)


# --- sources ---


@entry("S5_batch_lookup", f"{I} SELECT item_key, title, year FROM items WHERE doc_id IN (SELECT doc_id FROM labels)")
def s5(s, d):
    return t.items(s, d).join(t.table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("item_key", "title", "year")


@entry("S6_minimal_items", f"{I} SELECT item_key, item_type, version FROM items WHERE item_type NOT IN ('attachment', 'note', 'annotation')")
def s6(s, d):
    return t.items(s, d).filter(~F.col("item_type").isin(*library.NON_PAPERS)).select("item_key", "item_type", "version")


@entry("S7_item_versions", f"{I} SELECT item_key, version FROM items WHERE item_type NOT IN ('attachment', 'note', 'annotation')")
def s7(s, d):
    every = t.items(s, d)
    return library.without(every.select("item_key", "version"), every.filter(F.col("item_type").isin(*library.NON_PAPERS)))


@entry("S8_first_file", "SELECT page_id % 50 AS item, arg_min(url, page_id) AS url FROM pages WHERE html LIKE '%<html%' GROUP BY 1")
def s8(s, d):
    return t.table(s, d, "pages").filter(F.col("html").contains("<html")).groupBy((F.col("page_id") % 50).alias("item")).agg(F.min_by("url", "page_id").alias("url"))


@entry("S9_tags", f"{I} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY tag")
def s9(s, d):
    return t.items(s, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@entry("S9_recent", f"{I} SELECT item_key, year FROM items ORDER BY year DESC, doc_id DESC LIMIT 20")
def s9b(s, d):
    return t.items(s, d).orderBy(F.desc("year"), F.desc("doc_id")).limit(20).select("item_key", "year")


@entry("S10_annotations", f"WITH {t.TURNS} SELECT section_id, chunk_idx, text FROM turns WHERE role = 'user'")
def s10(s, d):
    return t.turns(s, d).filter("role = 'user'").select("section_id", "chunk_idx", "text")


@entry("S11_chunk_scan", f"WITH {t.CHUNKS} SELECT item_key, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY item_key")
def s11(s, d):
    return t.chunks(s, d).groupBy("item_key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@entry("S12_where", f"{I} SELECT item_key FROM items WHERE lang = 'en' AND source <> 'src0' AND year >= 2000 AND year <= 2010")
def s12(s, d):
    return t.items(s, d).filter((F.col("lang") == "en") & (F.col("source") != "src0") & F.col("year").between(2000, 2010)).select("item_key")


@entry("S3_full_text", f"WITH {t.TURNS} SELECT section_id, md5(string_agg('[' || chunk_idx || '] ' || text, chr(10) ORDER BY chunk_idx)) AS digest FROM turns WHERE chunk_idx < 50 GROUP BY section_id")
def s3(s, d):
    rows = t.turns(s, d).filter("chunk_idx < 50").groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda x: F.concat(F.lit("["), x["chunk_idx"].cast("string"), F.lit("] "), x["text"])), "\n")
    return rows.select("section_id", F.md5(whole.cast("binary")).alias("digest"))


# --- sinks, as the tables they leave ---


@entry("K1_replace_item", f"WITH {t.VECTORS} SELECT id, item_key FROM v WHERE item_key NOT IN ('1', '3') UNION ALL SELECT id + 1000000, item_key FROM v WHERE item_key IN ('1', '3') AND id % 2 = 0")
def k1(s, d):
    v = t.vectors(s, d).select("id", "item_key")
    return library.replaced(v, v.filter(F.col("item_key").isin("1", "3") & (F.col("id") % 2 == 0)).select((F.col("id") + 1_000_000).alias("id"), "item_key"))


@entry("K2_delete_item", f"WITH {t.CHUNKS} SELECT count(*) AS n, count(DISTINCT item_key) AS items FROM chunks WHERE item_key NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)")
def k2(s, d):
    gone = t.table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("item_key"))
    return library.without(t.chunks(s, d), gone).agg(F.count("*").alias("n"), F.countDistinct("item_key").alias("items"))


@entry("K8_rotate", f"WITH {t.LOG} SELECT trace_id FROM log WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM log) - INTERVAL 10 DAY")
def k8(s, d):
    log = t.log(s, d)
    last = log.agg(F.max("ts").alias("last"))
    # the newest time is one row
    return log.crossJoin(F.broadcast(last)).filter(F.col("ts").isNull() | (F.col("ts") >= F.col("last") - F.expr("INTERVAL 10 DAYS"))).select("trace_id")


@entry("K10_synonyms", "SELECT term, array_to_string(list_sort(list(DISTINCT expansion)), ',') AS expansions FROM (SELECT lang AS term, source AS expansion FROM documents UNION ALL SELECT 'en', 'english') GROUP BY term")
def k10(s, d):
    old = t.table(s, d, "documents").select(F.col("lang").alias("term"), F.col("source").alias("expansion")).distinct()
    new = s.createDataFrame([("en", "english")], "term string, expansion string")
    return old.union(new).groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("expansion")), ",").alias("expansions"))


@entry("K12_merge_items", f"{I} SELECT doi AS keeper, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags, array_to_string(list_sort(list(DISTINCT source)), ',') AS collections, count(DISTINCT item_key) AS n_items FROM (SELECT *, unnest(tags) AS tag FROM items) WHERE doi IS NOT NULL GROUP BY doi")
def k12(s, d):
    merged = library.merged_items(t.items(s, d).filter("doi is not null").withColumn("keeper", F.col("doi")))
    return merged.withColumns({c: F.array_join(c, ",") for c in ("tags", "collections")})


# --- cleaning ---


@entry("C1_clean_lines", f"WITH {journal.LINES} SELECT item_key, coalesce(md5(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n{{3,}}', chr(10) || chr(10), 'g')), md5('')) AS digest FROM printed LEFT JOIN kept USING (item_key) WHERE text IS NOT NULL GROUP BY item_key")
def c1(s, d):
    return journal.pages(s, d).filter("text is not null").select("item_key", F.md5(cleaning.cleaned(F.col("text")).cast("binary")).alias("digest"))


@entry("C2_rule_counts", f"WITH {journal.LINES} SELECT category, count(*) AS n_lines, count(DISTINCT item_key) AS n_items FROM lines WHERE category IS NOT NULL GROUP BY category")
def c2(s, d):
    return cleaning.report(journal.pages(s, d))


@entry("C4_collapse", r"SELECT doc_id, length(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')) AS n FROM documents")
def c4(s, d):
    return t.table(s, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"\n{3,}", "\n\n")).cast("long").alias("n"))


@entry("C5_report", f"WITH {journal.LINES}, n AS (SELECT item_key, count(*) AS n FROM kept GROUP BY item_key), m AS (SELECT item_key, count(*) AS m FROM lines GROUP BY item_key) SELECT item_key, coalesce(m, 0) AS lines_in, coalesce(m, 0) - coalesce(n, 0) AS lines_removed FROM printed LEFT JOIN m USING (item_key) LEFT JOIN n USING (item_key)")
def c5(s, d):
    return cleaning.summary(journal.pages(s, d))


@entry("C5_samples", f"WITH {journal.LINES} SELECT category, CASE WHEN length(s) > 80 THEN substr(s, 1, 80) || '...' ELSE s END AS line FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_key, i) AS n FROM lines WHERE category IS NOT NULL) WHERE n <= 10")
def c5b(s, d):
    return cleaning.samples(journal.pages(s, d))


@entry("F10_garbled", f"WITH {t.CHUNKS} SELECT count(*) AS n, count(*) FILTER (WHERE length(text) >= 20 AND length(regexp_replace(text, '[\\x20-\\x7e\\s]', '', 'g')) > 0.4 * length(text)) AS garbled FROM chunks")
def f10(s, d):
    return t.chunks(s, d).agg(F.count("*").alias("n"), F.count(F.when(T.is_garbled(F.col("text")), 1)).alias("garbled"))


@entry(
    "A5_noise_patterns",
    f"WITH {t.CHUNKS}, e AS (SELECT item_key, text, row_number() OVER (PARTITION BY item_key ORDER BY chunk_idx) AS a, row_number() OVER (PARTITION BY item_key ORDER BY chunk_idx DESC) AS b FROM chunks), l AS (SELECT item_key, trim(unnest(string_split(text, chr(10)))) AS line FROM e WHERE a <= 2 OR b <= 2)"
    " SELECT line, count(DISTINCT item_key) AS n_items FROM l WHERE length(line) BETWEEN 5 AND 150 GROUP BY line HAVING n_items >= 3 ORDER BY n_items DESC, line LIMIT 50",
)
def a5(s, d):
    return cleaning.noise_patterns(t.chunks(s, d)).select("line", "n_items")


# --- predicates ---


@entry("F1_year_range", f"{I} SELECT item_key FROM items WHERE year >= 1995 AND year <= 2005 AND year > 0")
def f1(s, d):
    return t.items(s, d).filter(library.year_range(F.col("year"), 1995, 2005)).select("item_key")


@entry("F7_year_unknown", f"{I} SELECT item_key FROM items WHERE year = 0 OR year >= 2010")
def f7(s, d):
    return t.items(s, d).filter(library.year_range(F.col("year"), 2010, None, keep_unknown=True)).select("item_key")


@entry("F2_tags_all", f"{I} SELECT item_key FROM items WHERE list_has_all(tags, ['en', 'src3'])")
def f2(s, d):
    return t.items(s, d).filter(library.has_all(F.col("tags"), ["en", "src3"])).select("item_key")


@entry("F3_tags_none", f"{I} SELECT item_key FROM items WHERE NOT list_has_any(tags, ['en', 'src3'])")
def f3(s, d):
    return t.items(s, d).filter(library.has_none(F.col("tags"), ["en", "src3"])).select("item_key")


@entry("F4_collection", f"{I} SELECT item_key FROM items WHERE list_contains(collections, 'src5')")
def f4(s, d):
    return t.items(s, d).filter(F.array_contains("collections", "src5")).select("item_key")


@entry("F5_page_range", f"WITH {t.CHUNKS} SELECT chunk_id FROM chunks WHERE chunk_idx * 480 <= 1000 AND 1000 < chunk_idx * 480 + 600")
def f5(s, d):
    return t.chunks(s, d).filter("chunk_idx * 480 <= 1000 and 1000 < chunk_idx * 480 + 600").select("chunk_id")


@entry("F8_relevance", f"{I} SELECT item_key, round(len(list_filter(['idiot', 'the', 'und', 'les'], lambda x: contains(lower(abstract), x))) / 4, 6) AS share FROM items WHERE len(list_filter(['idiot', 'the', 'und', 'les'], lambda x: contains(lower(abstract), x))) / 4 >= 0.15")
def f8(s, d):
    share = expand.relevance(F.col("abstract"), F.array(*map(F.lit, ("idiot", "the", "und", "les"))))
    return t.items(s, d).select("item_key", F.round(share, 6).alias("share")).filter("share >= 0.15")


@entry("F9_field_ids", "SELECT source, coalesce(MAP {'src1': 11, 'src2': 22}[source], 0)::INT AS field_id, count(*) AS n FROM documents GROUP BY ALL")
def f9(s, d):
    ids = F.create_map(F.lit("src1"), F.lit(11), F.lit("src2"), F.lit(22))
    return t.table(s, d, "documents").groupBy("source", F.coalesce(ids[F.col("source")], F.lit(0)).alias("field_id")).agg(F.count("*").alias("n"))


@entry("F11_annotation_search", f"WITH {t.TURNS} SELECT section_id, chunk_idx FROM turns WHERE contains(lower(text), 'the') ORDER BY section_id, chunk_idx LIMIT 20")
def f11(s, d):
    return t.turns(s, d).filter(F.lower("text").contains("the")).orderBy("section_id", "chunk_idx").limit(20).select("section_id", "chunk_idx")


@entry("F12_collection_search", "SELECT DISTINCT source FROM documents WHERE contains(lower(source), 'src1')")
def f12(s, d):
    return t.table(s, d, "documents").select("source").filter(F.lower("source").contains("src1")).distinct()


# --- joins ---


@entry("J1_enrich", f"WITH {t.CHUNKS}, {t.ITEMS} SELECT c.chunk_id, i.title, substr(i.abstract, 1, 500) AS abstract, l.quality FROM chunks c JOIN items i USING (item_key) LEFT JOIN labels l USING (doc_id)")
def j1(s, d):
    sections = t.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("item_key"), F.lit(0).alias("section_idx"), "quality")
    hits = t.chunks(s, d).select("chunk_id", "item_key", F.lit(0).alias("section_idx"))
    return library.enriched(hits, t.items(s, d), sections).select("chunk_id", "title", "abstract", "quality")


@entry("J2_hit_metadata", "SELECT l.doc_id, d.lang, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")
def j2(s, d):
    return t.table(s, d, "labels").join(t.table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", "quality")


@entry("J3_section", f"WITH {t.TURNS} SELECT section_id, chunk_idx, md5((SELECT string_agg(b.text, chr(10) || chr(10) ORDER BY b.chunk_idx) FROM turns b WHERE b.section_id = a.section_id)) AS digest FROM turns a WHERE role = 'user'")
def j3(s, d):
    x = t.turns(s, d)
    return library.with_section(x.filter("role = 'user'").select("section_id", "chunk_idx"), x).select("section_id", "chunk_idx", F.md5(F.col("section_text").cast("binary")).alias("digest"))


@entry("J4_neighbours", f"WITH {t.TURNS} SELECT section_id, chunk_idx, md5(string_agg(text, chr(10) || chr(10)) OVER w) AS digest, min(chunk_idx) OVER w AS first_idx, max(chunk_idx) OVER w AS last_idx FROM turns WINDOW w AS (PARTITION BY section_id ORDER BY chunk_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def j4(s, d):
    return library.with_neighbours(t.turns(s, d)).select("section_id", "chunk_idx", F.md5(F.col("context").cast("binary")).alias("digest"), "first_idx", "last_idx")


@entry("J8_exclude", f"{I} SELECT item_key FROM items WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8(s, d):
    return t.items(s, d).join(t.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select("item_key")


@entry("J9_in_library", "SELECT d.doc_id, l.doc_id IS NOT NULL AS in_library FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j9(s, d):
    known = t.table(s, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return t.table(s, d, "documents").join(known, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("in_library"))


TERMS_SQL = "terms AS (SELECT unnest(['the', 'tion', 'chlich', 'eau', 'ción']) AS term, unnest(['T1', 'T2', 'T3', 'T4', 'T5']) AS expansion)"


@entry("Q2_dictionary", f"WITH {TERMS_SQL} SELECT item_id AS query_id, expansion FROM benchmark, terms WHERE contains(lower(text), term)")
def q2(s, d):
    terms = s.createDataFrame([("the", "T1"), ("tion", "T2"), ("chlich", "T3"), ("eau", "T4"), ("ción", "T5")], "term string, expansion string")
    return expand.contained(t.passages(s, d), terms).select("query_id", "expansion")


@entry("Q7_assemble", f"WITH {TERMS_SQL}, l AS (SELECT item_id AS query_id, text, 1.0 AS weight, 'original' AS layer, 0 AS o FROM benchmark UNION ALL SELECT item_id, expansion, 0.4, 'dictionary', 1 FROM benchmark, terms WHERE contains(lower(text), term) UNION ALL SELECT item_id, 't1', 0.3, 'user', 3 FROM benchmark) SELECT query_id, text, weight::DOUBLE AS weight, layer FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY o, text) AS n FROM l) WHERE n = 1")
def q7(s, d):
    terms = s.createDataFrame([("the", "T1"), ("tion", "T2"), ("chlich", "T3"), ("eau", "T4"), ("ción", "T5")], "term string, expansion string")
    p = t.passages(s, d)
    layers = p.withColumn("layer", F.lit("original")).union(expand.contained(p, terms).select("query_id", F.col("expansion").alias("text"), F.lit("dictionary"))).union(p.select("query_id", F.lit("t1"), F.lit("user")))
    return expand.assembled(layers)


@entry("Q6_decompose", r"SELECT item_id AS query_id, part FROM (SELECT item_id, unnest(p) AS part FROM (SELECT item_id, list_filter(list_transform(string_split_regex(text, '\s+(?:and|or)\s+'), lambda x: trim(x)), lambda x: length(x) >= 6) AS p FROM benchmark WHERE length(text) >= 15) WHERE len(p) > 1)")
def q6(s, d):
    return t.passages(s, d).select("query_id", F.explode(expand.decomposed(F.col("text"))).alias("part"))


# --- aggregates, audits, diagnostics ---


@entry("A1_overview", f"WITH {t.CHUNKS}, n AS (SELECT length(text) AS n FROM chunks) SELECT count(*) AS n_chunks, min(n) AS shortest, max(n) AS longest, round(avg(n), 4) AS mean, (SELECT n FROM n ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM n)) AS median FROM n")
def a1(s, d):
    n = t.chunks(s, d).select(F.length("text").cast("long").alias("n"))
    one = n.agg(F.count("*").alias("n_chunks"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 4).alias("mean"))
    return one.crossJoin(measure.upper_median(n, "n"))


@entry("A2_top_papers", f"WITH {t.CHUNKS} SELECT item_key, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY item_key ORDER BY n DESC, item_key LIMIT 5")
def a2(s, d):
    return t.chunks(s, d).groupBy("item_key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")).orderBy(F.desc("n"), "item_key").limit(5)


@entry("A3_paper_inspection", f"WITH {t.CHUNKS} SELECT item_key, count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS n_short, min(length(text)) AS shortest, max(length(text)) AS longest FROM chunks GROUP BY item_key")
def a3(s, d):
    n = F.length("text").cast("long")
    return t.chunks(s, d).groupBy("item_key").agg(F.count("*").alias("n"), F.count_if(n < 200).alias("n_short"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


@entry(
    "A4_quality_score",
    f"WITH {t.CHUNKS}, q AS (SELECT item_key, count(*) AS n_chunks, count(*) FILTER (WHERE length(text) < 200) / count(*) AS sh, count(*) FILTER (WHERE length(text) >= 20 AND length(regexp_replace(text, '[\\x20-\\x7e\\s]', '', 'g')) > 0.4 * length(text)) / count(*) AS ga FROM chunks GROUP BY item_key)"
    " SELECT item_key, n_chunks, round(sh, 6) AS short_share, round(ga, 6) AS garbled_share, round(least(100.0, greatest(0.0, 100 - 40 * sh - 50 * ga - CASE WHEN n_chunks < 2 THEN 30 ELSE 0 END + CASE WHEN n_chunks >= 10 THEN 5 ELSE 0 END)), 2)::DOUBLE AS score FROM q",
)
def a4(s, d):
    return measure.quality(t.chunks(s, d), 200, T.is_garbled(F.col("text")))


@entry("A9_group_similarity", f"WITH {t.VECTORS}, p AS (SELECT a.item_key, list_dot_product(a.e, b.e) AS x FROM v a JOIN v b ON a.item_key = b.item_key AND a.id < b.id) SELECT item_key, round(avg(x), 6) AS mean_sim, round(stddev_pop(x), 5) AS std_sim FROM p GROUP BY item_key")
def a9(s, d):
    return measure.group_similarity(t.vectors(s, d)).select("item_key", F.round("mean_sim", 6).alias("mean_sim"), F.round("std_sim", 5).alias("std_sim"))


CENTROIDS_SQL = ", x AS (SELECT item_key, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT item_key, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT item_key, list(m ORDER BY i) AS c FROM m GROUP BY item_key)"


@entry("A10_similar_papers", f"WITH {t.VECTORS}{CENTROIDS_SQL} SELECT a.item_key AS key_a, b.item_key AS key_b, round(list_cosine_similarity(a.c, b.c), 6) AS sim FROM c a JOIN c b ON a.item_key < b.item_key ORDER BY sim DESC, key_a, key_b LIMIT 10")
def a10(s, d):
    return measure.similar_papers(t.vectors(s, d), 10).select("key_a", "key_b", F.round("sim", 6).alias("sim"))


@entry("A11_length_correlation", "SELECT round(corr(length(text), quality), 6) AS r FROM documents JOIN labels USING (doc_id)")
def a11(s, d):
    return t.table(s, d, "documents").join(t.table(s, d, "labels"), "doc_id").agg(F.round(F.coalesce(F.nanvl(F.corr(F.length("text").cast("double"), F.col("quality").cast("double")), F.lit(0.0)), F.lit(0.0)), 6).alias("r"))


@entry("A12_by_section", "SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std FROM conversations GROUP BY role")
def a12(s, d):
    n = F.length("text")
    return t.table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"))


@entry("A19_trace_stats", f"WITH {t.LOG} SELECT strategy, count(*) AS n, count(*) FILTER (WHERE NOT success) AS errors, round(avg(latency_ms), 1) AS mean_latency_ms FROM log GROUP BY strategy")
def a19(s, d):
    return measure.trace_stats(t.log(s, d))


MANIFESTS_SQL = "stored AS (SELECT doc_id::VARCHAR AS item_key, n_chars AS version FROM documents WHERE doc_id % 5 <> 0), now AS (SELECT doc_id::VARCHAR AS item_key, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS version FROM documents WHERE doc_id % 4 <> 0)"
DIFF_SQL = "diff AS (SELECT item_key, CASE WHEN s.version IS NULL THEN 'new' WHEN n.version IS NULL THEN 'deleted' WHEN s.version <> n.version THEN 'modified' ELSE 'unchanged' END AS status FROM stored s FULL JOIN now n USING (item_key))"


def _diff(s, d):  # noqa: ANN001, ANN202
    x = t.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_key"), F.col("n_chars").alias("version"))
    now = x.filter("doc_id % 4 <> 0").withColumn("version", F.col("version") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return library.sync_diff(x.filter("doc_id % 5 <> 0"), now)


@entry("U1_sync_diff", f"WITH {MANIFESTS_SQL}, {DIFF_SQL} SELECT item_key, status FROM diff")
def u1(s, d):
    return _diff(s, d)


@entry("A20_sync_report", f"WITH {MANIFESTS_SQL}, {DIFF_SQL} SELECT status, count(*) AS n FROM diff GROUP BY status")
def a20(s, d):
    return _diff(s, d).groupBy("status").agg(F.count("*").alias("n"))


@entry("A27_coverage", "SELECT doc_id, 'unindexed' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def a27(s, d):
    a, b = t.table(s, d, "documents").select("doc_id"), t.table(s, d, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").withColumn("side", F.lit("unindexed")).union(b.join(a, "doc_id", "left_anti").withColumn("side", F.lit("orphan")))


@entry("A28_health", f"WITH {t.LOG} SELECT CASE WHEN bool_and(success) THEN 'healthy' WHEN bool_or(strategy = 'fatal') THEN 'unhealthy' ELSE 'degraded' END AS health FROM log")
def a28(s, d):
    return t.log(s, d).agg(F.when(F.bool_and("success"), "healthy").when(F.bool_or(F.col("strategy") == "fatal"), "unhealthy").otherwise("degraded").alias("health"))


NORM = "regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g')"


@entry("A21_duplicates", f"{I}, g AS (SELECT list_sort(list(DISTINCT item_key)) AS keys, true AS has FROM items WHERE doi IS NOT NULL GROUP BY doi UNION ALL SELECT list_sort(list(DISTINCT item_key)), bool_or(doi IS NOT NULL) FROM items WHERE length({NORM}) > 10 GROUP BY {NORM}) SELECT array_to_string(keys, ',') AS keys, CASE WHEN bool_or(has) THEN 'doi_match' ELSE 'title_match' END AS reason FROM g WHERE len(keys) > 1 GROUP BY g.keys")
def a21(s, d):
    return library.duplicate_groups(t.items(s, d), T.normalised_title(F.col("title"))).withColumn("keys", F.array_join("keys", ","))


@entry("A22_dedup", f"{I} SELECT item_key FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(doi, substr(title, 1, 50)) ORDER BY doc_id) AS n FROM items) WHERE n = 1")
def a22(s, d):
    return library.deduplicated(t.items(s, d), F.coalesce("doi", F.substring("title", 1, 50)), [F.col("doc_id")]).select("item_key")


@entry("A23_recommend", "SELECT l_partkey AS item, count(*) AS n_seeds FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 50 = 0) GROUP BY 1 ORDER BY n_seeds DESC, item LIMIT 15")
def a23(s, d):
    o = t.table(s, d, "orders").filter("o_custkey % 50 = 0").select("o_orderkey", "o_custkey")
    x = t.table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    return x.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n_seeds")).orderBy(F.desc("n_seeds"), "item").limit(15)


@entry("A24_focus", f"WITH {t.LOG} SELECT user_id, 3 * count(*) FILTER (WHERE strategy = 'click') + 2 * count(*) FILTER (WHERE strategy = 'purchase') AS engagement FROM log GROUP BY user_id ORDER BY engagement DESC, user_id LIMIT 5")
def a24(s, d):
    n = lambda k: F.count(F.when(F.col("strategy") == k, 1))
    return t.log(s, d).groupBy("user_id").agg((3 * n("click") + 2 * n("purchase")).alias("engagement")).orderBy(F.desc("engagement"), "user_id").limit(5)


@entry("A25_topics", f"{I} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items) WHERE tag NOT LIKE '\\_%' ESCAPE '\\' GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def a25(s, d):
    return t.items(s, d).select(F.explode("tags").alias("tag")).filter(~F.col("tag").startswith("_")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


@entry("A26_reading_status", "SELECT status, count(*) AS n FROM (SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'user') >= 3 OR count(*) FILTER (WHERE role = 'system') >= 1 THEN 'deep_read' WHEN count(*) FILTER (WHERE role = 'user') >= 1 THEN 'browsed' ELSE 'unread' END AS status FROM conversations GROUP BY conv_id) GROUP BY status")
def a26(s, d):
    n = lambda k: F.count(F.when(F.col("role") == k, 1)).alias(k)
    per = t.table(s, d, "conversations").groupBy("conv_id").agg(n("user"), n("system"))
    return per.groupBy(library.reading_status(F.col("user"), F.col("system"), F.lit(False)).alias("status")).agg(F.count("*").alias("n"))


@entry("A29_citation_network", "SELECT o_custkey AS seed, l_partkey AS cited, place FROM (SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_partkey) AS place FROM (SELECT o_custkey, l_partkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE place <= 3")
def a29(s, d):
    o = t.table(s, d, "orders").select("o_orderkey", "o_custkey")
    q = t.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("q"), "l_partkey"))
    return q.withColumn("place", place).filter("place <= 3").select(F.col("o_custkey").alias("seed"), F.col("l_partkey").alias("cited"), long("place"))


@entry("A30_related", f"{I}, u AS (SELECT 1 AS pri, * FROM items WHERE doc_id % 2 = 0 UNION ALL SELECT 2, * FROM items WHERE doc_id % 3 = 0 UNION ALL SELECT 3, * FROM items) SELECT item_key, pri AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY pri, doc_id) AS n FROM u) WHERE doi IS NULL OR n = 1")
def a30(s, d):
    i = t.items(s, d)
    u = i.filter("doc_id % 2 = 0").withColumn("strategy", F.lit(1)).union(i.filter("doc_id % 3 = 0").withColumn("strategy", F.lit(2))).union(i.withColumn("strategy", F.lit(3)))
    return library.deduplicated(u, F.col("doi"), [F.col("strategy"), F.col("doc_id")]).select("item_key", "strategy")


@entry(
    "A31_publisher_quota",
    "WITH p AS (SELECT lang AS query_id, doc_id AS id, source AS publisher, n_chars::DOUBLE AS score FROM documents), o AS (SELECT *, CASE WHEN publisher = 'src3' THEN row_number() OVER (PARTITION BY query_id, publisher ORDER BY score DESC, id) END AS own FROM p),"
    " z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(own <= 2, false) DESC, score DESC, id) AS place FROM o) SELECT query_id, id, publisher FROM z WHERE place <= 10",
)
def a31(s, d):
    rows = t.table(s, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("publisher"), F.col("n_chars").cast("double").alias("score"))
    return library.publisher_quota(rows, "src3", 10).select("query_id", "id", "publisher")


VOTES_SQL = "votes AS (SELECT user_id AS doi, CASE WHEN value < 20 THEN true WHEN value < 60 THEN NULL ELSE false END AS found FROM events)"


@entry("A32_verify", f"WITH {VOTES_SQL} SELECT doi, coalesce(bool_or(found), false) OR NOT bool_and(coalesce(found = false, false)) AS keep FROM votes GROUP BY doi")
def a32(s, d):
    v = F.col("value")
    return library.verified(t.table(s, d, "events").select(F.col("user_id").alias("doi"), F.when(v < 20, True).when(v < 60, F.lit(None)).otherwise(False).alias("found")))


# --- top-k ---


@entry("O1_topk", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def o1(s, d):
    return t.table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "n_chars")


@entry("O3_two_keys_desc", "SELECT doc_id FROM documents ORDER BY lang DESC, doc_id DESC LIMIT 30")
def o3(s, d):
    return t.table(s, d, "documents").orderBy(F.desc("lang"), F.desc("doc_id")).limit(30).select("doc_id")


@entry("O5_recent_traces", f"WITH {t.LOG} SELECT trace_id FROM log WHERE success ORDER BY ts DESC, trace_id DESC LIMIT 20")
def o5(s, d):
    return t.log(s, d).filter("success").orderBy(F.desc("ts"), F.desc("trace_id")).limit(20).select("trace_id")


@entry("X1_indexed_items", f"WITH {t.CHUNKS} SELECT count(DISTINCT item_key) AS items, count(*) AS n FROM chunks")
def x1(s, d):
    return t.chunks(s, d).agg(F.countDistinct("item_key").alias("items"), F.count("*").alias("n"))


@entry("U4_ordered_union", "SELECT tag, min(o) AS first_seen FROM (SELECT source AS tag, doc_id AS o FROM documents UNION ALL SELECT lang, doc_id FROM documents) GROUP BY tag")
def u4(s, d):
    x = t.table(s, d, "documents")
    return x.select(F.col("source").alias("tag"), F.col("doc_id").alias("o")).union(x.select("lang", "doc_id")).groupBy("tag").agg(F.min("o").alias("first_seen"))


@entry("U5_edit_tags", f"{I} SELECT item_key, array_to_string(list_sort(list_filter(list_distinct(list_concat(tags, ['new', 'en'])), lambda x: x <> 'src3')), ',') AS after FROM items")
def u5(s, d):
    e = library.edited_tags(F.col("tags"), F.array(F.lit("new"), F.lit("en")), F.array(F.lit("src3")))
    return t.items(s, d).select("item_key", F.array_join(e["after"], ",").alias("after"))


# --- scalars ---


@entry("T1_parse_year", r"SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '(?:^|[^0-9A-Za-z_])([0-9]{4})(?:$|[^0-9A-Za-z_])', 1), '') AS INT), 0) AS year FROM documents")
def t1(s, d):
    return t.table(s, d, "documents").select("doc_id", T.parse_year(F.col("text")).alias("year"))


@entry("T2_normalised_title", f"{I} SELECT item_key, {NORM} AS norm FROM items")
def t2(s, d):
    return t.items(s, d).select("item_key", T.normalised_title(F.col("title")).alias("norm"))


PEOPLE = "people AS (SELECT c_custkey, list_slice(string_split(c_name || '#' || c_custkey || '#Ann Lee', '#'), 1, (c_custkey % 4)::INT) AS authors, (c_custkey % 3 * 1000)::INT AS year, (c_custkey % 2 * 7)::INT AS page FROM customer)"


def _people(s, d):  # noqa: ANN001, ANN202
    k = F.col("c_custkey")
    every = F.array_compact(F.concat(F.split(F.concat_ws("#", "c_name", k.cast("string"), F.lit("Ann Lee")), "#")))
    return t.table(s, d, "customer").select("c_custkey", F.slice(every, F.lit(1), (k % 4).cast("int")).alias("authors"), (k % 3 * 1000).cast("int").alias("year"), (k % 2 * 7).cast("int").alias("page"))


@entry("T5_short_authors", f"WITH {PEOPLE} SELECT c_custkey, CASE len(authors) WHEN 0 THEN '' WHEN 1 THEN authors[1] WHEN 2 THEN authors[1] || ' & ' || authors[2] ELSE authors[1] || ' et al.' END AS who FROM people")
def t5(s, d):
    return _people(s, d).select("c_custkey", names.short_authors(F.col("authors")).alias("who"))


@entry("T6_citation", f"WITH {PEOPLE}, z AS (SELECT *, list_transform(authors, lambda x: string_split(x, ' ')[-1]) AS l FROM people) SELECT c_custkey, '(' || CASE len(l) WHEN 0 THEN 'Unknown' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' & ' || l[2] ELSE l[1] || ' et al.' END || ', ' || CASE WHEN year > 0 THEN year::VARCHAR ELSE 'n.d.' END || CASE WHEN page > 0 THEN ', p.' || page ELSE '' END || ')' AS cite FROM z")
def t6(s, d):
    return _people(s, d).select("c_custkey", names.inline_citation(F.col("authors"), F.col("year"), F.col("page")).alias("cite"))


@entry("T11_identifier", f"{I} SELECT item_key, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN doc_id % 2 = 0 THEN 'url' ELSE 'isbn' END AS kind FROM items")
def t11(s, d):
    x = F.coalesce("doi", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.org/"), "item_key")).otherwise("978-3-16-148410-0"))
    return t.items(s, d).select("item_key", names.identifier_kind(x).alias("kind"))


@entry("T15_doi_from_url", r"SELECT page_id, nullif(regexp_extract(url, '(10\.[0-9]{4,9}/[^\s?#<>]+)', 1), '') AS doi FROM pages")
def t15(s, d):
    return t.table(s, d, "pages").select("page_id", names.doi_from_url(F.col("url"), F.col("html")).alias("doi"))


@entry("T16_strip_html", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def t16(s, d):
    return t.table(s, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("digest"))


@entry("T22_escape_html", "SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS n FROM pages")
def t22(s, d):
    return t.table(s, d, "pages").select("page_id", F.length(T.escape_html(F.col("html"))).cast("long").alias("n"))


@entry("T25_merge_key", f"{I} SELECT item_key, coalesce('doi:' || lower(nullif(trim(doi), '')), source || ':' || nullif(CASE WHEN doc_id % 2 = 0 THEN item_key ELSE '' END, ''), 'title:' || substr(lower(trim(title)), 1, 120)) AS merge_key FROM items")
def t25(s, d):
    sid = F.when(F.col("doc_id") % 2 == 0, F.col("item_key")).otherwise("")
    return t.items(s, d).select("item_key", names.merge_key(F.col("doi"), F.col("source"), sid, F.col("title")).alias("merge_key"))


CUES = {"supporting": ("the", "worthless"), "opposing": ("idiot", "ing"), "neutral": ("and",)}


@entry("T13_stance", r"SELECT doc_id, p AS pos, n AS neg, CASE WHEN p > n AND p > u THEN 'supporting' WHEN n > p AND n > u THEN 'opposing' ELSE 'neutral' END AS stance FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\b(?:the|worthless)\b')) AS p, len(regexp_extract_all(lower(text), '\b(?:idiot|ing)\b')) AS n, len(regexp_extract_all(lower(text), '\b(?:and)\b')) AS u FROM documents)")
def t13(s, d):
    x = t.table(s, d, "documents").select("doc_id", T.stance_counts(F.col("text"), **CUES).alias("c"))
    return x.select("doc_id", F.col("c.pos").cast("long").alias("pos"), F.col("c.neg").cast("long").alias("neg"), T.stance(F.col("c")).alias("stance"))


@entry("R21_arguments", r"SELECT stance, count(*) AS n FROM (SELECT CASE WHEN p > n AND p > u THEN 'supporting' WHEN n > p AND n > u THEN 'opposing' ELSE 'neutral' END AS stance FROM (SELECT len(regexp_extract_all(lower(text), '\b(?:the|worthless)\b')) AS p, len(regexp_extract_all(lower(text), '\b(?:idiot|ing)\b')) AS n, len(regexp_extract_all(lower(text), '\b(?:and)\b')) AS u FROM documents)) GROUP BY stance")
def r21(s, d):
    return t13(s, d).groupBy("stance").agg(F.count("*").alias("n"))


@entry("T14_suggest_tags", "SELECT doc_id, array_to_string(list_filter(['idiot', 'the', 'eau'], lambda x: contains(lower(text), x)), ',') AS tags FROM documents")
def t14(s, d):
    low = F.lower("text")
    return t.table(s, d, "documents").select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, ("idiot", "the", "eau"))), lambda x: low.contains(x)), ",").alias("tags"))


@entry("T8_stars", f"WITH {t.LOG} SELECT trace_id, CASE strategy WHEN 'click' THEN '★★★' WHEN 'purchase' THEN '★★' ELSE '★' END AS stars FROM log")
def t8(s, d):
    tier = F.when(F.col("strategy") == "click", "high").when(F.col("strategy") == "purchase", "medium").otherwise("low")
    return t.log(s, d).select("trace_id", names.stars(tier).alias("stars"))


# --- traces by time ---


@entry("W1_window_stats", f"WITH {t.LOG} SELECT date_trunc('hour', ts) AS hour, strategy, count(*) AS n, round(avg(latency_ms), 4) AS mean_latency_ms FROM log GROUP BY ALL")
def w1(s, d):
    from quarry.streaming.traces import hourly

    return hourly(t.log(s, d)).select("hour", "strategy", "n", F.round("mean_latency_ms", 4).alias("mean_latency_ms"))


@entry("W2_retention", f"WITH {t.LOG} SELECT date_trunc('day', ts) AS day, count(*) AS n FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 10 DAY GROUP BY ALL")
def w2(s, d):
    log = t.log(s, d)
    last = log.agg(F.max("ts").alias("last"))
    return log.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 10 DAYS")).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
