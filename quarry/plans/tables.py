"""How the driver's tables stand for the library's entities, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.session import spread

TYPES = ("attachment", "note", "annotation", "article", "book", "thesis", "report")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is an item: title its first line, tags its language and source, every third with one of 200 DOIs."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("item_key"),
        d.alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang", "source").alias("tags"),
        F.array("source").alias("collections"),
        F.when(d % 11 == 0, 0).otherwise(1990 + d % 36).cast("int").alias("year"),
        F.when(d % 3 == 0, F.concat(F.lit("10.1000/"), (d % 200).cast("string"))).alias("doi"),
        F.get(F.array(*map(F.lit, TYPES)), (d % 7).cast("int")).alias("item_type"),
        "lang",
        "source",
        F.col("n_chars").alias("version"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select(F.col("doc_id").cast("string").alias("item_key"), F.lit(1).alias("page_num"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.sliding(pages(spark, sf_dir), short=chunking.SHORT)
    return rows.withColumn("chunk_id", F.concat_ws(":", "item_key", F.col("chunk_idx").cast("string")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("item_key"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches ask for every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("id % 50 = 0").withColumnRenamed("id", "query_id")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), "ts", F.col("event_type").alias("strategy"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), "user_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("chunk_idx"), "role", "text")


ITEMS = """items AS (SELECT doc_id::VARCHAR AS item_key, doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, [lang, source] AS tags,
  [source] AS collections, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1990 + doc_id % 36 END::INT AS year,
  CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || (doc_id % 200)::VARCHAR END AS doi,
  ['attachment','note','annotation','article','book','thesis','report'][(doc_id % 7)::INT + 1] AS item_type, lang, source, n_chars AS version FROM documents)"""
WINDOWS = r"""windows AS (SELECT * FROM (SELECT item_key, k::INT AS chunk_idx, regexp_replace(substr(body, k * 480 + 1, 600), '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT item_key, body, unnest(generate_series(0, greatest(0, ceil((length(body) - 600) / 480.0))::BIGINT)) AS k
    FROM (SELECT doc_id::VARCHAR AS item_key, text || chr(10) AS body FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0))) WHERE text <> '')"""
CHUNKS = (
    WINDOWS
    + r""", seen AS (SELECT *, lead(text) OVER w AS after, lead(chunk_idx, 2) OVER w IS NULL AS is_last, lag(text) OVER w AS before FROM windows WINDOW w AS (PARTITION BY item_key ORDER BY chunk_idx)),
chunks AS (SELECT item_key, chunk_idx, item_key || ':' || chunk_idx AS chunk_id,
  CASE WHEN is_last AND after IS NOT NULL AND length(after) < 200 THEN text || chr(10) || chr(10) || after ELSE text END AS text
  FROM seen WHERE NOT (after IS NULL AND before IS NOT NULL AND length(text) < 200))"""
)
POSTINGS = (
    CHUNKS
    + r""", tok AS (SELECT chunk_id, item_key, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM chunks),
posted AS (SELECT token, chunk_id, item_key, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '[a-z]{2,}')) AS dl FROM chunks),
df AS (SELECT token, count(*) AS df FROM posted GROUP BY token),
raw AS (SELECT token, df, ln((SELECT count(*) FROM stats) - df + 0.5) - ln(df + 0.5) AS r FROM df),
idf AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
)
HITS = (
    POSTINGS
    + r""", asked AS (SELECT item_id AS query_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM benchmark) GROUP BY ALL),
hits AS (SELECT query_id, chunk_id, item_key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM stats)))) AS score
  FROM asked JOIN idf USING (token) JOIN posted USING (token) JOIN stats USING (chunk_id) GROUP BY ALL HAVING score > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM hits) WHERE rank <= 50),
papers AS (SELECT query_id, item_key, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, item_key ORDER BY rank) AS n FROM best) WHERE n = 1)"""
)
VECTORS = """v AS (SELECT vec_id AS id, label::VARCHAR AS item_key, embedding::DOUBLE[] AS e FROM embeddings),
vq AS (SELECT id AS query_id, item_key AS own, e AS qe FROM v WHERE id % 50 = 0)"""
LOG = "log AS (SELECT event_id AS trace_id, ts, event_type AS strategy, event_type <> 'error' AS success, value AS latency_ms, user_id FROM events)"
TURNS = "turns AS (SELECT conv_id AS section_id, turn AS chunk_idx, role, text FROM conversations)"
