"""Query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Weights of the layers, in order.
LAYERS = {"original": 1.0, "dictionary": 0.4, "tags": 0.3, "user": 0.3, "translation": 0.8, "decomposed": 0.2}
# fixed values: English words, and Chinese characters, that say nothing alone; particles at which long Chinese runs part
STOP = (
    "the a an in on of to for with by from at is are was were be been being and or not this that these those it its as but if than then so do does did "
    "has have had will would can could may might shall should about between through during into over after before under above how what which where when "
    "who whom whose why all both each few more most other some such no nor any study research paper analysis based using approach method model framework "
    "effect effects impact influence role"
).split()
STOP_CHARACTERS = "的了是在有不这我他她它们你个中大上为以及与对其可被从而所也就都已将会能把要让用着到过没很还因但如果虽然所如何什么怎那些通过进行研究分析基于本文探讨影响素机制作用视角下理论方法模型框架"
PARTICLES = "的了是在有对与及其"


def contained(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, expansion, for dictionary terms (term, expansion) that occur inside the query (query_id, text).

    A substring of up to LONGEST characters is what can be a term, so each query's substrings of the terms' lengths join by
    equality; nothing is compared pair by pair."""
    low = F.lower("text")
    lengths = terms.select(F.length("term").alias("size")).distinct()
    # as many rows as terms have different lengths
    each = queries.select("query_id", low.alias("low")).crossJoin(F.broadcast(lengths)).filter(F.length("low") >= F.col("size"))
    parts = each.select("query_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("size") + 1), lambda i: F.substr(F.col("low"), i, F.col("size"))))).alias("part"))
    return parts.join(terms.withColumn("key", F.lower("term")), F.col("part") == F.col("key")).select("query_id", "term", "expansion")


def decomposed(text: Column, parity: bool = False) -> Column:
    """Parts of 6 characters or more of a query of 15 or more, split at conjunctions; parity splits inside words too."""
    words = r"\s*(?:and|or|与|和|及|以及)\s*" if parity else r"\s+(?:and|or)\s+|\s*(?:与|和|及|以及)\s*"
    parts = F.filter(F.transform(F.split(text, words), lambda x: F.trim(x)), lambda x: F.length(x) >= 6)
    return F.when((F.length(text) >= 15) & (F.size(parts) > 1), parts).otherwise(F.array().cast("array<string>"))


def assembled(layers: DataFrame) -> DataFrame:
    """query_id, text, weight, layer of (query_id, text, layer name): the first layer of equal texts, in any case, counts."""
    order = F.create_map(*(F.lit(x) for i, k in enumerate(LAYERS) for x in (k, i)))
    weight = F.create_map(*(F.lit(x) for k, w in LAYERS.items() for x in (k, w)))
    w = Window.partitionBy("query_id", F.lower("text")).orderBy(order[F.col("layer")], "text")
    return layers.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "text", weight[F.col("layer")].alias("weight"), "layer")


def terms(text: Column) -> Column:
    """Distinct words of three characters or more that begin with a Latin letter and aren't stop words, in order, lower-cased."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][\w-]*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) > 2) & ~x.isin(*STOP)))


def chinese_terms(text: Column) -> Column:
    """Runs between punctuation of 2 to 8 characters, longer ones parted at particles first; those of stop characters alone
    are left out."""
    runs = F.filter(F.split(text, r"[，。、；：！？\s,;:!?\-—–/()（）【】\[\]\"'“”‘’]+"), lambda x: x != "")
    parts = F.flatten(F.transform(runs, lambda x: F.when(F.length(x) <= 8, F.array(x)).otherwise(F.split(x, f"[{PARTICLES}]"))))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x).between(2, 8) & ~x.rlike(f"^[{STOP_CHARACTERS}]+$"))


def tag_expansions(queries: DataFrame, tags: DataFrame, parity: bool = False) -> DataFrame:
    """query_id, expansion of the library's tags (tag) that share a word with a query (query_id, text) and aren't in it.

    With parity only tags that the query contains count, none of which can be new, so there are none. Queries in English
    get no Chinese tags. A query and a tag meet on their words, so no pair is formed that shares none."""
    if parity:
        return queries.select("query_id", F.lit("").alias("expansion")).filter("false")
    asked = queries.select("query_id", F.lower("text").alias("low"), T.query_language(F.col("text")).alias("language"), F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    known = tags.select(F.trim("tag").alias("tag")).distinct().select("tag", F.explode(F.array_distinct(words(F.col("tag")))).alias("word"))
    both = asked.join(known, "word").filter(~F.col("low").contains(F.lower("tag")) & ~((F.col("language") == "en") & F.col("tag").rlike(T.CJK)))
    return both.select("query_id", F.col("tag").alias("expansion")).distinct()


def words(text: Column) -> Column:
    """What tags and queries meet on: terms, and pairs of Chinese characters."""
    return F.concat(terms(text), F.filter(T.tokens(text), lambda x: (F.length(x) == 2) & x.rlike(T.CJK)))


def seed_queries(seeds: DataFrame, most: int = 8) -> DataFrame:
    """query_id, ordinal, text of seeds (query_id, title, keywords): pairs of the first five keywords, then keywords of several words (four at most), then the title's terms; equal ones once, `most` at most."""
    k = F.slice("keywords", 1, 5)
    pairs = F.flatten(F.transform(k, lambda a, i: F.transform(F.filter(k, lambda b, j: j > i), lambda b: F.concat_ws(" ", a, b))))
    multi = F.slice(F.filter("keywords", lambda x: x.contains(" ")), 1, 4)
    title = F.array(F.array_join(F.slice(terms(F.col("title")), 1, 6), " "))
    every = F.slice(F.array_distinct(F.filter(F.concat(pairs, multi, title), lambda x: x != "")), 1, most)
    return seeds.select("query_id", F.posexplode(every).alias("ordinal", "text"))


def relevance(text: Column, wanted: Column) -> Column:
    """The share of wanted terms that the text contains; 1 without terms."""
    low = F.lower(text)
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.filter(wanted, lambda t: low.contains(F.lower(t)))) / n).otherwise(1.0)
