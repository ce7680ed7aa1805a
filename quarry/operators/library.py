"""Items, their metadata joins, sync, duplicates and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NON_PAPERS = ("attachment", "note", "annotation")


def enriched(hits: DataFrame, papers: DataFrame, sections: DataFrame) -> DataFrame:
    """hits with the paper's title and first 500 characters of abstract, and the section of the chunk where there is one."""
    p = papers.select("item_key", "title", F.substring("abstract", 1, 500).alias("abstract"))
    return hits.join(p, "item_key").join(sections, ["item_key", "section_idx"], "left")


def with_section(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (section_id, chunk_idx) with all text of the section, in order, blank lines between."""
    whole = chunks.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("c"))
    return hits.join(whole.select("section_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("section_text")), "section_id")


def with_neighbours(chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each chunk with the text of those up to n places away in its section, and their first and last place."""
    w = Window.partitionBy("section_id").orderBy("chunk_idx").rangeBetween(-n, n)
    near = F.array_sort(F.collect_list(F.struct("chunk_idx", "text")).over(w))
    return chunks.withColumn("near", near).select("section_id", "chunk_idx", F.array_join(F.transform("near", lambda x: x["text"]), "\n\n").alias("context"), F.element_at("near", 1)["chunk_idx"].alias("first_idx"), F.element_at("near", -1)["chunk_idx"].alias("last_idx"))


def replaced(stored: DataFrame, fresh: DataFrame, key: str = "item_key") -> DataFrame:
    """stored with all rows of the items in fresh replaced by those of fresh."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without(stored: DataFrame, gone: DataFrame, key: str = "item_key") -> DataFrame:
    return stored.join(gone.select(key), key, "left_anti")


def sync_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """item_key, status (new, modified, deleted, unchanged) of two manifests (item_key, version)."""
    both = stored.select("item_key", F.col("version").alias("old")).join(current.select("item_key", F.col("version").alias("now")), "item_key", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") != F.col("now"), "modified").otherwise("unchanged")
    return both.select("item_key", status.alias("status"))


def needs_rebuild(stored: tuple[str, str], now: tuple[str, str]) -> bool:
    """Whether a stored, non-empty model or chunking version differs from the one in use."""
    return any(a and a != b for a, b in zip(stored, now, strict=True))


def duplicate_groups(items: DataFrame, title: Column) -> DataFrame:
    """keys (sorted), reason: items with one DOI, or one normalised title of more than 10 characters; equal groups once."""
    named = items.select("item_key", F.lower(F.nullif(F.trim("doi"), F.lit(""))).alias("doi"), title.alias("norm"))
    by = lambda c, ok: named.filter(ok).groupBy(c).agg(F.array_sort(F.collect_set("item_key")).alias("keys"), F.max(F.col("doi").isNotNull()).alias("has"))
    both = by("doi", F.col("doi").isNotNull()).select("keys", "has").union(by("norm", F.length("norm") > 10).select("keys", "has"))
    return both.filter(F.size("keys") > 1).groupBy("keys").agg(F.max("has").alias("has")).select("keys", F.when(F.col("has"), "doi_match").otherwise("title_match").alias("reason"))


def deduplicated(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("n__", F.when(key.isNull(), 1).otherwise(F.row_number().over(w))).filter("n__ = 1").drop("n__")


def verified(votes: DataFrame) -> DataFrame:
    """doi, keep of votes (doi, found): any true keeps, all false rejects, anything unknown keeps."""
    return votes.groupBy("doi").agg(F.coalesce(F.max("found"), F.lit(False)).alias("any"), F.min(F.coalesce(F.col("found") == False, F.lit(False))).alias("all_false")).select("doi", (F.col("any") | ~F.col("all_false")).alias("keep"))  # noqa: E712


def year_range(year: Column, low: int | None, high: int | None, keep_unknown: bool = False) -> Column:
    """Within the bounds, which are inclusive. Year 0 is unknown: dropped if there is a bound, unless kept."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    bounded = low is not None or high is not None
    return ((year == 0) | ok) if keep_unknown else (ok & (year > 0) if bounded else ok)


def has_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def has_none(tags: Column, unwanted: list[str]) -> Column:
    return ~F.arrays_overlap(tags, F.array(*map(F.lit, unwanted)))


def edited_tags(tags: Column, add: Column, remove: Column) -> Column:
    """struct(after, to_add, to_remove), sorted."""
    after = F.array_sort(F.array_except(F.array_union(tags, add), remove))
    return F.struct(after.alias("after"), F.array_sort(F.array_except(after, tags)).alias("to_add"), F.array_sort(F.array_except(tags, after)).alias("to_remove"))


def reading_status(annotations: Column, notes: Column, opened: Column) -> Column:
    return F.when((annotations >= 3) | (notes >= 1), "deep_read").when((annotations >= 1) | opened, "browsed").otherwise("unread")


def merged_items(members: DataFrame) -> DataFrame:
    """keeper, tags, collections of members (keeper, item_key, tags, collections): unions, sorted."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return members.groupBy("keeper").agg(every("tags"), every("collections"), F.count("*").alias("n_items"))


def publisher_quota(scored: DataFrame, publisher: str, limit: int) -> DataFrame:
    """The best `limit` rows (query_id, id, publisher, score), of which min(2, max(1, limit // 5)) at least are the publisher's, if it has as many."""
    quota = min(2, max(1, limit // 5))
    mine = F.col("publisher") == publisher
    by = Window.partitionBy("query_id")
    order = [F.col("score").desc(), F.col("id")]
    placed = scored.withColumn("own", F.when(mine, F.row_number().over(Window.partitionBy("query_id", "publisher").orderBy(*order))))
    first = placed.withColumn("sure", F.coalesce(F.col("own") <= quota, F.lit(False)))
    return first.withColumn("place", F.row_number().over(by.orderBy(F.col("sure").desc(), *order))).filter(F.col("place") <= limit).drop("own", "sure", "place")


def cited_records(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Each citation (item_key, chunk_idx, ref) with the table or figure (item_key, ref, body) of that number in its item, once."""
    return refs.distinct().join(records, ["item_key", "ref"])


def fetch_depth(limit: Column) -> Column:
    """How many hits to ask of each source for `limit` merged ones."""
    return F.least(F.greatest(3 * limit, F.lit(30)), F.lit(50))


def recommended(seeds: DataFrame, related: DataFrame, similar: DataFrame) -> DataFrame:
    """seed, hit, source of seeds (seed, doi) and the edges of two sources (doi, hit), one after the other; seeds without a
    DOI have none."""
    edges = related.withColumn("source", F.lit("related")).unionByName(similar.withColumn("source", F.lit("similar")))
    return seeds.filter(F.coalesce(F.trim("doi"), F.lit("")) != "").join(edges, "doi").select("seed", "hit", "source")


def with_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items that have a file, with the url of the first (item_key, place, url)."""
    return items.join(files.groupBy("item_key").agg(F.min_by("url", "place").alias("url")), "item_key")


def first_open(candidates: DataFrame, stages: list[str]) -> DataFrame:
    """item_key, stage, url: of the places where an open copy may be (item_key, stage, url), the first stage that has a url.

    Stages that aren't named don't count."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    known = candidates.withColumn("place", place).filter((F.col("place") > 0) & (F.coalesce(F.trim("url"), F.lit("")) != ""))
    return known.groupBy("item_key").agg(F.min_by(F.struct("stage", "url"), F.struct("place", "url")).alias("x")).select("item_key", "x.stage", "x.url")
