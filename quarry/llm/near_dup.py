"""Near-duplicate groups (operator 2) by an LSH forest over MinHash signatures.

1. A text's set of word shingles is hashed; texts with equal sets are one class, named by its least doc_id. Only class
   representatives go on.
2. The signature has TREES orders of DEPTH values. In each order representatives are sorted; those that agree on the
   first BASE values form a region. A pair at similarity 0.8 shares a region in some order but for 3 in a million.
3. Candidates are a row's next NEAR rows in the sorted region. In a region of more rows its depth adapts: of the next WIDE
   rows only those with a longer common prefix than the WIDE-th one stay, FEW of them at least. Rows of wide regions are also
   paired with the region's hub at three depths, the member that shares most regions, which is what copies of one
   original have in common. Very large regions sort in parts by deeper prefix.
4. Signatures discard pairs far below the threshold; the rest are confirmed on full sets.
5. Links give components. Then the exact way for what step 3 leaves of wide regions: the members of regions that hold
   several components are joined on the rarest hashes of their full sets (see `across`), which finds every pair at the
   threshold; pairs within a component need no comparison, since only components are asked for. Look-alikes below the
   threshold share none of those hashes, so pages of one template cost what their words cost, not what their pairs do.

Shingles are compared by 64-bit hashes: two different shingles are taken for equal with a chance of 5e-20 a pair.

Defined results: texts without words, null or empty, link with nothing and have 0 shingles; a null doc_id links with
nothing, has a null component and is kept; rows that repeat a doc_id are one document, which has the links of all its
texts; texts of any length are read whole; an empty table gives an empty result; other columns are ignored, and
`deduplicated` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import components
from quarry.llm.shingles import MinHash, shingle_set

TREES, DEPTH, BASE, NEAR, WIDE, FEW = 24, 8, 4, 16, 6, 2
HUB_DEPTHS = (4, 6, 8)
#: Rows of a region that are sorted as one.
REGION = 4096
#: Rows of a block when a hash's bearers are compared in blocks.
BLOCK = 1024
KEY_BYTES = 2 * DEPTH


@cache
def _minhash() -> MinHash:
    return MinHash(TREES * DEPTH)


def least_agreeing(percent: int) -> int:
    """Agreeing signature values under which a pair is dropped: 4.2 standard deviations below the threshold's mean."""
    p, n = percent / 100, TREES * DEPTH
    return int(n * p - 4.2 * (n * p * (1 - p)) ** 0.5)


def _sign(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    common.enter("near_dup")
    for frame in common.chunks(frames):
        sizes, digests, signatures = [], [], []
        for name, text in zip(frame["doc_id"].tolist(), common.texts(frame), strict=True):
            s = shingle_set(text, k)
            used = len(s) and name is not None
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if used else None)
            signatures.append(_minhash()(s).tobytes() if used else None)
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_shingles": sizes, "digest": digests, "signature": signatures})


def _sets(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    common.enter("near_dup")
    for frame in common.chunks(frames):
        yield pd.DataFrame({"node": frame["node"].to_numpy(), "hashes": [shingle_set(x, k).tobytes() for x in common.texts(frame)]})


def _alike(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            a, b = (np.frombuffer(b"".join(frame[x]), "<u2").reshape(len(frame), -1) for x in ("sa", "sb"))
            yield frame.loc[(a == b).sum(axis=1) >= least, ["a", "b"]]


def _confirm(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keep = []
        for x, y in zip(frame["ha"], frame["hb"], strict=True):
            a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            common_size = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common_size >= percent * (len(a) + len(b) - common_size))
        yield frame.loc[np.array(keep, bool), ["a", "b"]]


def _hashes(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """sid names a node's set: rows that repeat a doc_id may have several."""
    common.enter("near_dup")
    for frame in common.chunks(frames):
        sets = [shingle_set(x, k) for x in common.texts(frame)]
        sids = [xxhash.xxh3_64_intdigest(x.tobytes(), seed=int(n) & (1 << 63) - 1) for n, x in zip(frame["node"], sets, strict=True)]
        yield pd.DataFrame({"node": frame["node"].to_numpy(), "component": frame["component"].to_numpy(), "sid": np.array(sids, np.uint64).view(np.int64), "n": [len(x) for x in sets], "hashes": [x.view(np.int64) for x in sets]})


class Forest:
    """One run over one table of documents; holds its scratch tables."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.spark, self.k, self.percent = docs.sparkSession, k, percent
        self.paths: list[str] = []
        self.large: list[str] = []
        common.ship(self.spark)
        self.docs = docs.select("doc_id", "text")
        named = self.docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        signed = named.mapInPandas(partial(_sign, k=k), "doc_id string, n_shingles long, digest binary, signature binary")
        self.signed = self.settle(signed.withColumn("doc_id", F.col("doc_id").cast("long")))

    def settle(self, df: DataFrame) -> DataFrame:
        return common.settle(df, self.paths)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Drops the scratch tables but these."""
        held = {common.path_of(x) for x in tables}
        gone = [x for x in self.paths if x not in held]
        common.drop(self.spark, gone)

    def classes(self) -> None:
        """members: doc_id, n_shingles, node; nodes: node, n, signature of class representatives."""
        sets = self.signed.filter("digest is not null")
        self.copies = self.settle(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).filter("n > 1").drop("n"))
        self.members = self.signed.join(common.small(self.copies), "digest", "left").withColumn("node", F.coalesce("node", "doc_id"))
        # rows that repeat a doc_id and text would be in twice, which adds no pairs that matter
        self.nodes = self.settle(self.members.filter("digest is not null and node = doc_id").select("node", F.col("n_shingles").alias("n"), "signature"))
        self.members = self.members.select("doc_id", "n_shingles", "node", F.col("digest").isNotNull().alias("used"))

    def regions(self) -> None:
        """runs: a row for each order and node whose region has company; n is the region's size."""
        tree = self.nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        tree = tree.select("node", "tree", F.expr(f"substring(signature, tree * {KEY_BYTES} + 1, {KEY_BYTES})").alias("key"))
        tree = tree.select("node", "tree", "key", F.xxhash64("tree", F.expr(f"substring(key, 1, {2 * BASE})")).alias("region"))
        sizes = self.settle(tree.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1"))
        self.runs = self.settle(tree.join(common.small(sizes), "region"))
        self.wide = self.settle(self.runs.filter(F.col("n") > NEAR + 1))

    def candidates(self) -> DataFrame:
        part = F.when(F.col("n") > REGION, F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / REGION)))).otherwise(F.lit(0))
        ahead = Window.partitionBy("region", "part").orderBy("key", "node").rowsBetween(1, NEAR)
        next_ = F.collect_list(F.struct("node", "key")).over(ahead)

        def prefix(other: Column) -> Column:
            """Values that the row's key and another of its region agree on from the first."""
            out = F.lit(BASE)
            for d in range(BASE + 1, DEPTH + 1):
                out = F.when(F.substring(F.col("key"), 1, 2 * d) == F.substring(other["key"], 1, 2 * d), d).otherwise(out)
            return out

        near = self.runs.withColumn("part", part).select("node", "key", next_.alias("next"), "n")
        near = near.withColumn("next", F.when(F.col("n") > NEAR + 1, F.slice("next", 1, WIDE)).otherwise(F.col("next")))
        # the rows ahead go from the longest common prefix to the shortest; with all WIDE there, more may follow
        shared = F.transform("next", lambda x: F.struct(x["node"].alias("node"), prefix(x).alias("common")))
        near = near.select("node", F.when((F.col("n") > NEAR + 1) & (F.size("next") == WIDE), shared).alias("shared"), F.transform("next", lambda x: x["node"]).alias("others"))
        deeper = F.filter("shared", lambda x, i: (i < FEW) | (x["common"] > F.element_at("shared", -1)["common"]))
        near = near.select("node", F.explode(F.when(F.col("shared").isNotNull(), F.transform(deeper, lambda x: x["node"])).otherwise(F.col("others"))).alias("other"))
        # hubs: the member that shares most regions, at each depth
        fame = self.wide.groupBy("node").agg(F.sum("n").alias("fame"))
        famed = self.wide.join(fame, "node").withColumn("depth", F.explode(F.array(*map(F.lit, HUB_DEPTHS))))
        famed = famed.select("node", "fame", F.xxhash64("region", "depth", F.expr("substring(key, 1, 2 * depth)")).alias("place"))
        hubs = famed.groupBy("place").agg(F.max(F.struct("fame", (-F.col("node")).alias("minus"))).alias("hub"), F.count("*").alias("n")).filter(F.col("n") > NEAR + 1)
        hub = famed.join(hubs, "place").select("node", (-F.col("hub.minus")).alias("other"))
        pairs = near.union(hub).filter("node <> other")
        return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures leave the threshold in reach."""
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
        return self.settle(both.mapInPandas(partial(_alike, least=least_agreeing(self.percent)), "a long, b long").distinct())

    def sets(self, nodes: DataFrame) -> DataFrame:
        """The full sets of nodes, from their texts; dropped by drop_sets."""
        used = self.settle(nodes.distinct())
        texts = self.docs.join(common.small(used), self.docs["doc_id"] == used["node"]).select("node", "text")
        return common.settle(texts.mapInPandas(partial(_sets, k=self.k), "node long, hashes binary"), self.large)

    def drop_sets(self) -> None:
        common.drop(self.spark, self.large)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that full sets confirm."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
        out = pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb").mapInPandas(partial(_confirm, percent=self.percent), "a long, b long").distinct()
        done = self.settle(out)
        self.drop_sets()
        return done

    def across(self, found: DataFrame) -> DataFrame:
        """The links between components that share a wide region, by a prefix join on full sets.

        In one order of all hashes, rarest first, two sets at the threshold have a hash in common among the first
        n - o + 1 of each, o being the overlap that they need: percent n at least for the larger, 2 percent / (100 +
        percent) n for the smaller. What follows the two places in their sets bounds the overlap, which leaves out most
        pairs that share a hash by chance. Hashes that one set alone has come first and meet nobody.
        A hash's bearers in its commonest component are compared with those of other components only, in blocks."""
        named = self.wide.select("region", "node").join(common.small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = named.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("region")
        mixed = self.settle(named.join(heads, "region", "left_semi").select("node", "component").distinct())
        if mixed.isEmpty():
            return self.spark.createDataFrame([], "a long, b long")
        t = self.percent
        texts = self.docs.join(common.small(mixed), self.docs["doc_id"] == mixed["node"]).select("node", "component", "text")
        full = common.settle(texts.mapInPandas(partial(_hashes, k=self.k), "node long, component long, sid long, n long, hashes array<long>"), self.large)
        posted = full.select("sid", F.explode("hashes").alias("hash"))
        common_ = posted.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
        # a row for each set, no longer than its text
        ranked = posted.join(common_, "hash").groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("df", "hash"))).alias("s"))
        meta = full.select("sid", "node", "component", "n").distinct()
        own = F.col("n") - F.size("s")
        first = F.col("n") - F.ceil(F.col("n") * t / 100) + 1
        reach = ranked.join(meta, "sid").withColumns({"own": own, "first": first}).filter("first > own")
        keys = reach.select("sid", "node", "component", "n", "own", F.posexplode(F.slice("s", F.lit(1), (F.col("first") - F.col("own")).cast("int"))).alias("i", "x"))
        keys = self.settle(keys.select("node", "component", "n", (F.col("own") + F.col("i") + 1).alias("at"), F.col("x.hash").alias("hash")))
        self.drop_sets()
        shares = keys.groupBy("hash", "component").agg(F.count("*").alias("c"))
        buckets = shares.groupBy("hash").agg(F.max(F.struct("c", "component")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("parts")).filter("parts > 1")
        marked = self.settle(keys.join(buckets.select("hash", F.col("main.component").alias("main"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "hash"))
        side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "at")]
        left = marked.filter("component <> main").select("hash", *side("l"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
        right = marked.select("hash", *side("r"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
        both = left.join(right, ["hash", "block"]).filter("component_l <> component_r")
        small_n, large_n = F.least("n_l", "n_r"), F.greatest("n_l", "n_r")
        small_at = F.when(F.col("n_l") < F.col("n_r"), F.col("at_l")).when(F.col("n_l") > F.col("n_r"), F.col("at_r")).otherwise(F.greatest("at_l", "at_r"))
        fits = (100 * small_n >= t * large_n) & (small_at <= small_n - F.ceil(small_n * 2 * t / (100 + t)) + 1)
        left_over = 1 + F.least(F.col("n_l") - F.col("at_l"), F.col("n_r") - F.col("at_r"))
        pairs = both.filter(fits & ((100 + t) * left_over >= t * (F.col("n_l") + F.col("n_r"))))
        pairs = pairs.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()
        return self.links(self.alike(pairs))


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, by the similarity of k-word shingle sets of at least percent / 100."""
    run = Forest(docs, k, percent)
    run.classes()
    run.regions()
    links = run.links(run.alike(run.candidates()))
    found = run.settle(components(links, run.paths))
    more = run.across(found)
    if not more.isEmpty():
        found = run.settle(components(links.union(more), run.paths))
    out = run.members.join(common.small(found), "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("used"), F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"))
    # the result still reads three of the tables
    run.drop_all_but(run.signed, run.copies, found)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without the documents that aren't the least of their group; a repeated doc_id stays once.

    Only ids are joined with docs, so texts are shuffled only if the ids are too many to broadcast."""
    found = groups(docs, k, percent)
    gone_id, twice_id, place = common.unused(docs, "gone", "twice", "place")
    gone = common.settle(found.filter(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct())
    twice = common.settle(found.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(twice_id)))
    rows = docs.join(common.small(gone), F.col("doc_id") == F.col(gone_id), "left_anti")
    if twice.isEmpty():
        return rows
    twice = common.small(twice)
    once = rows.join(twice, F.col("doc_id") == F.col(twice_id), "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    first = once.withColumn(place, number).filter(F.col(place) == 1).drop(place)
    return rows.join(twice, F.col("doc_id") == F.col(twice_id), "left_anti").unionByName(first)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents"), k=4)
