"""Quality rules (operator 5): base counts, and robust multivariate outliers, in DataFrame functions alone.

Each text gives five transformed statistics: log mean word length, root of the symbol share, share of repeated words, log
share of capitals, share of repeated lines; as whole numbers of 1/SCALE, so that sums are exact in any order. In each
group, a language and source, a minimum-covariance-determinant estimate is made of the rows that pass the base rules.
There are three starts: medians with median deviations; mean and covariance of the values drawn in to WINSOR deviations;
those of the rows in the BOX around the medians. Each is concentrated STEPS times, each time taking the mean and covariance
of the nearest (n + P + 1) / 2 of n rows, where rows tied at the last place share what weight is left, so that copies of
one page come in by no more than that. The start that ends with the smallest determinant goes on; its covariance, widened
by CONSISTENT, is scaled by the median distance, and the estimate made once more from all rows within the chi-square bound
of 97.5 %. FLOOR is the least spread of a statistic, without which one that is nearly always 0 would have none. A row is an
outlier if its squared Mahalanobis distance is above CUT, which one normal row in 100,000 exceeds.

A group of fewer than LEAST_ROWS rows is judged by the estimate of all rows of its language, and if those are too few by
that of all rows; below LEAST_POOL rows in all there is no estimate and only the base rules decide. Every step is a
group-wise aggregate with partial sums over one settled table of a few numbers a document; percentiles are exact, by
counts of at most a few ten thousand distinct whole numbers. Three-word windows are compared by 64-bit hashes, so a text of
n words has a repeat by chance with a probability of n^2 / 4e19.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are values of
their own; a null doc_id is an id like others; texts of any length are read whole; repeated rows count and are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import let

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50

P = 5
SCALE = 1024
FLOOR = (0.10, 0.05, 0.06, 0.45, 0.12)
STEPS = 4
#: Of normal rows in P dimensions, the covariance over that of the nearest half: 0.5 / P(chi-square of P + 2 <= MEDIAN_5).
CONSISTENT = 1.9126
#: Chi-square of five degrees: median, and the bound of 97.5 %.
MEDIAN_5, INNER_5 = 4.351, 12.833
#: Chi-square of five degrees: the quantile of 99.999 %.
CUT = 30.856
WINSOR, BOX = 2.0, 1.5
LEAST_ROWS, LEAST_POOL = 60, 20
#: Distances are counted in steps of 1/STEP up to MOST.
STEP, MOST = 32, 1000
#: Parameters of a group are broadcast up to so many groups.
GROUPS = 20_000


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Windows are compared by 64-bit hashes; only texts that have equal ones are sorted."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twin = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return let(ordered, lambda s: F.aggregate(places(s), start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")), lambda a: a["n"]))

    repeats = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(repeats).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base columns and x0 to x4."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counts = let(F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    solid = F.length(F.translate(text, SPACE, ""))
    doubled = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    base = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        counts.alias("c"),
        doubled.alias("l"),
        solid.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    ).select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "c.n_repeat_words", "n_capitals", F.col("l.n").alias("n_lines"))
    words, chars, n_lines = (F.greatest(F.col(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    x = (
        F.log(F.greatest(chars, words) / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.col("n_repeat_words") / words,
        F.log(F.lit(0.01) + F.col("n_capitals") / chars),
        F.col("n_dup_lines") / n_lines,
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = base.withColumn("base_failed", failed).withColumns({f"x{k}": F.round(v * SCALE).cast("long") for k, v in enumerate(x)})
    return out.drop("n_capitals", "n_lines")


def _triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def distance(quantised: bool = False) -> Column:
    """Squared Mahalanobis distance of x0.. from mean m0.. under the inverse Cholesky factor w00.. of the group."""
    z = [" + ".join(f"w{i}{j} * (x{j} / {SCALE}D - m{j})" for j in range(i + 1)) for i in range(P)]
    d = " + ".join(f"pow({v}, 2)" for v in z)
    return F.expr(f"floor(least({d}, {MOST}D) * {STEP})" if quantised else d)


def factored(params: DataFrame, extra: list[str]) -> DataFrame:
    """group, m0.., w00.. from group, m0.. and the covariances c00..: the inverse of the Cholesky factor.

    One select, whose later columns use its earlier ones."""
    steps = []
    for i, j in _triangle():
        s = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(j))])
        # the floors keep the diagonal positive; rounding can't take it below theirs by much
        steps.append(f"sqrt(greatest({s}, {FLOOR[i] ** 2 / 2}D)) AS l{i}{j}" if i == j else f"({s}) / l{j}{j} AS l{i}{j}")
    for j in range(P):
        for i in range(j, P):
            steps.append(f"1 / l{i}{i} AS w{i}{j}" if i == j else f"-({' + '.join(f'l{i}{k} * w{k}{j}' for k in range(j, i))}) / l{i}{i} AS w{i}{j}")
    return params.selectExpr("*", *steps).select("group", *extra, *(f"m{k}" for k in range(P)), *(f"w{i}{j}" for i, j in _triangle()))


BY = ["group", "start"]
X = [f"x{k}" for k in range(P)]


def moments(rows: DataFrame, by: list[str], wider: float = 1.0) -> DataFrame:
    """by, m0.. and c00.. of rows up to `bound`, those at it with the weight `share`; floors included.

    Sums are of whole numbers, so exact."""
    x = {"n": "1"} | {f"s{k}": f"x{k}" for k in range(P)} | {f"q{i}{j}": f"x{i} * x{j}" for i, j in _triangle()}
    sums = [F.expr(f"sum(if(far {op} bound, {v}, 0))").alias(f"{k}_{name}") for k, v in x.items() for op, name in (("<", "in"), ("=", "at"))]
    out = rows.groupBy(*by).agg(F.first("share").alias("share"), *sums).selectExpr(*by, *(f"{k}_in + share * {k}_at AS {k}" for k in x)).filter("n > 0")
    means = [f"s{k} / n / {SCALE} AS m{k}" for k in range(P)]
    cov = [f"(q{i}{j} / n / {SCALE**2} - m{i} * m{j}) * {wider}D + {FLOOR[i] ** 2 if i == j else 0.0}D AS c{i}{j}" for i, j in _triangle()]
    return out.selectExpr(*by, *means, *cov)


def nearest_half(far: DataFrame) -> DataFrame:
    """group, start, the distance `bound` of the last of the nearest (n + P + 1) / 2 rows, and the weight `share` of those at it."""
    by = Window.partitionBy(*BY)
    up = F.sum("n").over(by.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # at most STEP * MOST + 1 distances a group and start
    held = far.groupBy(*BY, "far").agg(F.count("*").alias("n")).withColumns({"up": up, "all": F.sum("n").over(by)})
    half = F.least(F.col("all"), F.floor((F.col("all") + P + 1) / 2))
    last = held.withColumn("left", half - F.col("up") + F.col("n")).filter((F.col("left") > 0) & (F.col("left") <= F.col("n")))
    return last.select(*BY, F.col("far").alias("bound"), (F.col("left") / F.col("n")).alias("share"))


def grouped(rows: DataFrame, keep: list[str]) -> DataFrame:
    """lang, source, the group whose estimate judges the pair (the pair, its language, all, or none), and those that it feeds."""
    pairs = common.settle(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), keep)
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in ("lang", "source"))
    named = pairs.select("lang", "source", "n", F.concat_ws("\x1f", lang, source).alias("own"), lang.alias("pool"))
    few, few_here = F.col("n") < LEAST_ROWS, F.col("here") < LEAST_ROWS
    pools = named.groupBy("pool").agg(F.sum("n").alias("here"), F.bool_or(few).alias("asked"))
    # one row
    every = pools.agg(F.sum("here").alias("total"), F.bool_or(few_here).alias("asked_all"))
    joined = named.join(pools, "pool").crossJoin(F.broadcast(every))
    group = F.when(~few, F.col("own")).when(~few_here, F.col("pool")).when(F.col("total") >= LEAST_POOL, F.lit(""))
    feeds = F.array_compact(F.array(F.when(~few, F.col("own")), F.when(F.col("asked") & ~few_here, F.col("pool")), F.when(F.col("asked_all") & (F.col("total") >= LEAST_POOL), F.lit(""))))
    return common.settle(joined.select("lang", "source", group.alias("group"), feeds.alias("feeds")), keep)


def starts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """group, start, m0.. and w00.. of the three starts."""
    middle = rows.groupBy("group").agg(*(F.percentile(x, F.lit(0.5)).alias(f"m{k}") for k, x in enumerate(X)))
    off = [F.percentile(F.abs(F.col(x) - F.col(f"m{k}")), F.lit(0.5)) for k, x in enumerate(X)]
    # a deviation is at least its floor, as in the covariances
    spread = rows.join(middle, "group").groupBy("group").agg(*(F.first(f"m{k}").alias(f"m{k}") for k in range(P)), *(F.sqrt(F.pow(d * 1.4826, 2) + (FLOOR[k] * SCALE) ** 2).alias(f"d{k}") for k, d in enumerate(off)))
    spread = common.small(common.settle(spread, keep), GROUPS)
    diagonal = {f"c{i}{j}": F.pow(F.col(f"d{i}") / SCALE, 2) if i == j else F.lit(0.0) for i, j in _triangle()}
    first = spread.withColumns(diagonal | {f"m{k}": F.col(f"m{k}") / SCALE for k in range(P)}).withColumn("start", F.lit(0))
    near = rows.join(spread, "group").withColumns({"far": F.lit(0), "bound": F.lit(1), "share": F.lit(0.0)})
    low, high = ([F.round(F.col(f"m{k}") + s * WINSOR * F.col(f"d{k}")).cast("long") for k in range(P)] for s in (-1, 1))
    drawn = near.withColumns({x: F.greatest(low[k], F.least(high[k], F.col(x))) for k, x in enumerate(X)})
    boxed = near.filter(reduce(lambda a, b: a & b, [F.abs(F.col(x) - F.col(f"m{k}")) <= BOX * F.col(f"d{k}") for k, x in enumerate(X)]))
    found = [factored(first, ["start"]), *(factored(moments(part.select("group", *X, "far", "bound", "share"), ["group"]).withColumn("start", F.lit(n)), ["start"]) for n, part in ((1, drawn), (2, boxed)))]
    return reduce(DataFrame.unionByName, found)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept."""
    keep: list[str] = []
    all_rows = common.settle(measured(docs))
    good = all_rows.filter(~F.col("base_failed"))
    groups = common.small(grouped(good, keep), GROUPS)
    on = all_rows["lang"].eqNullSafe(groups["lang"]) & all_rows["source"].eqNullSafe(groups["source"])
    rows = common.settle(good.join(groups, on).select(F.explode("feeds").alias("group"), *X), keep)

    def settled(params: DataFrame) -> DataFrame:
        return common.small(common.settle(params, keep), GROUPS)

    def measured_by(params: DataFrame) -> DataFrame:
        return rows.join(params, "group").select(*BY, *X, distance(quantised=True).alias("far"))

    params = settled(starts(rows, keep))
    for _ in range(STEPS):
        far = measured_by(params)
        near = nearest_half(far)
        params = settled(factored(moments(far.join(near, BY), BY, CONSISTENT), ["start"]))
    # the smallest determinant is the largest of its inverse's factor
    size = F.round(reduce(lambda a, b: a + b, [F.log(F.col(f"w{k}{k}")) for k in range(P)]), 9)
    names = [c for c in params.columns if c != "group"]
    best = params.groupBy("group").agg(F.max_by(F.struct(*names), F.struct(size, -F.col("start"))).alias("p")).select("group", "p.*")
    far = measured_by(best)
    # a step's middle, so that a median of 0 doesn't scale everything away
    near = far.groupBy(*BY).agg(((F.percentile("far", F.lit(0.5)) + 0.5) / MEDIAN_5 * INNER_5).alias("bound"), F.lit(1.0).alias("share"))
    params = factored(moments(far.join(near, BY), ["group"]), [])
    known = groups.join(params.withColumnRenamed("group", "g"), F.col("group") == F.col("g"), "left").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    known = common.settle(known.drop("group", "g", "feeds"))
    common.drop(docs.sparkSession, keep)
    known = common.small(known, GROUPS)
    judged = all_rows.join(known, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents")).drop("distance")
