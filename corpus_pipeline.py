"""A training corpus from documents, in five stages; each works on all that its predecessor kept.

    toxicity    documents that the factorization machine rejects go
    near_dedup  one document of each group of near duplicates stays (five-word shingles, similarity 0.8)
    pii         personal data become pseudonyms in the texts
    mixing      documents are dropped or repeated so that sources reach their target shares
    byte_bpe    the texts' token ids, and the digest of what they decode to

Pseudonyms take the key of spark.quarry.pii.key, or one drawn for this process where it is unset.

Defined results: a null or empty text is a document without words: it scores as clean, has no copies, stays as it is, is
taken by the mix by its share (as often as a document of size 0 is) and has no ids; a null doc_id is kept by near_dedup and
hashes like an empty name in the mix; null sources are a source; rows that repeat a doc_id become one; texts of any length
go through whole; an empty table gives an empty result; further columns are kept, whatever their names, up to the last
stage. A stage's scratch tables go once its rows are written.

All but the last stage return the columns of documents. Stages carry doc_id, text, lang, source and whatever else
documents has. SQL can't express the stages (a trained model, hashing by xxHash, SHA-256 networks, merges), so ORACLE_SQL
is None; tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, common, mixing, near_dup, pii, toxicity

#: Words of a shingle and least similarity in percent.
SHINGLE, SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicated(docs, SHINGLE, SIMILAR)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.configured_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each stage's rows are written to the shared folder and read again."""
    docs, held = common.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        before, now = common.made(), []
        docs = common.settle(stage(spark, docs, sf_dir), now)
        common.drop(spark, [*held, *(common.made() - before - set(now))])
        held = now
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
