"""The corpus pipeline: each stage calls one training-data operator on all documents that its predecessor kept.

1. quality rules: documents that the adaptive rules reject go.
2. language ID: documents without a recognisable language go.
3. n-gram Jaccard join: the document with the smallest id of each group of near duplicates stays.
4. secret scans: secrets in the text are replaced by a mark, and n_chars follows.
5. best-fit packing: the result, one row per packed piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovenlake.llm import best_fit_packing, lang_id, ngram_join, quality_rules, queries, secret_scan
from wovenlake.llm.shared import materialise, remove, scratch_of

#: Texts whose best language gets less than this mean share of the positions are rejected.
LEAST_LANGUAGE_SCORE = 0.3
#: Near duplicates share at least this percentage of their distinct five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Ids to drop are broadcast up to so many.
BROADCAST_IDS = 500_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch folders of the stage that was called last; its result may still read them.
_before: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage's result is written before the next stage is called, so what the stage before left in the shared folder
    goes then, but for folders that the given documents read."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _before:
            read = docs.inputFiles()
            for path in [p for p in _before if not any(p.split("://")[-1] in x for x in read)]:
                remove(spark, path)
                _before.remove(path)
        with scratch_of() as made:
            out = f(spark, docs, sf_dir)
        _before.extend(made)
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(docs, carry=list(docs.columns), names=[f"kept_{c}" for c in docs.columns])
    return judged.filter("kept").select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language isn't und and whose score is high enough."""
    found = lang_id.identify(docs, carry=list(docs.columns))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


@stage
def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the group's smallest id (rows without an id come
    last, ties go to the smaller text hash). Of rows that repeat both id and text one stays.

    Rows are told apart by id and text, so a document that only shares its id with a dropped one stays.
    """
    groups = ngram_join.classes(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT).filter("root is not null")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(key).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = materialise(groups.join(first, "root").filter(~same).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "dropped")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df  # noqa: E731  else texts and ids are shuffled
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    left = docs.join(small(gone), match, "left_anti").select(*docs.columns)
    twice = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    twice = materialise(twice, "repeated")
    if twice.isEmpty():
        return left
    once = left.join(small(twice), match, "left_semi").select(*docs.columns).withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    return left.join(small(twice), match, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


@stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of 2048 tokens."""
    return best_fit_packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", join_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = materialise(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID and packing have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
