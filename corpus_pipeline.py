"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Language ID, near-duplicate removal, benchmark decontamination, pseudonyms and mixing, in this order. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results. Null texts, and texts without a letter, go in the first stage, so no later stage has any in the pipeline; a stage
called on its own keeps them (near duplicates: they are linked with nothing; the others: unchanged), but for the mix, which
takes no text of size 0. Rows repeated with id and text are one document after the second stage; rows of one id
with different texts, and rows without id, are documents of their own. Ties go to the smaller id. Empty tables give
empty tables. Columns beyond those of documents are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, mixing, pii
from tessera.llm.common import fresh, held_bucket, saved, with_checkpoints
from tessera.llm.queries import PII_KEY


BROADCAST_ROWS = 500_000


def own_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever characters their names have."""
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) go; the languages are learned from the rows that are not held out."""
    held = held_bucket(F.col("doc_id")) == 0
    prototypes = langid.learn(docs.where(~held))
    if not prototypes:  # nothing to learn from makes every text und
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return own_columns(langid.identify(docs, prototypes, prefix="found_").where("found_lang_pred <> 'und'"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays: its smallest id, null last, and of that its smallest text hash; whole rows repeated stay once.

    Documents move only where more than BROADCAST_ROWS of them go, and rows that are repeated.
    """
    found = saved(jaccard.jaccard_components(docs, keyed=True).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "stays"))
    gone = found.where(~F.col("stays")).select("found_id", "found_hash").distinct()
    again = found.where("stays").groupBy("found_id", "found_hash").agg(F.count("*").alias("n")).where("n > 1").select("found_id", "found_hash")
    name = fresh(docs, "_hash")
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(F.col("found_id")) & rows[name].eqNullSafe(F.col("found_hash"))
    once = rows.join(counted_side(gone.unionByName(again)), same, "left_anti")
    repeated = rows.join(counted_side(again), same, "left_semi").dropDuplicates(["doc_id", name])
    return own_columns(once.unionByName(repeated), docs)


def counted_side(keys: DataFrame) -> DataFrame:
    """Two numbers a row: broadcast only where counted to be few."""
    keys = saved(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark phrase goes, however small a part of it the phrase is."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return own_columns(decontam.decontaminate(docs, items).where("n_hit = 0"), docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return own_columns(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with the number of copies, longer texts with larger odds; the rest goes."""
    return mixing.pareto_mix(docs, odds=mixing.length_odds(F.col("text"))).where("copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
]
#: Language ID, components and pseudonyms are not expressed in SQL; the tests compare with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared checkpoint folder and read again."""
    with_checkpoints(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{base}/pipeline-{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode())}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
