"""From documents to token ids: language ID, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last
return the columns of documents. ``run`` writes each stage's result to shared storage and
reads it back, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.ship import ship
from folioforge.llm import bpe, langid, line_dedup, mixing, simhash
from folioforge.llm.common import materialise, small_batches
from folioforge.sources.documents import spread

#: No source is passed over more often than this.
MOST_PASSES = 1.5


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and those without a letter, also where no language could be learned."""
    _prepare(spark)
    known = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id")))
    languages, prototypes = langid.train(known)
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, languages, prototypes).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs of 50 words or more; a document left without text goes."""
    clean = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.where("n_removed = 0 OR n_removed < n_lines").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose 5-word shingles are linked by a similarity of 0.8 or more.

    4 differing bits, the radius of the operator's own query, find few pairs of such a
    similarity; the stage takes a radius that misses none and verifies the shingles.
    """
    _prepare(spark)
    return simhash.keep_one(docs, simhash.similar(docs.select("doc_id", "text"), similarity=0.8, shingle=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, so that the weights of the sources come closer; every document occurs."""
    target = mixing.Target(most_passes=MOST_PASSES)
    return mixing.mix(docs, target).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, and the digest of what they decode to."""
    _prepare(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.encode(docs.select("doc_id", "source", "text"), path, with_decoded=True)
    return decoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Hashes, prefix doubling and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
