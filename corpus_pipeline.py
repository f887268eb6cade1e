"""The corpus pipeline: toxicity, near-copies, shared passages, benchmark passages, mixing.

Each stage takes the documents that the one before kept and returns documents; the last returns what the mix
takes of each. Stages go by their own input alone (and labels and benchmark of sf_dir).

Rows: null and empty texts are not toxic, are near-copies of each other (one of them stays), and hold no passage; the mix
takes nothing of them. A null id comes after all others. Rows that repeat id and text are near-copies. Texts of any
length are read whole. Columns beyond those of documents, whatever their names, are not carried on. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import decontaminate, mixing, similar, substring, toxicity
from kvloom.llm.shared import LAST_ID, fresh_dir, order_id, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.7; labels of the held-out third are not read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.rejected_out(docs.select(COLUMNS), toxicity.train(docs, labels), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group that is linked as op7 links (SimHash fingerprints of three-word shingles at most 3 bits
    apart, by deletion variants) or by a similarity of 0.8 of five-word shingles."""
    return similar.keep_one(docs.select(COLUMNS), print_words=3, max_distance=3, shingle_words=5, similarity=0.8)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that start earlier; one that loses all its words goes."""
    out = substring.dedup_substrings(docs, window=20, carry=("lang", "source", "n_chars"), verbatim=True)
    out = out.where("n_removed = 0 OR n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    _, hits, _ = decontaminate.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window_words=10)
    bad = hits.select(F.coalesce("id", F.lit(LAST_ID)).alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.select(COLUMNS).join(bad, (order_id("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that it takes any of."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Models, fingerprints and seeded hashes have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again; a folder goes when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = fresh_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
