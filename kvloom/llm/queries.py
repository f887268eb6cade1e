"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import decontaminate, language, mixing, nearest, quality, simhash, substring, toxicity, urlfilter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the url query: (host, path, action).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document; grades: 0 poor, 1 good but toxic, 2 good."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~toxicity.held_out())
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = quality.train(docs, ratings, grades=3)
    return quality.score(docs, model, least_grade=1).withColumn("held_out", toxicity.held_out())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-entropy difference of every document; the target is the documents labelled good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where(~toxicity.held_out()).where("quality = 1 AND toxic = 0")
    return language.cross_entropy_difference(docs, good)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 20-word windows that start earlier."""
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 3 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=3)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back through the index; revisits take the length from their record."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    read = warc.lookup(spark, archive, pages)
    return read.select(
        F.col("id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in 10-word windows of benchmark items."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_url_filters": op3_url_filters,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_warc_index": op8_warc_index,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
