"""Corpus pipeline: language, toxicity, near duplicates, benchmark contamination, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. Every stage works on all rows its predecessor kept. The first four return
the columns of ``documents`` as they came, extra columns included; the last returns the mixture.

Defined results: null and empty texts, and texts without a letter, are rejected by the first stage; an
empty table stays empty through every stage; rows that repeat an id are copies of which one stays; a row
without an id goes where its class of near duplicates has a row with one, else one such row of the class stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, mixing, simhash, toxicity
from tidemark.llm.common import made_tables, materialise, remove
from tidemark.llm.queries import TOXIC_AT

KNOWN_LETTERS = 0.5
#: SQL can't express the learned stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which words in scripts of known languages hold at least half of the letters, in one language or several."""
    predicted = docs.withColumn("__tm_lang", langid.predict_column(langid.train(docs), F.col("text"), spark))
    sure = (F.col("__tm_lang.lang_pred") != langid.UNDETERMINED) & (F.col("__tm_lang.known") >= KNOWN_LETTERS)
    return predicted.where(sure).drop("__tm_lang")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the operator's threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("__tm_toxic", toxicity.score_column(model, F.col("text"), spark)).where(F.col("__tm_toxic") < TOXIC_AT).drop("__tm_toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every class of near duplicates."""
    classes = simhash.near_duplicates(docs)
    kept, _ = materialise(classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    stay = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("n > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return stay
    only = classes.where("component_id IS NULL").groupBy("component").agg(F.min("fp").alias("__tm_fp")).select("__tm_fp")
    printed = nameless.withColumn("__tm_fp", simhash.fingerprint_column(F.col("text")))
    one = printed.join(only, "__tm_fp", "left_semi").dropDuplicates(["__tm_fp"]).select(*docs.columns)
    return stay.unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the contamination rule leaves clean."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated(F.col("__tm_hit"), F.col("__tm_scan.n_words"))).drop("__tm_scan", "__tm_hit")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every kept document the mix takes, with its source's target."""
    return mixing.mix(docs).taken()


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents below ``sf_dir``.

    Each stage's rows are a table in the shared folder; once it is written, the tables that it was made from are removed.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with made_tables() as made:
            docs, path = materialise(stage(spark, docs, sf_dir), name)
        for old in [*before, *(p for p in made if p != path)]:
            remove(spark, old)
        before = [path]
    return docs
