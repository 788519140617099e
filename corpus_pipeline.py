"""From raw documents to a training mix: five stages, each one operator of habitspark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from habitspark.llm import jaccard, language, lines, mixing, templates
from habitspark.plans.scale import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# a text whose best language has less than this share of the probability is rejected
SURE = 0.5
# share of all tokens that the mix draws
BUDGET = 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing language is filled in."""
    model = language.fit(docs, F.lit(True))
    found = language.identify(docs, model, keep=("text", "lang", "source", "n_chars"))
    sure = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one of the collection repeats."""
    clean = lines.deduplicate_lines(docs, keep=("lang", "source"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the smallest id."""
    first = jaccard.link_documents(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = templates.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents in which sources, languages and topics have their target weights."""
    drawn = mixing.mix(docs, budget_share=BUDGET).filter("selected").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(*COLUMNS)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
]

# language scores summed over all segmentations and raked weights have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
