"""Clean a document table for training: rules, lines, near-duplicates, benchmark, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import staged
from tidewheel.llm.decontaminate import keep_clean
from tidewheel.llm.line_templates import without_templates
from tidewheel.llm.minhash import keep_one
from tidewheel.llm.native import space_words
from tidewheel.llm.packing import packed_digest
from tidewheel.llm.quality import keep_good

LEAST_WORDS = 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring template lines; those that lose lines and fall below LEAST_WORDS words go."""
    out = without_templates(docs)
    lost = F.col(f"`{out.columns[-1]}`") > 0
    text = out.filter(~lost | (F.size(space_words(F.col("text"))) >= LEAST_WORDS)).withColumn("n_chars", F.length("text").cast("long"))
    return text.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates, by five-word shingles at 0.8."""
    return keep_one(docs, size=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in training sequences."""
    return packed_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage hashes words in a way that SQL has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else staged(out, "stage")
    return docs
