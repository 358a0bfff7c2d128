"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes the documents that the stage before kept and applies one operator in
production settings. The first four return the columns of documents; the last returns the
packed pieces. Stages of language-wide statistics (votes, terms) use all of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocspark.llm import decontaminate, near_dedup, packing, pii, quality_rules
from ocspark.llm.common import save
from ocspark.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    found = save(quality_rules.signals(docs), "signals")
    kept = quality_rules.judge(found, quality_rules.fit(found)).where("kept")
    return kept.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, benchmark)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced by their kind; n_chars follows the text."""
    out = pii.sanitise(pii.find(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal data", hide_personal_data),
    ("best-fit packing", pack),
]

#: Signatures, weights and packing have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
