"""Training-data pipeline over ``documents``: every stage's output is written and read again as the next one's input.

Each stage takes the rows its predecessor kept.  Up to the mixing stage they
keep the columns of ``documents``, other columns included; the last stage
returns where each document's ids lie in the token files.  Stages take NULLs,
empty tables, repeated rows and columns they do not know: see each operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm import decontaminate, minhash, mixing, quality, tokens
from lagloom.llm.queries import DOMAIN, SEED, WEIGHTS
from lagloom.sources.writers import cut_lineage

#: 5-word shingles, linked from a similarity of 0.8 on; the same share of a test item makes a leak.
WORDS, PERCENT = 5, 80
#: Nine tenths of the tokens that are left, each document once at most.
PERMILLE, EPOCHS = 900, 1


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; of its repeated rows one."""
    return minhash.without_near_duplicates(docs, WORDS, PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WORDS, PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of their domain, language and source."""
    return mixing.mixed(docs, F.expr(DOMAIN), WEIGHTS, PERMILLE, EPOCHS, SEED).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the token files."""
    return tokens.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("good_quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("token_files", token_files),
]

#: The classifier and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
