"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``docs``. Between stages the rows are written as Parquet and read again, so each
stage starts from a table that survives lost executors.

1. language_id: documents without a letter or in no language the labels teach go.
2. near_dedup: of each group of near duplicates (SimHash of 3-word shingles, linked at 2 or fewer
   differing bits, as op3_simhash_neardup finds them), the one with the smallest id stays.
3. decontaminate: documents that contain a benchmark passage go.
4. mix: sources are mixed to their target weights; a document may repeat or go.
5. encode: token ids are written in coded blocks and read back.

Empty tables pass through all stages; null columns and repeated rows are treated as the
stages' operators say. Documents with extra columns keep them up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import decontaminate, language_id, simhash_neardup, source_mix, token_blocks
from sheaf.session import stored

TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_neardup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.repeated(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_blocks.encode_corpus(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

# Tokenization and near-duplicate components have no SQL; the tests follow planted cases through the stages and
# compare the ids with those of the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document copy of the finished corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
