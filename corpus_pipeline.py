"""From raw documents to packed training sequences: five stages, each one operator of anamnesis.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, and further columns as they
are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import decontaminate, ngram_join, packing, quality, secrets
from anamnesis.llm.common import discard, documents, saved, temporary
from anamnesis.llm.tokens import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go, by the bits of the written ledger.

    Null and empty texts have no words and go; null ids and repeated rows are judged by their texts alone.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the smallest id.

    Texts without words are no one's duplicates; a null id stays only where no row of the group has one; of rows with equal
    ids and texts the first in the order of all columns stays, and rows that share an id only are judged by their texts.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a test item go.

    Null and empty texts hold none, items without words are in none; null ids and repeated rows are judged by their texts.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked and n_chars counted again where a text has changed; no document goes, null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end id only; null ids pass through, repeated rows are
    packed each, an empty table gives no piece."""
    return packing.pieces_of(packing.pack(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("packing", packed),
]

#: Tokenizer ids are not to be had in SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with temporary() as keep:  # what a stage writes on its way goes when its result is written
            done = keep(saved(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
