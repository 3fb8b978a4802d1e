"""Training-corpus pipeline: each stage takes the documents its predecessor kept and acts on them.

1. language: documents whose text is in no learned language go.
2. near_duplicates: of documents tied by five-word shingle similarity of 0.8 or more, the one with the least id stays.
3. decontamination: documents that share ten consecutive words (or a whole shorter item) with the benchmark go.
4. secrets: secrets are masked in the text.
5. packing: token sequences of at most 1024, filled by source in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulelake.llm import decontaminate, language, packing, secrets, signature
from rulelake.llm.storage import Table, documents

#: Least share of a text's n-grams that a learned language must account for.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs, language.train(docs.where(~language.held_out())), LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminated),
          ("secrets", mask_secrets), ("packing", pack)]

#: The stages use trained models and public tokenizers, which SQL cannot express; tests/llm/test_pipeline_brute.py holds
#: every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written to the shared folder and read again."""
    docs, held = documents(spark, sf_dir), None
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            table = Table(docs)
            if held:
                held.drop()
            docs, held = table.df, table
    return docs
