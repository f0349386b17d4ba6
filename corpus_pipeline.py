"""A corpus pipeline of five stages: quality rules, near-duplicates, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, written as Parquet and read again. Stages that filter return whole
documents as they got them; the pseudonym stage rewrites texts; the last gives one row per packed piece. Nulls, empty tables and repeated
rows are handled as the operators' modules state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardlake.llm import decontam, neardup, packing, pseudonyms, quality
from cardlake.llm.common import cut, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("ids", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("neardup", one_of_each),
    ("decontamination", without_benchmark),
    ("pseudonyms", pseudonymous),
    ("packing", packed),
]

#: EM, signatures and tokenizers are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
