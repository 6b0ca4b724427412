"""From raw documents to training files: the stages in order, each over all that the one before kept.

Documents of no known language go, one document of each group of near copies stays (five-word shingles,
similarity 0.8 or more), documents with a benchmark passage go, sources are repeated or thinned to
their target weights, and the mix is written as token records, which the last stage reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.base import table
from plumbline.llm.decontaminate import clean_documents
from plumbline.llm.jaccard import one_per_group
from plumbline.llm.langid import known_language
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.records import token_records
from plumbline.session import materialize

END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language_id", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

ORACLE_SQL = None  # a language model and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
