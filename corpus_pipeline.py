"""The corpus pipeline: stages of the training-data operators, each written as Parquet and read again by the next.

Every stage decides by row: a row without an id is judged by its text like any other, and of
the rows of one id each goes or stays by its own text.  Null, empty and blank texts have no
language and go in the first stage; very long texts are judged whole; equal rows get equal
verdicts, and of rows that are copies of each other one stays; an empty table gives an empty
table.  All stages but the last return the columns that they were given, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frayline.llm import bpe_prefix, decision_list, decontaminate, jaccard_join, language_id
from frayline.llm.durable import forget, shared_folder, workers_find_package
from frayline.llm.queries import id_remainder, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no text or no letter in it."""
    workers_find_package(spark)
    return language_id.drop_unknown(docs, language_id.fit_language_model(docs, id_remainder(4) != 2))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or a learnt rule rejects."""
    return decision_list.keep_by_rules(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the document of the smallest id, once if its row is repeated."""
    workers_find_package(spark)
    return jaccard_join.one_of_each(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    workers_find_package(spark)
    done = bpe_prefix.bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_stage),
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", contamination_stage),
    ("byte-level BPE", token_stage),
]

#: Language machines, learnt rules, similarity components and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder for the next, and deleted once that is done."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            forget(docs)
        docs = spark.read.parquet(path)
    return docs
