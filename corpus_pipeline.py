"""Corpus pipeline: quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns the packed pieces.
Between stages the rows are written as Parquet to the shared checkpoint folder
and read again, so a lost executor costs one stage at most.

* quality: documents that the classifier rejects (score under 0.3) go.
* ngram_join: of each group of linked documents (5-word Jaccard of 0.8 or more)
  the one with the smallest doc_id stays; documents without words all stay.
* decontaminate: documents in which a benchmark item is found go.
* pack: the rest is packed into sequences of at most 4096 tokens.

Nulls, empty texts, repeated rows, empty tables and extra columns have the
results that the operators' docstrings define; extra columns are carried along
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import common as C
from riskloom.llm.op1_ngram_join import keep_one
from riskloom.llm.op2_packing import pack_documents
from riskloom.llm.op5_quality import keep_good
from riskloom.llm.op7_decontaminate import clean_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, C.load(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, C.load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("ngram_join", ngram_join), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can express neither the classifier nor the packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
