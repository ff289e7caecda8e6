"""A corpus pipeline of five stages, from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandweave.llm import decontam, minhash, packing, pii, quality_rules
from bandweave.llm.common import cut, table
from bandweave.llm.queries import _tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged one by one, so equal rows and null or repeated ids make no difference;
    null and empty texts are dropped. Columns stay as they are, whatever their names; an empty table gives an empty result."""
    return quality_rules.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id (null is the largest), of equal rows one. Rows without
    words are in no group and stay; an empty table gives an empty result."""
    return minhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Rows are judged one by one; null and empty texts stay, an empty table gives an empty
    result."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind. Null texts stay null, rows that repeat repeat; an empty
    table gives an empty result."""
    return pii.without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. Each row is a document of its own, a null or empty text an end token; an
    empty table gives an empty result."""
    return packing.packed(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]

#: SQL can't express hashed n-gram scores, the field's spans and tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)  # each stage reads its predecessor's rows more than once
    return docs
