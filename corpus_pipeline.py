"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.exact_dedup import exact_dedup
from barloom.llm.mixing import mix_sources
from barloom.llm.near_dedup import near_dedup
from barloom.llm.packing import default_tokenizer, pack_documents
from barloom.llm.quality import quality_filter
from barloom.llm.shared import materialize, read

# Each stage's docs are a plain read of files, so places in them are stable.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that importance resampling leaves out go."""
    return quality_filter(docs, read(spark, sf_dir, "labels"), stable=True)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the smallest doc_id stays."""
    return exact_dedup(docs, stable=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies stays."""
    return near_dedup(docs, stable=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources at their target weights; repeated documents come as repeated rows."""
    return mix_sources(docs, stable=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents, each with its place in a sequence."""
    packed = pack_documents(docs, default_tokenizer(), keep_ids=False)
    return packed.select(F.col("_key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near-dedup and packing aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None
