"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again
for the next one. All stages but the last return the columns of `documents`, with `n_chars` brought up to date where a stage changes texts:
documents of bad quality go; lines found in ten or more documents go; one document of each near-duplicate group stays (five words, similarity 0.8);
byte strings of 400 that occur elsewhere go; what is left is packed into sequences of 4096 tokens.

A stage gets a table that is written and read again, so it begins by letting go of what earlier stages kept on the executors' disks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywharf.llm import quality
from tallywharf.llm.common import release, table, tokenizer_file, written
from tallywharf.llm.line_dedup import dedup_lines
from tallywharf.llm.near_dedup import keep_first
from tallywharf.llm.packing import pack_documents
from tallywharf.llm.substring_dedup import dedup_substrings

#: No SQL: the stages train a model, search similar sets and pack greedily. tests/llm has a brute-force version.
ORACLE_SQL = None


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their order, n_chars (if there) counted anew."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return recounted(dedup_lines(docs, min_docs=10, min_chars=1), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return keep_first(docs, percent=80)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return recounted(dedup_substrings(docs, length=400, as_text=True).withColumnRenamed("_kept", "text"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("suffix-array dedup", suffix_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
