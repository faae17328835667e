"""The corpus pipeline: five stages, each written as Parquet and read again as the documents of the next.

``documents`` has doc_id (a long) and text; all other columns are carried, whatever their names. Null texts count as empty. An empty table goes through
and gives an empty result. Rows that repeat a doc_id with other texts are decided each by its text; of rows that repeat both, the first stage keeps
all or none and the second one. A null doc_id is never learned from, gives way to any other among copies, and seeds samples like 0. Texts are read
whole, very long ones too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.llm import decontaminate, exact_dedup, quality, segment, simhash
from tracegraph.llm.common import give_back, remove, shared_dir, table


def _whole(docs: DataFrame) -> DataFrame:
    """(row, text): rows apart from the columns that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to have quality 1."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(_whole(docs), model, ["row"], quality.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word Jaccard of 0.8 or more), the document with the least doc_id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.find_overlaps(_whole(docs), table(spark, sf_dir, "benchmark"), ["row"])
    return found.where(F.size("hits") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations: a row for each document and sample, with the piece ids as 32-bit little-endian numbers, and whether decoding
    them gives the text back (``exact``)."""
    give_back(spark)  # this stage's memory is its workers'; the joins before it leave grown heaps
    return segment.encode(docs, ["doc_id"], verify=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What each returns is written to the shared folder; once the last is there, the others are removed. The
    result reads the last, which is the caller's to remove."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    for i in range(len(STAGES) - 1):
        remove(spark, f"{folder}/{i}")
    return docs
