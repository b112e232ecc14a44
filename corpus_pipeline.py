"""From raw documents to packed training sequences.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last give the columns of
``documents``. Every stage works on all rows that the stage before it kept:

1. quality: documents that the line model scores under its threshold go.
2. exact_dedup: of texts that are equal but for white space, one row stays.
3. near_dedup: of each class of near-duplicates, one document stays.
4. substring_dedup: passages of 13 words or more that an earlier document has are cut out; documents
   of which nothing is left go.
5. packing: documents become pieces of sequences of at most 4096 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import bag_minhash, exact_dedup, line_quality, packing, substring_dedup
from gridspan.llm.common import table
from gridspan.session import scratch_path

# Trained scores and tokenizer ids are not to be had in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold, with all columns; null ids and repeated rows are scored like others.

    A null or empty text, or one of blank lines, gets the share of good documents in the sample.
    """
    return line_quality.keep_good(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; null and empty texts are one. The longest original stays, then the smallest id, null last."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the smallest id, null last; texts without words are classes alone."""
    return bag_minhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller id has; null texts stay null, and a null id is later than every other."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is the end id alone, repeated rows are packed as often as they occur."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
