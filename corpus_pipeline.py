"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed evenly, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; a stage's rows are written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monthloom.llm import minhash, mixing, packing, toxicity
from monthloom.llm.common import cleared, delete, keep, scratch, table
from monthloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, minhash.Rule(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learned scores, components and packing are beyond SQL; tests/llm/test_texts_and_media.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage and its operators stored is deleted once the next stage has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with cleared(spark):
            path = f"{scratch(spark, 'pipeline')}/{name}"
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
            keep(path.rpartition("/")[0])
        docs = spark.read.parquet(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
