"""From raw documents to training shards: language ID, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; what it returns is written as
Parquet and read again. All but the last return the columns of documents. Rows may repeat after the mixing stage: a
document that the mix takes twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import jaccard, langid, leakage, mixture, shards
from paceline.llm.common import cut, documents, fresh, word_count

SHARDS = 40
#: Words of a shingle for near-duplicates.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those without a letter, or unlike all languages, go. Null, empty and
    letterless texts go; a text of any length is judged whole; copies are judged alike; an empty table stays empty."""
    model = langid.fit(docs)
    mark, _ = fresh(docs, "", "rejected")
    return langid.identify(docs, model, mark).filter(~F.col(mark + "rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of their shingles): the one with the smallest doc_id
    (null last; of repeated ids the least digest of the row). Null and wordless texts are one group."""
    return jaccard.deduplicate(docs, SHINGLE).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and wordless texts hold none and stay, as do all where
    the benchmark is empty; copies go or stay together; texts of any length are searched whole."""
    return leakage.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document, none included, as the target weights of the sources ask for. A null source is one of
    its own, the last; texts without words have size 0; rows that are equal take copies apart from each other; an empty
    table stays empty."""
    mark, copy, _ = fresh(docs, "", "copy", "copies")
    d = mixture.mix(docs, word_count(F.col("text")), prefix=mark)
    return d.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(mark + "copies").cast("int")))).select(docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard and slot of a uniform shuffle; columns of these names are replaced. Nulls are values like any
    other; rows that are equal are numbered and dealt apart; an empty table stays empty."""
    identity = [F.col("doc_id"), F.octet_length("text"), F.crc32(F.col("text").cast("binary"))]
    return shards.shard(docs, identity, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The language models can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
