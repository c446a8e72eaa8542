"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.sources.workdir import stored

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: What tells documents apart beside their place in a table.
KEY = ["none", "k", "th"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again (see stored)."""
    return stored(df)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, none, k, th, text) with null texts as empty ones. KEY is whether there is no doc_id, the doc_id (without
    one: a hash of the text), and another hash of the text: rows that agree in it are one document."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(i.alias("doc_id"), i.isNull().alias("none"), F.coalesce(i, F.xxhash64(F.lit(1), text)).alias("k"), F.xxhash64(text).alias("th"), text.alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as it takes to clash with no column of df."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(mark + n.lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once for a row: the optimizer would repeat an expression that lambdas use for
    every element, but doesn't move it past a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def size_of(df: DataFrame) -> int:
    """Bytes that df reads, as the optimizer estimates them from the files; very large where it can't tell."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def digest(df: DataFrame) -> list[Column]:
    """128 bits of a whole row, nulls included, as two longs: rows with equal ones are equal in every column."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        hashable = not isinstance(f.dataType, (T.MapType, T.VariantType)) and "map<" not in f.dataType.simpleString()
        parts += [c.isNull(), c if hashable else c.cast("string")]
    return [F.xxhash64(F.lit(k), *parts) for k in (11, 12)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
