"""Connected components by alternating large and small stars, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut


def _mark(d: DataFrame) -> tuple:
    return tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), of longs: (node, root), with the smallest node of each component as root; roots have no row.

    Every step keeps the components and brings them nearer to stars; steps are a logarithm of the component sizes.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct())
    before = None
    while (now := _mark(e)) != before:
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct())
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = cut(large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").union(small).distinct())
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
