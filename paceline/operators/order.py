"""Numbers in order without a global window: ranges of the order, counts of each range, and offsets from the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.sources.workdir import stored

#: Rows of a range that are numbered together, on average.
RANGE = 200_000


def numbered(df: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = (), per_range: int = RANGE) -> DataFrame:
    """df with `name`, the place of each row from 0 by `order`, counted apart for each value of the columns `within`.

    Spark's own range partitioning deals the rows, as many ranges as there are rows for, and each row keeps the number of
    its range; a range then begins where the counts of those before it end. Neither the plan nor what the driver holds
    grows with the rows. Rows that tie in everything are dealt by where they stood, so that they can't fill one range.
    """
    parts = -(-df.count() // per_range)
    if parts <= 1:
        alone = Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(alone) - 1).cast("long"))
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("__tie"))
    d = stored(ranged.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*(F.col(c).alias(f"__{c}") for c in within), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__at")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order, "__tie")) - 1
    d = d.withColumn("__place", inside).join(offsets, same)
    return d.withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).select(*df.columns, name)
