"""Count windows over arrivals, with and without warm-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ramp(window: int, warmup: bool = True) -> list[int]:
    """Sizes of the windows before the first full one: the window times a counter that grows by 0.05 in each."""
    out, counter = [], 0.0 if warmup else 1.0
    while counter < 1.0:
        out.append(max(1, int(window * counter)))
        counter = min(1.0, counter + 0.05)
    return out


def round_of(arrival: Column, window: int, warmup: bool = False) -> Column:
    """Window that an arrival falls into. Boundaries don't depend on content."""
    sizes = ramp(window, warmup)
    if not sizes:
        return F.floor(arrival / window).cast("long")
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    early = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= arrival)).cast("long")
    return F.when(arrival < ends[-1], early).otherwise(len(sizes) + F.floor((arrival - ends[-1]) / window)).cast("long")


def windows(samples: DataFrame, window: int, warmup: bool = False) -> DataFrame:
    """samples with round."""
    return samples.withColumn("round", round_of(F.col("arrival_idx"), window, warmup))


def estimate(samples: DataFrame, window: int, default: int) -> DataFrame:
    """(rounds, default_rounds, warn): windows that fit the samples, with the given size and with the default one, and
    whether the given one makes ten times as many."""
    n = F.count(F.lit(1))
    d = samples.agg(F.floor(n / window).cast("long").alias("rounds"), F.floor(n / default).cast("long").alias("default_rounds"))
    return d.withColumn("warn", F.col("rounds") > 10 * F.col("default_rounds"))
