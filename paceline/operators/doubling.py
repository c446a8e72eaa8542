"""Greedy segmentation of windows that no task should hold, by pointer doubling.

Places count downwards from the longest sample. A group that ends at place q is followed by one that ends at
q + max(budget div length(q), 1), or at the last place of its window: a pointer of each place, known from its own row.
Groups of a window are the path from place 0. Pointers are doubled by joining them with themselves, and each doubling
doubles what is known of all paths, so a window of g groups takes log2(g) rounds of joins on (window, place). No window
is gathered; only the number of windows that go on comes to the driver, and tables that grow with the rows are joined by
sorting, never broadcast: packed as Parquet they look small, and the driver would get them anew in each round. A cap on patches makes a group's limit depend on
more than its place, so windows with one are left to segment.greedy_groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators.order import RANGE, numbered
from paceline.operators.segment import BY
from paceline.sources.workdir import stored


def _paths(pointers: DataFrame, ends: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, q, t): group number t of each window, from 0, ends at place q. pointers: (by, q, to) where `to` isn't the last
    place; ends: (by, end)."""
    on = lambda d, name: d.select(*by, F.col("q").alias(name), F.col("to").alias(f"{name}_to"))
    path = ends.select(*by, F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("t"))
    path, step = stored(path), 1
    while not ends.join(path.withColumnRenamed("q", "end").hint("merge"), [*by, "end"], "left_anti").isEmpty():
        to = F.coalesce(F.col("p_to"), F.col("end"))
        more = path.join(ends, list(by)).filter("q < end").join(on(pointers, "p").withColumnRenamed("p", "q").hint("merge"), [*by, "q"], "left")
        more = more.select(*by, to.alias("q"), (F.col("t") + step).alias("t"))
        # several places may reach the last one; the first to do so is its group
        path = stored(path.unionByName(more).groupBy(*by, "q").agg(F.min("t").alias("t")))
        far = on(pointers, "a").join(on(pointers, "b").withColumnRenamed("b", "a_to").hint("merge"), [*by, "a_to"])
        pointers, step = stored(far.select(*by, F.col("a").alias("q"), F.col("b_to").alias("to"))), 2 * step
    return path


def greedy_groups(rows: DataFrame, budget: int, by: tuple[str, ...] = BY, order: str = "arrival_idx", per_range: int = RANGE) -> DataFrame:
    """What segment.greedy_groups gives without a cap on patches, for windows of any size. Lengths that are null or not
    positive are left out, as there; an empty table gives no rows."""
    kept = rows.filter("length > 0").select(*by, "sample_id", "length", "n_patches", order)
    d = stored(numbered(kept, [F.desc("length"), F.desc(order)], "q", by, per_range))
    ends = stored(d.groupBy(*by).agg(F.max("q").alias("end")))
    to = F.col("q") + F.greatest(F.expr(f"{budget} div length"), F.lit(1))
    pointers = stored(d.join(ends, list(by)).select(*by, "q", to.alias("to"), "end").filter("to < end").drop("end"))
    path = _paths(pointers, ends, by)
    sizes = path.groupBy(*by).agg((F.max("t") + 1).alias("n_groups"))
    before = path.select(*by, (F.col("t") + 1).alias("t"), (F.col("q") + 1).alias("begin"))
    groups = path.join(before.hint("merge"), [*by, "t"], "left")
    # a group has at most `budget` places
    places = groups.select(*by, "t", F.explode(F.sequence(F.coalesce("begin", F.lit(0).cast("long")), F.col("q"))).alias("q"))
    out = d.join(places.hint("merge"), [*by, "q"]).join(sizes, list(by)).join(ends, list(by))
    return out.select(*by, "sample_id", "length", "n_patches", order, (F.col("end") - F.col("q")).alias("pos"), (F.col("n_groups") - 1 - F.col("t")).alias("group_idx"), "n_groups")
