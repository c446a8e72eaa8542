"""Mixing sources to target weights by entropy balancing.

Document rates r stay as near to 1 (in relative entropy, summed over documents) as the token constraints allow: the sum
of size * r over each source equals its target, and no rate exceeds `most`. The convex dual has one multiplier for each
source, and the rates are tilted exponentially by size: r = min(most, exp(multiplier * size)). Newton iterations find the
multipliers: each sums gradient and Hessian of all sources over the documents in one distributed job, over the table of
how many documents each source has of each size, which is all that they depend on. Sums are exact (decimals), so reruns
agree. Rates are then rounded into copies: along the documents of a source, roughly by size, copies follow the
running sum of the rates, so each document gets its rate rounded up or down, and the source's sum stays near its target.

Null and empty texts have size 0 and one copy. Null is a source of its own, the last. A source without tokens has target
0. Repeated rows count each; of rows that tie in size, doc_id and `tie` it is open which gets a copy more. Null doc_ids
come first among equals. Very long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.llm.common import cut, digest, fresh, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Parts of a rate: rates are rounded to these, their sums are exact.
UNIT = 10_000
#: Parts of a rate within the iterations.
FINE = 10**12
#: Newton steps at most; they stop before where the sums meet the targets to CLOSE.
STEPS, CLOSE = 100, 1e-12


def shares(totals: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets of the sources: all tokens by weight, none above `most` times its total; the excess goes by weight."""
    out, free, left = [0.0] * len(totals), [i for i, t in enumerate(totals) if t], float(sum(totals))
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > most * totals[i]]
        for i in over or free:
            out[i] = most * totals[i] if over else weights[i] * level
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def _table(df: DataFrame, values: dict[str, float], name: str) -> DataFrame:
    """A number for each source, to join by key."""
    return F.broadcast(df.sparkSession.createDataFrame(list(values.items()), f"key string, {name} double"))


def _rate(size: Column, multiplier: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(multiplier * size))


def multipliers(sizes: DataFrame, targets: dict[str, float], most: float = MOST) -> dict[str, float]:
    """The dual's optimum: for each source x such that the sum of n * size * min(most, exp(x * size)) is its target.

    sizes: (key, size, n). Newton steps, kept within what is known to hold the root; one job for each step gives
    gradient and Hessian of all sources. A target of `most` times the source needs all rates at `most`.
    """
    low = {k: -40.0 for k in targets}
    high = {k: math.log(most) for k in targets}  # every size of 1 or more is at the bound there
    x = {k: 0.0 for k, t in targets.items()}
    open_ = {k for k, t in targets.items() if t > 0}
    used = sizes.filter("size > 0")
    for _ in range(STEPS):
        if not open_:
            break
        d = used.join(_table(sizes, {k: x[k] for k in open_}, "x"), "key")
        rate, n, size = F.round(_rate(F.col("size"), F.col("x"), most) * FINE).cast("decimal(14,0)"), F.col("n").cast("decimal(12,0)"), F.col("size").cast("decimal(10,0)")
        free = F.when(F.exp(F.col("x") * F.col("size")) < most, n * size * rate * F.col("size").cast("double"))
        found = d.groupBy("key").agg(F.sum((n * size * rate).cast("decimal(38,0)")).alias("sum"), F.sum(free.cast("decimal(38,0)")).alias("slope")).collect()
        for key, total, slope in found:
            gap, rise = float(total) / FINE - targets[key], float(slope or 0) / FINE
            if gap > 0:
                high[key] = x[key]
            else:
                low[key] = x[key]
            step = x[key] - gap / rise if rise else math.inf
            if abs(gap) <= CLOSE * targets[key] or high[key] - low[key] <= 1e-15 * abs(low[key]):
                open_.discard(key)
            else:
                x[key] = step if low[key] < step < high[key] else (low[key] + high[key]) / 2
    return x


def mix(docs: DataFrame, size: Column, source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, prefix: str = "", tie: Column | None = None) -> DataFrame:
    """docs with source_size, target (of its source) and copies, named after `prefix`, in place of columns of these
    names; other columns are kept.

    `weights` repeat over the sources by code point, null last. The driver holds a few numbers for each source. `tie` (a
    string; by default a hash of the row) orders documents of one size and doc_id. A hot source is ranked in cells of
    size class and a hash of the document, so no task gets a whole source.
    """
    docs = docs.drop(*(prefix + x for x in ("source_size", "target", "copies")))
    names = fresh(docs, "size", "key", "salt", "class", "tie", "before", "units", "upto")
    size_, key, salt, class_, tie_, before, units, upto = names
    tie = digest(docs)[0].cast("string") if tie is None else tie
    d = docs.withColumns({size_: size.cast("long"), key: F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)), tie_: tie})
    # size class: the bits of the size, then its four leading bits
    bits = f"length(bin(`{size_}`))"
    d = d.withColumns({
        salt: F.substring(F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.col(tie_))), 1, 2),
        class_: F.expr(f"{bits} * 8 + shiftright(`{size_}`, greatest({bits} - 4, 0))").cast("int")})
    cells = cut(d.groupBy(F.col(key).alias("key"), F.col(class_).alias("class"), F.col(salt).alias("salt"), F.col(size_).alias("size")).agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(cells.groupBy("key", "size").agg(F.sum("n").alias("n")))
    found = sorted(((r[0], int(r[1] or 0)) for r in sizes.groupBy("key").agg(F.sum(F.col("n") * F.col("size"))).collect()), key=lambda r: (r[0] == "", r[0]))
    targets = shares([t for _, t in found], [float(weights[i % len(weights)]) for i in range(len(found))], most)
    x = multipliers(sizes, {k: t for (k, _), t in zip(found, targets, strict=True)}, most)
    table = docs.sparkSession.createDataFrame([(k, t, round(b, 6), x[k]) for (k, t), b in zip(found, targets, strict=True)], "key string, source_size long, target double, x double")
    # running sums of rates, in whole units: those of the cells, then those of the documents within a cell
    rate = F.round(_rate(F.col("size"), F.col("x"), most) * UNIT).cast("long")
    sums = cells.join(F.broadcast(table), "key").groupBy("key", "class", "salt").agg(F.sum(rate * F.col("n")).alias("units"))
    upto_cell = Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum("units").over(upto_cell), F.lit(0))).drop("units")
    sums = sums.withColumnsRenamed({"key": key, "class": class_, "salt": salt})
    table = table.withColumnsRenamed({"key": key, "source_size": prefix + "source_size", "target": prefix + "target", "x": units})
    d = d.join(sums, [key, class_, salt]).join(F.broadcast(table), key)
    d = d.withColumn(units, F.round(_rate(F.col(size_), F.col(units), most) * UNIT).cast("long"))
    within = Window.partitionBy(key, class_, salt).orderBy(size_, "doc_id", tie_).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn(upto, F.col(before) + F.sum(units).over(within))
    whole = lambda c: F.floor((c + UNIT // 2) / UNIT)
    return d.withColumn(prefix + "copies", (whole(F.col(upto)) - whole(F.col(upto) - F.col(units))).cast("long")).drop(*names)


def mixture_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document in the mix."""
    i = F.col("doc_id").cast("long")
    sizes = cut(docs.select(i.alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.when(i.isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("tie")))
    return mix(sizes, F.col("size"), tie=F.col("tie")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same result by plain SQL: targets by filling sources in order of their limit over their weight, multipliers by
#: bisection.
MIXTURE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN doc_id IS NULL THEN md5(COALESCE(text, '')) END AS tie FROM {docs}),
totals AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM totals),
filled AS (
  SELECT *, 3.0 * source_size / weight AS full_at,
         SUM(source_size) OVER ()::DOUBLE - 3.0 * COALESCE(SUM(source_size) OVER w, 0)::DOUBLE AS left_over,
         SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0) AS left_weight
  FROM weighed WHERE source_size > 0
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(left_over / left_weight, full_at) AS c FROM filled WHERE left_over / left_weight <= full_at),
targets AS (
  SELECT source, source_size, LEAST(3.0 * source_size, weight * COALESCE(c, 0))::DOUBLE AS t FROM weighed, level),
hist AS (
  SELECT source, list(size ORDER BY size) AS s, list(n ORDER BY size) AS n
  FROM (SELECT source, size::DOUBLE AS size, COUNT(*)::DOUBLE AS n FROM sized WHERE size > 0 GROUP BY ALL) GROUP BY source),
halved AS (
  SELECT g.source, t, s, n, -40.0::DOUBLE AS lo, ln(3.0)::DOUBLE AS hi, 0 AS i FROM targets g JOIN hist h ON g.source IS NOT DISTINCT FROM h.source
  UNION ALL
  SELECT source, t, s, n, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(1, len(s) + 1), lambda j: n[j] * s[j] * least(3.0, exp(mid * s[j])))) < t AS below
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved WHERE i < 100))),
ranked AS (
  SELECT doc_id, size, source_size, g.t, round(least(3.0, exp(COALESCE(h.hi, 0) * size)) * 10000)::BIGINT AS units, s.source,
         length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) AS class, substr(md5(COALESCE(doc_id::VARCHAR, tie)), 1, 2) AS salt, tie
  FROM sized s JOIN targets g ON s.source IS NOT DISTINCT FROM g.source
  LEFT JOIN (SELECT source, hi FROM halved WHERE i = 100) h ON h.source IS NOT DISTINCT FROM s.source),
summed AS (SELECT *, SUM(units) OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST, tie NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, round(t, 6) AS target, (size * ((upto + 5000) // 10000 - (upto - units + 5000) // 10000))::BIGINT AS taken
FROM summed
"""
