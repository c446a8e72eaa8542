"""Sharding: a uniform shuffle into shards of exact sizes.

Rows lie in partitions by a hash, as many as there are rows for. The counts that go from each partition to each shard are drawn exactly, as a
matrix with given margins (multivariate hypergeometric). Each partition is permuted on its own and dealt out by those
counts; after the exchange each shard is permuted again. All such draws make a uniform permutation with shard sizes
at most one apart. The matrix is the only thing on the driver: one number for each shard and PART_ROWS rows.

Equal rows are numbered and dealt like any others; which of them gets which place is arbitrary. Null doc_ids hash like
a value. Null and empty texts count 16 bytes. A row travels whole, however long. An empty table gives no rows. Reruns
agree.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.llm.common import cut, fresh

#: Rows of a partition, and of a block of a shard, that are permuted together, on average.
PART_ROWS = 250_000
#: Partitions, and blocks of a shard (by bits of the permuting hash), there are at least.
LEAST_PARTS, LEAST_BLOCKS = 64, 16


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good: exact inversion, from the mode outwards."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    up = down = math.exp(choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))
    u, i, j = rng.random() - up, mode, mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (n - i) / ((i + 1) * (bad - n + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - n + j) / ((good - j + 1) * (n - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
    return mode


def communication(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard: shard sizes at most one apart, drawn like a uniform deal."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        left, row = sum(room), []
        for s in range(shards):
            x = hypergeometric(rng, room[s], left - room[s], n)
            row.append(x)
            left -= room[s]
            room[s] -= x
            n -= x
        out.append(row)
    return out


def shard(rows: DataFrame, identity: list[Column], shards: int = 40, seed: int = 20, per_part: int = PART_ROWS) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard), in place of columns of these names. identity: what tells
    rows apart; rows that agree in it are numbered, and each goes its own way. Other columns are kept."""
    rows = rows.drop("shard", "slot")
    same, part, nth, one, two, place, block, before, ends = fresh(rows, *"ipchkrbse")
    n = rows.count()
    parts, blocks = max(LEAST_PARTS, -(-n // per_part)), max(LEAST_BLOCKS, -(-n // (shards * per_part)))
    d = rows.withColumn(same, F.xxhash64(F.lit(seed + 3), *identity))
    d = d.withColumn(part, F.pmod(F.xxhash64(F.lit(seed + 1), same), F.lit(parts)).cast("int"))
    counts = [0] * parts
    for p, k in d.groupBy(part).count().collect():
        counts[p] = k
    matrix = [(p, list(accumulate(row))) for p, row in enumerate(communication(counts, shards, seed))]
    matrix = rows.sparkSession.createDataFrame(matrix, f"`{part}` int, `{ends}` array<bigint>")
    # one exchange serves the numbers and the permutation
    d = d.repartition(part).withColumn(nth, F.row_number().over(Window.partitionBy(part, same).orderBy(same)))
    d = d.withColumns({one: F.xxhash64(F.lit(seed), same, nth), two: F.xxhash64(F.lit(seed + 2), same, nth)})
    d = d.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(one, two)) - 1).join(F.broadcast(matrix), part)
    d = d.withColumn("shard", F.size(F.filter(ends, lambda x: x <= F.col(place))).cast("int"))
    d = d.withColumn(block, F.pmod(F.shiftright(two, 20), F.lit(blocks)).cast("int"))
    sizes = d.groupBy("shard", block).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    d = d.join(sizes, ["shard", block])
    slot = F.col(before) + F.row_number().over(Window.partitionBy("shard", block).orderBy(two, one)) - 1
    return d.withColumn("slot", slot.cast("long")).select(*rows.columns, "shard", "slot")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): size is the UTF-8 bytes of the text and 16 more."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def shard_report(docs: DataFrame, shards: int = 40) -> DataFrame:
    d = shard(cut(sized(docs)), [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
