"""Importance resampling towards a target: hashed word n-grams, a gain for each bucket, and the best noisy scores.

Features are the runs of one and two words, dealt to BUCKETS buckets by a checksum. A bucket's gain is the log ratio of
its smoothed shares in target and source; a document's weight is the mean gain of its features, and Gumbel noise of its
id makes the ranking a sample without replacement. Each text is tokenised once, to an array of its buckets, which is
stored; totals are the only thing that is counted over rows, and shuffle as one row for each bucket and task. Scoring
explodes nothing: each array is folded against an array literal of all gains.

Null and empty texts, and those without words, have no features and weight 0; texts of any length are folded whole.
Rows may repeat, and each is a document. Documents of fewer than `least` words are never drawn. Ties go to the smaller
doc_id, null last; rows that agree in score and id are ranked in any order. An empty source gives no rows; an empty
target makes gains of the source's shares alone. Other columns are left behind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import ascii_lower, cut
from paceline.operators.order import numbered

BUCKETS = 10_000
SEED = 7
#: Words of a document that may be drawn, and the share of those that is.
LEAST_WORDS, PERCENT = 20, 25
#: Documents of a range that are ranked together.
RANKED = 20_000

# A word: no ASCII character but letters and digits, and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def featured(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with `text` replaced by n_words and hashed, the bucket of each feature."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    d = docs.select(*(c for c in docs.columns if c != text), F.inline(F.array(F.struct(words.alias("words")))))
    one = F.transform("words", lambda w: bucket(w, buckets))
    two = F.transform(
        F.when(F.size("words") > 1, F.sequence(F.lit(1), F.size("words") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: bucket(F.concat(F.get("words", i - 1), F.lit(" "), F.get("words", i)), buckets))
    return d.select(*(c for c in d.columns if c != "words"), F.size("words").cast("long").alias("n_words"), F.concat(one, two).alias("hashed"))


def totals(hashed: DataFrame) -> dict[int, int]:
    """Features in each bucket; BUCKETS numbers at most come to the driver, whatever the rows."""
    rows = hashed.select(F.explode("hashed").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.b: r.n for r in rows}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    of = lambda s, t: math.floor(1000.0 * math.log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))))
    return [of(source.get(b, 0), target.get(b, 0)) for b in range(buckets)]


def floored_mean(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers throughout; 0 where n is 0."""
    n = F.nullif(n, F.lit(0).cast("long"))
    return F.coalesce(F.call_function("div", total - F.pmod(total, n), n), F.lit(0)).cast("long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a key, in thousandths, rounded down: the same wherever the row is."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(hashed: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """hashed documents with n_features, weight and score in place of their arrays."""
    # a string that the optimizer turns into one array literal: a column for each gain would be a plan of 10,000 nodes
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("hashed", F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    n = F.size("hashed").cast("long")
    d = hashed.select(*(c for c in hashed.columns if c != "hashed"), n.alias("n_features"), floored_mean(total, n).alias("weight"))
    return d.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, per_range: int = RANKED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document; rank counts the drawn ones from 1 and is null
    for the others."""
    source = cut(featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    gain = gains(totals(source), totals(featured(target.select("text"))))
    d = scored(source, gain, seed).withColumn("__may", F.col("n_words") >= least)
    k = d.filter("__may").count() * percent // 100
    order = [F.col("__may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    d = numbered(d, order, "__place", per_range=per_range)
    return d.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("__place") < k, F.col("__place") + 1).alias("rank"))


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# The checksum is taken over bits, as a step for each byte of a feature, of distinct features alone.
RESAMPLE_SQL = f"""WITH RECURSIVE entry AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM entry WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM entry WHERE k = 8),
words AS MATERIALIZED (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, {_WORDS} FROM benchmark),
feats AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
kinds AS (SELECT f, encode(f) AS e FROM (SELECT DISTINCT f FROM feats)),
bytes AS (SELECT f, list_transform(range(1, octet_length(e) + 1), lambda i: ('0x' || substr(hex(e), (2 * i - 1)::INT, 2))::BIGINT) AS b FROM kinds),
crc AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
hits AS MATERIALIZED (SELECT side, r, bucket, COUNT(*) AS n FROM feats JOIN crc USING (f) GROUP BY ALL),
tot AS (SELECT bucket, COALESCE(SUM(n) FILTER (side = 's'), 0)::BIGINT AS s, COALESCE(SUM(n) FILTER (side = 't'), 0)::BIGINT AS t FROM hits GROUP BY bucket),
sums AS (SELECT COALESCE(SUM(s), 0)::BIGINT AS s_all, COALESCE(SUM(t), 0)::BIGINT AS t_all FROM tot),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS g FROM tot, sums),
own AS (SELECT r, SUM(n)::BIGINT AS n, SUM(n * g)::BIGINT AS total FROM hits JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
sc AS (
  SELECT doc_id, r, len(w) AS n_words, COALESCE(n, 0)::BIGINT AS n_features,
    COALESCE(CASE WHEN total < 0 THEN -((-total + n - 1) // n) ELSE total // n END, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS noise
  FROM words LEFT JOIN own USING (r) WHERE side = 's'),
may AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS place, COUNT(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM sc LEFT JOIN may USING (r)"""
