"""Line dedup by winnowing over line hashes.

A run is what counts as a repeat: one line of CHARS characters or more, or two lines that have as many together, or any
LINES lines that are not all empty; a shorter document that is none of these is a run as a whole, unless it is empty.
In each run the line with the least hash is selected (the last of equal ones), so equal runs always share a selected
fingerprint at the same place. Fingerprints that were selected at two positions or more are joined to their positions.
Each such position is extended both ways to the runs that selected it, and equal runs (64 bits each of their selected
line and, independently, of all lines) are brought to the first of them (smaller doc_id, or same document and earlier). Later runs that overlap
or touch make up whole repeated passages; their lines are deleted.

Lines end at line feeds. Null texts have no lines and stay null; an empty text has one empty line. Texts of any length
are read whole. Rows are told apart by doc_id (null last) and hashes of the text; of repeated rows with one id and text,
the runs of none is earlier than its own. An empty table gives no rows. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import KEY, computed, cut, fresh, keyed

LINES, CHARS = 3, 60


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _length_of_run(i: Column) -> Column:
    """Lines of the run that begins at line i; negative for a whole document; null where none does."""
    n, first = F.size("chars"), _at("chars", i)
    two = first + _at("chars", i + 1)
    three = two + _at("chars", i + 2)
    short = (n < LINES) & (i == 0) & (F.coalesce(two, first) > 0)
    return F.when(first >= CHARS, 1).when(two >= CHARS, 2).when(three > 0, LINES).when(short, -n)


def _selected(i: Column, length: Column) -> Column:
    """(hash, place from the end) of the selected line of a run."""
    place = lambda k: F.struct(_at("one", i + k).alias("h"), (-i - k).alias("back"))
    return F.least(place(0), *(F.when(F.abs(length) > k, place(k)) for k in range(1, LINES)))


def _equal(lines: str, i: Column, length: Column) -> Column:
    """A hash that is the same for equal runs."""
    return F.xxhash64(length, *(F.when(F.abs(length) > k, _at(lines, i + k)) for k in range(LINES)))


def _runs(docs: DataFrame) -> DataFrame:
    """(none, k, th, runs) of each document: runs (i, length, at, a), at with the hash and the place, counted down from 0, of
    the selected line, and a another hash of all lines."""
    d = computed(keyed(docs), lines=F.split("text", "\n")).select(*KEY, "lines")
    d = computed(d, chars=F.transform("lines", F.char_length), one=F.transform("lines", lambda x: F.xxhash64(x)), two=F.transform("lines", lambda x: F.xxhash64(F.lit(1), x))).drop("lines")
    begins = F.transform(F.sequence(F.lit(0), F.size("chars") - 1), lambda i: F.struct(i.alias("i"), _length_of_run(i).alias("length")))
    d = computed(d, begins=F.filter(begins, lambda r: r["length"].isNotNull()))

    def run(r: Column) -> Column:
        i, length = r["i"], r["length"]
        return F.struct(i.alias("i"), length.alias("length"), _selected(i, length).alias("at"), _equal("two", i, length).alias("a"))

    return d.select(*KEY, F.transform("begins", run).alias("runs"))


def shared_fingerprints(runs: DataFrame) -> DataFrame:
    """(h): hashes that were selected at two positions or more."""
    at = runs.select(F.explode(F.array_distinct(F.transform("runs", lambda r: r["at"]))).alias("at"))
    return at.groupBy("at.h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")


#: Of a place in one number: rows without a doc_id, then the line, then the length of the run.
_NONE, _LINE = 1 << 62, 4


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(KEY, drop): the line numbers, from 0, in order, that later runs cover, for each document that has any.

    Equal runs have equal h (the selected line) and a. A run that makes up over a thousandth of all is brought to its
    first by a broadcast of these runs (fewer than a thousand, whatever the data), so that no task gets all of them.
    """
    every = _runs(docs)
    shared = cut(shared_fingerprints(every))
    # positions are joined to the shared fingerprints, and go on as the runs around them
    r = every.select(*KEY, F.explode("runs").alias("r"))
    place = F.when(F.col("none"), F.lit(_NONE)).otherwise(F.lit(0)) + F.col("r.i").cast("long") * _LINE + F.abs("r.length")
    runs = r.select("k", "th", place.alias("place"), F.col("r.at.h").alias("h"), "r.a")
    runs = cut(runs.join(shared, "h", "left_semi"))
    order = F.struct(F.shiftright("place", 62).alias("none"), "k", "th", "place")
    first = runs.groupBy("h", "a").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("first != last").select("h", "a", "first", "n"))
    often = F.col("n") > runs.count() / 1000
    hot = F.broadcast(first.filter(often).drop("n"))
    rest = runs.join(hot.select("h", "a"), ["h", "a"], "left_anti").join(first.filter(~often).drop("n"), ["h", "a"])
    later = runs.join(hot, ["h", "a"]).unionByName(rest).filter(order != F.col("first"))
    line, length = F.shiftright(F.col("place").bitwiseAND(F.lit(_NONE - 1)), 2).cast("int"), F.col("place").bitwiseAND(F.lit(3)).cast("int")
    covered = F.flatten(F.collect_set(F.sequence(line, line + length - 1)))
    none = (F.shiftright("place", 62) > 0).alias("none")
    return later.groupBy(none, "k", "th").agg(F.array_sort(F.array_distinct(covered)).alias("drop"))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the text without its later repeated runs, and n_lines and n_removed; columns of these two names are
    replaced, all others are kept."""
    none, k, th, drop, every = fresh(docs, *KEY, "drop", "lines")
    found = repeated_lines(docs).toDF(none, k, th, drop)
    docs = docs.drop("n_lines", "n_removed")
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    d = docs.withColumns({none: i.isNull(), k: F.coalesce(i, F.xxhash64(F.lit(1), text)), th: F.xxhash64(text)}).join(found, [none, k, th], "left")
    d = computed(d.withColumnRenamed(drop, drop + "_"), **{every: F.split("text", "\n"), drop: F.coalesce(drop + "_", F.array().cast("array<int>"))}).drop(drop + "_")
    lines, gone = F.col(every), F.col(drop)
    d = d.withColumns({"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"), "n_removed": F.size(gone).cast("long")})
    # what lies between one deleted line and the next
    begin = lambda j: F.coalesce(F.get(gone, j - 1) + 1, F.lit(0))
    end = lambda j: F.coalesce(F.get(gone, j), F.size(lines))
    keep = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j))))
    return d.withColumn("text", F.when(F.size(gone) == 0, F.col("text")).otherwise(F.concat_ws("\n", keep))).drop(none, k, th, drop, every)


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256); kept lines are joined by line feeds, null texts are empty."""
    d = remove_repeated_lines(docs.select("doc_id", "text"))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same by plain SQL: runs are grouped by their lines.
LINES_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS k, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
sized AS (SELECT k, lines, len(lines) AS n, list_transform(lines, lambda x: length(x)) AS c FROM d WHERE text IS NOT NULL),
begins AS (
  SELECT k, i, lines,
         CASE WHEN c[i] >= 60 THEN 1 WHEN i < n AND c[i] + c[i + 1] >= 60 THEN 2 WHEN i + 1 < n AND c[i] + c[i + 1] + c[i + 2] > 0 THEN 3
              WHEN n < 3 AND i = 1 AND list_sum(c) > 0 THEN -n END AS m
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM sized)),
runs AS (SELECT k, i, m, list_slice(lines, i, i + abs(m) - 1) AS r FROM begins WHERE m IS NOT NULL),
later AS (SELECT k, i, abs(m) AS m FROM (SELECT k, i, m, row_number() OVER (PARTITION BY m, r ORDER BY k, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + m)) AS i FROM later),
every AS (SELECT k, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS text FROM every ANTI JOIN gone USING (k, i) GROUP BY k),
counts AS (SELECT k, COUNT(*) AS n FROM gone GROUP BY k)
SELECT doc_id, COALESCE(len(lines), 0)::BIGINT AS n_lines, COALESCE(n, 0)::BIGINT AS n_removed, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k) LEFT JOIN counts USING (k)
"""
