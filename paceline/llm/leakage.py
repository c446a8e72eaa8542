"""Benchmark decontamination by a distributed positional inverted index.

Documents are split into words once, and postings (term, document, position) are stored for every term of the test
items. For each window of an item the list of its rarest term gives alignments of the item with documents; they are
intersected, offsets adjusted, with the list of the window's second rarest term, and what is left with the lists of all
terms of the item. Consecutive offsets that all match, as many as a window has, are an exact phrase. For proximity, the
lists of the two rarest terms of an item are intersected within NEAR words.

A word is a maximal run outside the ASCII characters other than letters and digits, A-Z lower-cased. A window is WINDOW
consecutive words of an item, or all words of a shorter one. Null and empty texts have no words, very long ones are read
whole; items without words never match. Repeated items count once. Documents are told apart by doc_id and hashes of the
text; repeated rows each get the result of their text. Empty tables on either side give no matches. Extra columns of
documents and items are left behind. Test items are broadcast only up to BROADCAST_TERMS words, else joined by shuffle.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.llm.common import KEY, ascii_lower, cut, fresh, keyed

WINDOW = 10
#: Words that the two rarest terms of an item may be apart.
NEAR = 20
BROADCAST_TERMS = 1_000_000
#: The same before and after lower-casing. As a negated class, Java took 18 times as long.
TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


class Index:
    """Test items, and the stored postings of their terms over all documents."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        item = items.select(F.col("item_id").cast("string").alias("item_id"), terms(F.col("text")).alias("words"))
        item = item.filter(F.size("words") > 0).distinct()
        self.items = cut(item.withColumns({"item": F.xxhash64("item_id", "words"), "n": F.size("words")}))
        self.small = (self.items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_TERMS
        tokens = self.items.select("item", "n", F.posexplode("words").alias("off", "term"))
        # no word is empty: at the end of each document the empty term keeps its number of words
        vocabulary = tokens.select("term").union(self.items.sparkSession.createDataFrame([("",)], "term string")).distinct()
        self.vocabulary = self._numbered(vocabulary)
        self.tokens = cut(tokens.join(self.near(self.vocabulary), "term"))
        every = keyed(docs).select(*KEY, F.posexplode(F.concat(terms(F.col("text")), F.array(F.lit("")))).alias("pos", "term"))
        self.every = cut(every.join(self.near(self.vocabulary), "term").select("t", *KEY, "pos"))
        self.postings = self.every.filter(F.col("t") != self.end)
        self.frequency = cut(self.postings.groupBy("t").agg(F.count(F.lit(1)).alias("df")))

    def _numbered(self, vocabulary: DataFrame) -> DataFrame:
        """(term, t): a hash of each term, by the first seed that tells all of them apart."""
        for seed in count():
            found = cut(vocabulary.withColumn("t", F.xxhash64(F.lit(seed), "term")))
            n, different = found.agg(F.count(F.lit(1)), F.count_distinct("t")).first()
            if n == different:
                self.end = found.filter("term = ''").first()["t"]
                return found

    def near(self, d: DataFrame) -> DataFrame:
        return F.broadcast(d) if self.small else d

    def weighed(self) -> DataFrame:
        """Tokens of the items with how often each term occurs in the documents."""
        return self.tokens.join(self.frequency, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def anchors(self) -> DataFrame:
        """(item, off, t, off2, t2): the rarest and the second rarest place of each window whose terms all occur; a window
        of one word has no second."""
        w = Window.partitionBy("item").orderBy("off").rowsBetween(0, WINDOW - 1)
        d = self.weighed().withColumn("terms", F.array_sort(F.collect_list(F.struct("df", "off", "t")).over(w)))
        whole = (F.col("off") <= F.greatest(F.col("n") - WINDOW, F.lit(0))) & (F.get("terms", F.lit(0))["df"] > 0)
        d = d.filter(whole).select("item", F.get("terms", F.lit(0)).alias("a"), F.get("terms", F.lit(1)).alias("b"))
        return cut(d.select("item", "a.off", "a.t", F.col("b.off").alias("off2"), F.col("b.t").alias("t2")).distinct())

    def alignments(self) -> DataFrame:
        """(KEY, item, shift): where the two rarest terms of a window of an item stand as in the item, which then begins
        at word `shift` of the document (less than 0: before it)."""
        d = self.postings.join(self.near(self.anchors()), "t").withColumn("shift", F.col("pos") - F.col("off"))
        d = cut(d.select(*KEY, "item", "shift", F.col("t2").alias("t"), (F.col("shift") + F.col("off2")).alias("pos")).distinct())
        wanted = d.select("t").distinct()
        lists = self.postings.join(self.near(wanted), "t", "left_semi")
        both = d.filter("t is not null").join(lists, [*KEY, "t", "pos"], "left_semi").unionByName(d.filter("t is null"))
        return cut(both.select(*KEY, "item", "shift").distinct())

    def phrases(self) -> DataFrame:
        """(KEY, item_id, start, length): every longest run of words of a document that is one of an item, too, and as
        long as a window at least."""
        aligned = self.alignments()
        lists = self.postings.join(aligned.select(*KEY).distinct(), KEY, "left_semi")
        probes = aligned.join(self.near(self.tokens.select("item", "n", "off", "t")), "item").withColumn("pos", F.col("shift") + F.col("off"))
        hits = probes.join(lists, [*KEY, "t", "pos"], "left_semi")
        line = Window.partitionBy(*KEY, "item", "shift").orderBy("off")
        runs = hits.withColumn("run", F.col("off") - F.row_number().over(line))
        runs = runs.groupBy(*KEY, "item", "shift", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"), F.first("n").alias("n"))
        runs = runs.filter(F.col("length") >= F.least("n", F.lit(WINDOW)))
        return runs.join(self.near(self.items.select("item", "item_id")), "item").select(*KEY, "item_id", "start", "length")

    def proximity(self, apart: int = NEAR) -> DataFrame:
        """(KEY, item_id, n_near): how often the two rarest terms of an item (ties by term) occur within so many words."""
        w = Window.partitionBy("item").orderBy("df", "term")
        two = self.weighed().filter("df > 0").select("item", "t", "term", "df").distinct().withColumn("r", F.row_number().over(w)).filter("r <= 2")
        two = two.groupBy("item").agg(F.min(F.when(F.col("r") == 1, F.col("t"))).alias("t1"), F.min(F.when(F.col("r") == 2, F.col("t"))).alias("t2")).filter("t2 is not null")
        two = cut(two)

        def places(term: str, name: str) -> DataFrame:
            """Of one of the two terms, with blocks of so many words that near places are in equal or adjacent ones."""
            d = self.postings.withColumnRenamed("t", term).join(self.near(two.select("item", term)), term)
            return d.select(*KEY, "item", F.col("pos").alias(name), F.floor(F.col("pos") / (apart + 1)).alias("block")).distinct()

        one = places("t1", "p").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
        d = one.join(places("t2", "q"), [*KEY, "item", "block"]).filter(F.abs(F.col("p") - F.col("q")) <= apart)
        d = d.groupBy(*KEY, "item").agg(F.count(F.lit(1)).alias("n_near"))
        return d.join(self.near(self.items.select("item", "item_id")), "item").groupBy(*KEY, "item_id").agg(F.sum("n_near").alias("n_near"))

    def lengths(self) -> DataFrame:
        """(KEY, n_words), a row for each document, repeated ones included."""
        return self.every.filter(F.col("t") == self.end).select(*KEY, F.col("pos").cast("long").alias("n_words"))


def leakage_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of each document; n_near is the number of
    items whose two rarest terms stand near each other in it."""
    index = Index(docs, items)
    found = cut(index.phrases())
    at = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    words = at.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    names = found.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    close = index.proximity().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near"))
    d = index.lengths()
    for more in (words, names, close):
        d = d.join(more, KEY, "left")
    none = F.lit(0).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return d.select(
        F.when(~F.col("none"), F.col("k")).alias("doc_id"), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near", none).alias("n_near"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those in which a window of an item occurs; columns are kept."""
    names = fresh(docs, *KEY)
    found = cut(Index(docs, items).phrases().select(*KEY).distinct()).toDF(*names)
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    key = dict(zip(names, (i.isNull(), F.coalesce(i, F.xxhash64(F.lit(1), text)), F.xxhash64(text)), strict=True))
    return docs.withColumns(key).join(found, names, "left_anti").drop(*names)


#: The same by plain SQL, with every window of the documents hashed to its words.
LEAKAGE_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
iw AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, j, j + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS j FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
dg AS (
  SELECT k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM dw, sizes)),
hits AS (SELECT DISTINCT d.k, d.i, d.n, g.item_id FROM dg d JOIN grams g ON d.g = g.g AND d.n = g.n),
words AS (SELECT k, COUNT(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
dt AS (SELECT k, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dw),
df AS (SELECT term, COUNT(*) AS df FROM dt GROUP BY term),
two AS (
  SELECT item_id, w, term, row_number() OVER (PARTITION BY item_id, w ORDER BY df, term) AS r
  FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM iw) JOIN df USING (term)),
close AS (
  SELECT a.k, COUNT(DISTINCT x.item_id) AS n_near
  FROM two x JOIN two y ON x.item_id = y.item_id AND x.w = y.w AND x.r = 1 AND y.r = 2
  JOIN dt a ON a.term = x.term JOIN dt b ON b.k = a.k AND b.term = y.term AND abs(a.pos - b.pos) <= 20
  GROUP BY a.k),
names AS (SELECT k, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated,
       COALESCE(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN words USING (k) LEFT JOIN names USING (k) LEFT JOIN close USING (k)
"""
