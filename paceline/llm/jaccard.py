"""Near-duplicates of a given similarity: SimHash balls and MinHash bands find candidates, exact similarity decides.

Documents are sets of shingles of so many words. Two sets are linked if their Jaccard similarity is SIMILAR or more.
Candidates are what SimHash links within RADIUS bits (simhash.links, by meet-in-the-middle balls): that finds copies and
sets nearly alike. At a similarity of just 0.8 two fingerprints differ in 9.7 of 64 bits on average, which no ball of a
bearable size reaches, so further candidates come from MinHash: each distinct set emits BANDS keys, each over ROWS least
values of a multiplied hash, and two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, all but 6
in a million at 0.8 and more above. Components of candidates are settled apart: there every set that is not linked yet
is held against all others that are not, by counting shared shingles. What came together by chance is not linked.

Null and wordless texts are the empty set, and equal. Null doc_ids get a component, and are the smallest id of none.
Repeated rows give repeated rows; rows with one doc_id and other texts are documents of their own. Texts of any length
are read whole. An empty table gives no rows. One task holds the sets of one component of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm import simhash
from paceline.llm.common import cut, digest, fresh, partitions
from paceline.llm.components import components
from paceline.llm.simhash import _WORD, _stars
from paceline.llm.workers import portions, tidy

#: Least similarity of near-duplicates, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 6
#: Shingles that are hashed at once.
PORTION = 100_000

_FACTORS = np.random.default_rng(7).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_SPREAD = np.uint64(11400714819323198485)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    w = _WORD.findall(text.encode().lower()) if text else []
    if not w:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(line, 42)], np.uint64)
    at = [0]
    for x in w:
        at.append(at[-1] + len(x) + 1)
    return np.unique(np.array([digest(line[a : b - 1], 42) for a, b in zip(at, at[words:], strict=False)], np.uint64))


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Keys (set, band) of sets that are not empty."""
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = (key ^ np.minimum.reduceat(low * f, begins)) * _SPREAD
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row1, row2, fp, sim, bands): digest of the row, hash of the set, its SimHash, packed keys (null for the
    empty set)."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            fps, sims, bands = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), [None] * len(texts)
            held, who, size = [], [], 0
            for i, text in enumerate(texts):
                s = shingles(text, words)
                if len(s):
                    fps[i] = xxhash.xxh64_intdigest(s.tobytes(), 1)
                    held.append(s)
                    who.append(i)
                    size += len(s)
                if held and (size > PORTION or i == len(texts) - 1):
                    sims[who] = simhash.majority(held)
                    for j, row in zip(who, _bands(held), strict=True):
                        bands[j] = row.tobytes()
                    held, who, size = [], [], 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row1", "row2")), pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(bands, pa.binary())], names=["doc_id", "row1", "row2", "fp", "sim", "bands"])

    one, two = digest(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("row1"), two.alias("row2"), "text")
    return d.mapInArrow(tidy(apply), "doc_id long, row1 long, row2 long, fp long, sim long, bands binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_pydict({"key": keys, "fp": np.repeat(batch.column("fp").to_numpy(), BANDS)})


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set of its component, by links of SIMILAR or more."""
    up, down = SIMILAR
    sizes = np.array([len(s) for s in sets], np.int64)
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, mark = np.repeat(np.arange(len(sets)), sizes), np.zeros(len(names), bool)
    spans = np.cumsum(sizes) - sizes
    every, root = code, np.full(len(sets), -1)
    live, dead = len(sets), 0
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], queue, dead = first, [first], dead + 1
        while queue:
            i = queue.pop()
            if 4 * dead > live:  # leave out what is settled
                rest = root[owner] < 0
                owner, code, live, dead = owner[rest], code[rest], live - dead, 0
            if not len(owner):
                break
            mine = every[spans[i] : spans[i] + sizes[i]]
            mark[mine] = True
            both = np.bincount(owner[mark[code]], minlength=len(sets))
            mark[mine] = False
            found = np.flatnonzero((down * both >= up * (sizes + sizes[i] - both)) & (root < 0))
            root[found] = first
            dead += len(found)
            queue += found.tolist()
    return root


def _settled(words: int):
    """Rows (root, fp, text) sorted by root: (fp, root) of each set, the root being one set of its true component."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if fps:
                f = np.array(fps, np.int64)
                yield pa.RecordBatch.from_pydict({"fp": f, "root": f[linked(sets)]})

        for batch in batches:
            for root, fp, text in zip(*(batch.column(c).to_pylist() for c in ("root", "fp", "text")), strict=True):
                if root != now:
                    yield from out()
                    now, fps, sets = root, [], []
                fps.append(fp)
                sets.append(shingles(text, words))
        yield from out()

    return apply


def _candidates(fps: DataFrame) -> DataFrame:
    """fps (fp, sim, bands): links (a, b) between sets that may be alike, enough to make them one component."""
    n = partitions(fps.sparkSession)
    met = fps.filter("bands is not null").select("fp", "bands").mapInArrow(tidy(_keys), "key long, fp long").repartition(4 * n, "key").sortWithinPartitions("key", "fp")
    by_bands = met.mapInArrow(tidy(_stars), "a long, b long")
    # one set stands for each SimHash; the others hang on it
    sims = cut(fps.filter("bands is not null").groupBy("sim").agg(F.min("fp").alias("head")))
    same = fps.filter("bands is not null").join(sims, "sim").filter("fp != head").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    near = simhash.links(sims.select(F.col("sim").alias("fp")))
    for end in ("a", "b"):
        near = near.join(sims.select(F.col("sim").alias(end), F.col("head").alias(f"head_{end}")), end)
    return by_bands.union(same).union(near.select("head_a", "head_b"))


def near_duplicates(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row1, row2, fp, root, component_id) of each document: its component as one set of it (root) and as its
    smallest doc_id."""
    n = partitions(docs.sparkSession)
    marked = cut(_signed(docs, words))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("row1", "row2")).alias("row"), F.min("sim").alias("sim"), F.min("bands").alias("bands")))
    near = components(_candidates(fps))
    # roots have no row of their own
    near = cut(near.union(near.select("root", "root").distinct()))
    wanted = fps.select("fp", "row.*").join(near, F.col("fp") == F.col("node")).select("row1", "row2", "fp", "root")
    one, two = digest(docs)
    texts = docs.select(one.alias("row1"), two.alias("row2"), "text").join(wanted, ["row1", "row2"]).dropDuplicates(["row1", "row2"])
    texts = texts.select("root", "fp", "text").repartition(4 * n, "root").sortWithinPartitions("root")
    found = cut(texts.mapInArrow(tidy(_settled(words)), "fp long, root long"))
    roots = cut(fps.select("fp", "least").join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.drop("sim", "bands").join(roots.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "row1", "row2", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, words: int) -> DataFrame:
    """docs with one row of each component: one with its smallest doc_id (null last), of these the one whose digest is
    the least. Columns are kept; of rows that are equal in all of them one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row1", "row2")
    first = cut(near_duplicates(docs, words).groupBy("root").agg(F.min(order).alias("r")).select("r.row1", "r.row2"))
    one, two = digest(docs)
    names = fresh(docs, "row1", "row2")
    kept = docs.withColumns(dict(zip(names, (one, two), strict=True))).join(first.toDF(*names), names, "left_semi")
    return kept.dropDuplicates(names).select(docs.columns)
