"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within RADIUS = 4 bits are linked. One half of their 64 bits then differs in two bits or fewer, so each
distinct fingerprint emits, for each half, all variants of the half within half of that (one bit): two such
fingerprints meet in a variant. Buckets of one variant are verified pair by pair up to BUCKET members. The members of a
larger one emit all 2,081 variants of the whole fingerprint within two bits: any two that share a variant are within
four bits, so each only links to the least fingerprint of its variant (at most 2,081 can share one) and no pairs are
made. Links run between distinct fingerprints alone; equal ones share a component from the start.

Null and wordless texts have fingerprint zero. Null doc_ids get a component, and are the smallest id of none.
Repeated rows give repeated rows. Texts of any length are read whole; extra columns are left behind; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut, partitions
from paceline.llm.components import components
from paceline.llm.workers import tidy

RADIUS = 4
SHINGLE = 4
BUCKET = 128

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes (none empty) the bits that are set in over half of them."""
    sizes = np.array([len(s) for s in sets])
    bits = np.unpackbits(np.concatenate(sets).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(texts: list[str | None], words: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text, over shingles with repeats."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size, digest = 0, xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = _WORD.findall(text.encode().lower()) if text else []
        if not w:
            continue
        line, at = b" ".join(w), [0]
        for x in w:
            at.append(at[-1] + len(x) + 1)
        ends = at[min(words, len(w)) :]
        held.append(np.array([digest(line[a : b - 1], 42) for a, b in zip(at, ends, strict=False)], np.uint64))
        owners.append(i)
        size += len(ends)
        if size > 100_000:
            out[owners] = majority(held)
            held, owners, size = [], [], 0
    if held:
        out[owners] = majority(held)
    return out


def with_fingerprint(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp), the fingerprint as a signed long."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text").to_pylist(), words).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(apply), "doc_id long, fp long")


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ONE = np.concatenate([[np.uint64(0)], _BITS[:32]])
_TWO = np.concatenate([[np.uint64(0)], _BITS, *[_BITS[i] | _BITS[i + 1 :] for i in range(63)]])


def _half_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for half in (0, 1):
            part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            keys = (part[:, None] ^ _ONE[None, :]) | np.uint64(half << 32)
            yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "fp": np.repeat(fp, len(_ONE)).view(np.int64)})


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("fp").to_numpy().view(np.uint64)
        for k in range(0, len(every), 200):
            fp = every[k : k + 200]
            yield pa.RecordBatch.from_pydict({"key": (fp[:, None] ^ _TWO[None, :]).ravel().view(np.int64), "fp": np.repeat(fp, len(_TWO)).view(np.int64)})


def _pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Linked pairs within runs of equal keys."""
    f, found = fp.view(np.uint64), []
    here = np.arange(len(key))
    for d in range(1, BUCKET):
        here = here[here < len(key) - d]
        here = here[key[here] == key[here + d]]
        if not len(here):
            break
        apart = f[here] ^ f[here + d]
        ok = np.bitwise_count(apart) <= RADIUS
        # halves that agree meet in 33 variants; the half itself stands for them
        half = np.where(key[here] >> 32 == 1, apart >> np.uint64(32), apart & np.uint64(0xFFFFFFFF))
        mine = np.where(key[here] >> 32 == 1, f[here] >> np.uint64(32), f[here] & np.uint64(0xFFFFFFFF))
        ok &= (half != 0) | (mine == (key[here] & 0xFFFFFFFF).view(np.uint64))
        found.append((fp[here[ok]], fp[here[ok] + d]))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "hot": np.zeros(len(a), bool)})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: links of small buckets, and (member, member, True) for each member of a larger one."""
    hot, key, fp = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def large(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": x, "b": x, "hot": np.ones(len(x), bool)})

    for batch in batches:
        key, fp = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([fp, batch.column("fp").to_numpy()])
        if hot is not None:
            n = np.searchsorted(key, hot, "right")
            yield large(fp[:n])
            key, fp = key[n:], fp[n:]
        if not len(key):
            continue
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff([*begins, len(key)])
        big = np.repeat(sizes > BUCKET, sizes)
        hot = key[-1] if big[-1] else None
        yield large(fp[big])
        last = begins[-1] if not big[-1] else len(key)
        done = ~big
        done[last:] = False
        yield from _pairs(key[done], fp[done])
        key, fp = key[last:], fp[last:]
    yield from _pairs(key, fp)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and fp: each member of a variant linked to its least."""
    last_key, last_fp = None, None
    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        heads = fp[begins]
        if last_key is not None and key[0] == last_key:
            heads = np.concatenate([[last_fp], heads[1:]])
        first = np.repeat(heads, np.diff([*begins, len(key)]))
        last_key, last_fp = key[-1], first[-1]
        pairs = np.unique(np.stack([fp, first], axis=1)[fp != first], axis=0)
        yield pa.RecordBatch.from_pydict({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})


def links(fps: DataFrame) -> DataFrame:
    """fps (fp, distinct): edges (a, b) whose components are those of all links within RADIUS bits."""
    n = partitions(fps.sparkSession)
    met = fps.select("fp").mapInArrow(tidy(_half_balls), "key long, fp long").repartition(4 * n, "key").sortWithinPartitions("key", "fp")
    met = cut(met.mapInArrow(tidy(_verified), "a long, b long, hot boolean").distinct())
    hot = met.filter("hot").select(F.col("a").alias("fp")).distinct()
    stars = hot.repartition(n, "fp").mapInArrow(tidy(_balls), "key long, fp long").repartition(4 * n, "key").sortWithinPartitions("key", "fp").mapInArrow(tidy(_stars), "a long, b long")
    return met.filter("not hot").select("a", "b").union(stars)


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, root, component_id) of each document: root is the least fingerprint of its component, component_id
    the smallest doc_id there."""
    marked = cut(with_fingerprint(docs, words))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = fps.join(components(links(fps)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots)
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(roots.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

