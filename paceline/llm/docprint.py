"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is the multiset of its paragraph pieces (paragraphs end at line breaks; a piece is up to PIECE_WORDS words of
one paragraph, counted from its start). Each piece hashes to a vector of LANES entries, each +1 or -1, and the
fingerprint is their sum modulo 2**32. Sums don't depend on order, and a piece is inserted or deleted by adding or
subtracting its vector. The mean square of the difference of two fingerprints estimates how many pieces two texts don't
share, which gives their likeness. Null counts as empty; a text without words has the zero vector. Texts of any length
count whole. Repeated rows are each other's neighbours. Extra columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import partitions

LANES = 128
PIECE_WORDS = 4


def pieces(text: str) -> list[bytes]:
    out = []
    for paragraph in text.split("\n"):
        words = paragraph.split()
        out += [" ".join(words[i : i + PIECE_WORDS]).encode() for i in range(0, len(words), PIECE_WORDS)]
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """One row of LANES unsigned 32-bit sums for each text."""
    out = np.zeros((len(texts), LANES), np.uint32)
    at, digests, begins, owners = 0, [], [], []

    def flush():
        if begins:
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, LANES // 8), axis=1)
            ones = np.add.reduceat(bits, begins, axis=0, dtype=np.uint32)
            n = np.diff([*begins, len(bits)])[:, None]
            out[owners] = ((2 * ones.astype(np.int64) - n) % (1 << 32)).astype(np.uint32)

    for i, text in enumerate(texts):
        found = [xxhash.xxh3_128_digest(p) for p in pieces(text)]
        if found:
            begins.append(at)
            owners.append(i)
            digests += found
            at += len(found)
        if at > 50_000:
            flush()
            at, digests, begins, owners = 0, [], [], []
    flush()
    return out


def insert(fingerprint: str, added: str) -> str:
    """The fingerprint of a text with further paragraphs."""
    return pack((unpack(fingerprint) + vectors([added])[0]).astype(np.uint32))


def delete(fingerprint: str, removed: str) -> str:
    """The fingerprint of a text without the given paragraphs."""
    return pack((unpack(fingerprint) - vectors([removed])[0]).astype(np.uint32))


def pack(v: np.ndarray) -> str:
    return v.astype(">u4").tobytes().hex()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of pieces that two texts have in common, row by row; 1 for equal fingerprints."""
    power = lambda x: (x.view(np.int32).astype(np.float64) ** 2).sum(axis=-1)
    apart, total = power(np.ascontiguousarray(a - b)), power(a) + power(b)
    return np.where(apart == 0, 1.0, np.clip(1 - apart / np.maximum(total, 1), 0.0, 1.0))


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column for each text; every other column is kept."""
    @F.pandas_udf("string")
    def of(s):
        import pandas as pd

        return pd.Series([pack(v) for v in vectors([x or "" for x in s])], index=s.index, dtype=object)

    return docs.withColumn(into, of(F.col(text)))


def _ranges(docs: DataFrame, n: int) -> tuple[Column, int]:
    """The range of doc_id that a row of docs (doc_id, th, text) is in, numbered in order, and how many there are. An id
    that fills ranges of its own, or a missing one, is dealt to ranges of its text's hash."""
    cuts = [int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)] if n > 1 else []
    often = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    bounds = sorted({*cuts, *(x - 1 for x in often)})
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("doc_id"))) if bounds else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(below).cast("int")
    counts = dict(docs.groupBy(bucket).count().collect())
    mean = max(1, sum(counts.values()) // n)
    alone = {bounds.index(x) for x in often} | {len(bounds) + 1}
    parts = [max(1, -(-counts.get(b, 0) // mean)) if b in alone else 1 for b in range(len(bounds) + 2)]
    before = [sum(parts[:b]) for b in range(len(parts))]
    of = lambda values: F.get(F.array(*map(F.lit, values)), bucket)
    place = F.floor((F.col("th").cast("double") + 2.0**63) / 2.0**64 * of(parts))
    return (of(before) + F.least(place, of(parts) - 1)).cast("int"), sum(parts)


def neighbours(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) in ranges of doc_id, one range in one partition, in order; each range ends
    with a row marked as tail, the one that follows it (after the last range: the first row of all).

    Order: doc_id, null last, then a hash of the text, then the text; null texts are empty. Only the first rows of ranges
    move twice. Rows that are equal in id and text are in one range.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    bucket, ranges = _ranges(docs.select("doc_id", "th"), n or partitions(docs.sparkSession))
    docs = docs.withColumn("bucket", bucket)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    firsts = docs.groupBy("bucket").agg(F.min(first).alias("h")).select("bucket", "h.doc_id", "h.th").collect()
    order = sorted(r["bucket"] for r in firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    least = docs.sparkSession.createDataFrame([tuple(r) for r in firsts], "b int, i long, t long")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")) & (F.col("bucket") == F.col("b"))
    # one row for each range
    heads = docs.join(F.broadcast(least), same, "left_semi").groupBy("bucket").agg(F.min(F.struct("doc_id", "th", "text")).alias("h"))
    if before:
        to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("bucket"))
        heads = heads.withColumn("bucket", to)
    heads = heads.select("h.*", F.col("bucket").cast("int"), F.lit(True).alias("tail"))
    both = docs.withColumn("tail", F.lit(False)).unionByName(heads)
    return both.repartitionById(max(ranges, 1), F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "th", "text").drop("th")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, text of the next)."""
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, u in rows]
        a, b, c = vectors([t for _, t, _ in rows]), vectors(edited), vectors([u for *_, u in rows])
        cols = [[i for i, *_ in rows], [len(t) for _, t, _ in rows], [hashlib.sha256(x.encode()).hexdigest() for x in edited], [pack(x) for x in a], [pack(x) for x in b], likeness(a, b), likeness(a, c)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    last, ready, held = None, [], 0
    for batch in batches:
        for bucket, tail, i, text in zip(*(batch.column(k).to_pylist() for k in ("bucket", "tail", "doc_id", "text")), strict=True):
            if last and last[0] == bucket:
                ready.append((last[1], last[2], text))
                held += len(text)
            last = None if tail else (bucket, i, text)
            if len(ready) >= 500 or held > 4_000_000:
                yield emit(ready)
                ready, held = [], 0
    if ready:
        yield emit(ready)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document (see `neighbours`).

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next one.
    """
    return neighbours(docs).mapInArrow(_compare, ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'string' if f.type == pa.string() else 'long'}" for f in _OUT))
