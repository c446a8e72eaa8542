"""Packed exchanges: hashes of places in documents go to the task of their hash, and places come back to documents.

A chunk is what one Arrow batch holds: documents in a row, with places counted over all of them. For each chunk and
bucket one row carries hashes (the bucket is their leading part) and places; what a bucket finds goes back as places of
chunks and is sorted out to documents by the chunk's directory. A document is known by common.KEY, for rows without an
id 128 bits of the text. Input partitions must be stable, as those of a table scan are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import KEY
from paceline.llm.workers import sliced

SENT = "bucket int, chunk string, h binary, p binary, x binary, dir binary"
FOUND = "chunk string, p binary, dir binary"
BACK = "none boolean, k long, th long, found binary"

_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def unsqueeze(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def gaps(p: np.ndarray) -> bytes:
    return squeeze(np.diff(p, prepend=0).astype(np.uint32))


def ungaps(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint32), dtype=np.int64)


def squeezed(docs: DataFrame) -> DataFrame:
    """keyed documents with the text compressed, for a shuffle."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            packed = pa.array([z.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *KEY)), packed], names=["doc_id", *KEY, "z"])

    return docs.mapInArrow(apply, "doc_id long, none boolean, k long, th long, z binary")


class Directory:
    """Documents of a chunk and where each begins."""

    def __init__(self, none: np.ndarray, ids: np.ndarray, ths: np.ndarray, begins: np.ndarray):
        self.none, self.ids, self.ths, self.begins = none, ids, ths, begins

    @staticmethod
    def of_batch(batch: pa.RecordBatch, begins: np.ndarray) -> Directory:
        none, ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)
        return Directory(none.astype(bool), ids, ths, np.asarray(begins, np.int64))

    def pack(self) -> bytes:
        return squeeze(np.concatenate([x.view(np.uint8) for x in (self.ids.copy(), self.begins.copy(), self.ths.copy(), self.none.copy())]))

    def part(self, p: np.ndarray) -> Directory:
        """Of the documents in which some of the places p lie."""
        k = np.unique(self.of(p))
        return Directory(self.none[k], self.ids[k], self.ths[k], self.begins[k])

    @staticmethod
    def unpack(b: bytes) -> Directory:
        raw = unsqueeze(b, np.uint8)
        n = len(raw) // 25
        ids, begins, ths = (raw[8 * n * i : 8 * n * (i + 1)].view(np.int64) for i in range(3))
        return Directory(raw[24 * n :].astype(bool), ids, ths, begins)

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, p, "right") - 1


def buckets(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash, by its leading 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def rows(schema: str, items: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([i[k] for i in items], kinds[t]) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def chunk_name(k: int) -> str:
    return f"{TaskContext.get().partitionId()}-{k}"


def send(chunk: str, n: int, h: np.ndarray, p: np.ndarray, payload, directory: Directory, everywhere: bool, known: bytes | None = None) -> pa.RecordBatch:
    """A row for each bucket that has places; payload(indices) gives (h, x). The directory goes to one bucket more, with
    what is `known` to be found already; with `everywhere` the part of it that concerns a row goes with that row."""
    b = buckets(h, n)
    order = np.argsort(b.astype(np.uint16) if n < 65536 else b, kind="stable")
    out = []
    for i in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:
        packed, more = payload(i)
        out.append((int(b[i[0]]), chunk, packed, gaps(p[i]), more, directory.part(p[i]).pack() if everywhere else None))
    out.append((sum(map(ord, chunk)) % n, chunk, None, known, None, directory.pack()))
    return rows(SENT, out)


def give_back(found: DataFrame, width: int) -> DataFrame:
    """FOUND rows to BACK rows: places of each document, relative to its begin, each the first of `width` numbers."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, directory = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if parts:
                v = np.concatenate(parts).reshape(-1, width)
                v = v[np.argsort(v[:, 0], kind="stable")]
                doc = directory.of(v[:, 0])
                cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                items = []
                for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
                    k, w = doc[a], v[a:b].copy()
                    w[:, 0] -= directory.begins[k]
                    items.append((bool(directory.none[k]), int(directory.ids[k]), int(directory.ths[k]), squeeze(w.astype(np.uint32))))
                for i in range(0, len(items), 2000):
                    yield rows(BACK, items[i : i + 2000])

        for batch in batches:
            for c, p, d in zip(*(batch.column(x).to_pylist() for x in _names(FOUND)), strict=True):
                if c != chunk:
                    yield from out()
                    chunk, parts, directory = c, [], None
                if p is not None:
                    parts.append(unsqueeze(p, np.uint32).astype(np.int64))
                if d is not None:
                    directory = Directory.unpack(d)
        yield from out()

    return found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(apply, BACK)


def united(back: DataFrame) -> DataFrame:
    """BACK rows, one of each document: repeated rows of a document have all places that any of them has."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p[0] if len(p) == 1 else squeeze(np.concatenate([unsqueeze(x, np.uint32) for x in p])) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.array(found, pa.binary())], names=_names(BACK))

    return back.groupBy(*KEY).agg(F.collect_set("found").alias("parts")).mapInArrow(apply, BACK)


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """squeezed documents with what was found in them (null: nothing)."""
    return docs.join(found, KEY, "left")


def unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about `most` bytes of text once unpacked, one row at least. The size is in the head
    of a packed text, so texts that pack to nearly nothing count whole."""
    for batch in batches:
        sizes = [zstandard.frame_content_size(x) for x in batch.column("z").to_pylist()]
        yield from sliced(batch, np.array(sizes, np.int64), most)


def texts(batch: pa.RecordBatch) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in batch.column("z").to_pylist()]


def merged(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one, in order."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])[: len(begins)]
    last = np.concatenate([new[1:], [True]])[: len(begins)]
    return list(zip(begins[new].tolist(), ends[last].tolist(), strict=True))


def between(runs: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """What the runs leave of 0 to total."""
    return [(a, b) for a, b in zip([0, *(e for _, e in runs)], [*(b for b, _ in runs), total], strict=True) if b > a]


def later(cls: np.ndarray, none: np.ndarray, ids: np.ndarray, ths: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Of members of classes, which have an earlier member: by KEY (no id last), place in the document. Repeated
    rows of one document stand at the same place, so none of them is later than the other."""
    order = np.lexsort((rel, ths, ids, none, cls))
    c = cls[order]
    first = np.concatenate([[True], c[1:] != c[:-1]])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))]
    out = np.zeros(len(cls), bool)
    out[order] = ~((none[order] == none[head]) & (ids[order] == ids[head]) & (ths[order] == ths[head]) & (rel[order] == rel[head]))
    return out
