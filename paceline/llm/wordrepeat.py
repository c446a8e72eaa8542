"""Substring dedup on words, by fixed-block anchors.

Reference blocks of BLOCK words, one after the other in each document, are indexed. Every rolling window of BLOCK words
of all documents probes the index. A repeated window of WINDOW = 2 * BLOCK words holds a whole block wherever it is, so
what doesn't hold a hit can't repeat. The index only finds hits, and false ones cost time alone. Hits are extended by up
to BLOCK words both ways, to the windows of WINDOW words around them; windows are equal if 64 bits of one hash of
their words and 32 bits of another, independent one agree. All but the earliest are marked, and marks that touch merge into maximal repeats, which go.

Null, empty and shorter texts lose nothing; texts of any length are read whole; extra columns are left behind; an empty
table gives no rows. Rows that agree in doc_id and text are one document, so neither removes the other's words, and each
gets its own row; null doc_ids come last; rows with one doc_id and other texts are ordered by a hash of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm import exchange as X
from paceline.llm.common import KEY, cut, keyed, partitions
from paceline.llm.workers import portions

BLOCK = 10
WINDOW = 20
#: Bytes of text whose words are hashed at once.
PORTION = 1 << 24

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolled(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n elements from each place on; the last n - 1 places wrap and mean nothing."""
    out = np.zeros(len(w), np.uint64)
    for k in range(n):
        out = out * _PRIME + np.roll(w, -k)
    return mixed(out)


def _words(texts: list[bytes], digest, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words, `width` numbers of 64 bits each, and the number of words of each text."""
    hashes, sizes = [np.zeros(0, np.uint64)], []
    for t in texts:
        hashes.append(np.frombuffer(b"".join(map(digest, _WORD.findall(t))), np.uint64))
        sizes.append(len(hashes[-1]) // width)
    return np.concatenate(hashes), np.array(sizes, np.int64)


def _inside(begins: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Places at which a window of n words ends within its document."""
    ok = np.zeros(total + 1, np.int32)
    whole = sizes >= n
    np.add.at(ok, begins[whole], 1)
    np.add.at(ok, (begins + sizes - n + 1)[whole], -1)
    return np.cumsum(ok[:-1]) > 0


def _probe(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(portions(batches, "text", PORTION)):
            w, sizes = _words([t.encode() for t in batch.column("text").to_pylist()], xxhash.xxh3_64_digest, 1)
            begins = np.cumsum(sizes) - sizes
            p = np.flatnonzero(_inside(begins, sizes, BLOCK, len(w)))
            if not len(p):
                continue
            h = rolled(w, BLOCK)[p]
            d = X.Directory.of_batch(batch, begins)
            block = (p - begins[np.searchsorted(begins, p, "right") - 1]) % BLOCK == 0
            # 32 bits beside the bucket: chance hits only make more candidates
            low = h.astype(np.uint32)
            yield X.send(X.chunk_name(k), n, h, p, lambda i, low=low, block=block: (low[i].tobytes(), X.squeeze(np.packbits(block[i]))), d, False)

    return apply


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, places, blocks, chunks = [], [], [], []
    for batch in batches:
        for chunk, h, p, x, d in zip(*(batch.column(c).to_pylist() for c in ("chunk", "h", "p", "x", "dir")), strict=True):
            if d is not None:
                yield X.rows(X.FOUND, [(chunk, None, d)])
            if h is not None:
                hashes.append(np.frombuffer(h, np.uint32))
                places.append(X.ungaps(p).astype(np.uint32))
                blocks.append(np.unpackbits(X.unsqueeze(x, np.uint8))[: len(hashes[-1])].astype(bool))
                chunks.append(chunk)
    if not hashes:
        return
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order[1:]] != every[order[:-1]]])
    group = np.cumsum(new) - 1
    # a hash that occurs twice or more, and as a block
    wanted = (np.bincount(group) > 1) & (np.bincount(group, weights=np.concatenate(blocks)[order]) > 0)
    hit = np.empty(len(every), bool)
    hit[order] = wanted[group]
    at = 0
    for chunk, p in zip(chunks, places, strict=True):
        mine, at = p[hit[at : at + len(p)]], at + len(p)
        if len(mine):
            yield X.rows(X.FOUND, [(chunk, X.squeeze(mine), None)])


def _repeats(h: np.ndarray, other: np.ndarray, p: np.ndarray, d: X.Directory) -> np.ndarray:
    """Which windows of a portion, at places p, have an earlier one in it with both hashes equal."""
    order = np.lexsort((other, h))
    same = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    who, cls = order[many], np.cumsum(np.concatenate([[True], ~same]))[many]
    doc = d.of(p[who])
    again = np.zeros(len(p), bool)
    again[who] = X.later(cls, d.none[doc], d.ids[doc], d.ths[doc], p[who] - d.begins[doc])
    return again


def _extend(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(X.unpacked(batches, PORTION)):
            w, sizes = _words(X.texts(batch), xxhash.xxh3_128_digest, 2)
            w, v = w[::2].copy(), w[1::2].copy()
            begins = np.cumsum(sizes) - sizes
            near = np.zeros(len(w) + 1, np.int32)
            for b, f in zip(begins, batch.column("found").to_pylist(), strict=True):
                hit = X.unsqueeze(f, np.uint32).astype(np.int64)
                np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0) + b, 1)
                np.add.at(near, hit + b + 1, -1)
            p = np.flatnonzero((np.cumsum(near[:-1]) > 0) & _inside(begins, sizes, WINDOW, len(w)))
            if not len(p):
                continue
            h = rolled(w, WINDOW)[p]
            # 96 bits: all of one hash, half of the other
            both = np.stack([h >> np.uint64(32), h & np.uint64(0xFFFFFFFF), rolled(v, WINDOW)[p] >> np.uint64(32)], axis=1).astype(np.uint32)
            d = X.Directory.of_batch(batch, begins)
            # of equal windows of a portion only the earliest travels: the others are known to be repeats
            again = _repeats(h, both[:, 2], p, d)
            known, h, p, both = p[again], h[~again], p[~again], both[~again]
            yield X.send(X.chunk_name(k), n, h, p, lambda i, both=both: (both[i].tobytes(), None), d, True, X.squeeze(known.astype(np.uint32)) if len(known) else None)

    return apply


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for chunk, h, p, d in zip(*(batch.column(c).to_pylist() for c in ("chunk", "h", "p", "dir")), strict=True):
            if h is None:
                yield X.rows(X.FOUND, [(chunk, p, d)])
            else:
                held.append((chunk, np.frombuffer(h, np.uint32).reshape(-1, 3), X.ungaps(p), X.Directory.unpack(d)))
    if not held:
        return
    every = np.concatenate([h for _, h, _, _ in held])
    order = np.lexsort((every[:, 2], every[:, 1], every[:, 0]))
    same = (every[order][1:] == every[order][:-1]).all(axis=1)
    cls = np.empty(len(every), np.int32)
    cls[order] = np.cumsum(np.concatenate([[True], ~same]))
    del every
    again = np.zeros(len(cls), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    who = np.flatnonzero(again)
    source = np.repeat(np.arange(len(held)), [len(h) for _, h, _, _ in held])[who]
    place = np.concatenate([p for *_, p, _ in held])[who]
    none, ids, ths, rel = np.zeros(len(who), bool), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
    for k, (*_, d) in enumerate(held):
        a, b = np.searchsorted(source, [k, k + 1])
        doc = d.of(place[a:b])
        none[a:b], ids[a:b], ths[a:b], rel[a:b] = d.none[doc], d.ids[doc], d.ths[doc], place[a:b] - d.begins[doc]
    marked = X.later(cls[who], none, ids, ths, rel)
    for k, (chunk, *_) in enumerate(held):
        a, b = np.searchsorted(source, [k, k + 1])
        if marked[a:b].any():
            yield X.rows(X.FOUND, [(chunk, X.squeeze(place[a:b][marked[a:b]].astype(np.uint32)), None)])


def later_windows(docs: DataFrame) -> DataFrame:
    """BACK rows: the places, in words, of the windows of each document that start earlier elsewhere."""
    n = partitions(docs.sparkSession)
    d = keyed(docs)
    found = d.mapInArrow(_probe(n), X.SENT).repartitionById(n, "bucket").mapInArrow(_hits, X.FOUND)
    hits = X.give_back(found, 1).dropDuplicates(KEY)
    both = X.with_found(X.squeezed(d), hits).filter("found is not null")
    both = cut(both)  # chunks need a stable order
    found = both.mapInArrow(_extend(n), X.SENT).repartitionById(n, "bucket").mapInArrow(_later, X.FOUND)
    return X.united(X.give_back(found, 1))


_KEPT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, kept) of each document: the maximal repeats that go, in words, end exclusive, and the
    words that stay, joined by single spaces."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.unpacked(batches, PORTION):
            sizes, spans, kept = [], [], []
            for t, f in zip(X.texts(batch), batch.column("found").to_pylist(), strict=True):
                words, runs = _WORD.findall(t), []
                sizes.append(len(words))
                if f is not None:
                    p = X.unsqueeze(f, np.uint32).astype(np.int64)
                    runs = X.merged(p, p + WINDOW)
                    words = [w for a, b in X.between(runs, len(words)) for w in words[a:b]]
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, SPAN), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return X.with_found(X.squeezed(keyed(docs)), later_windows(docs)).mapInArrow(apply, _KEPT)


def word_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeated_words(docs).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
