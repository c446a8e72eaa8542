"""Suffix-array dedup on bytes: Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

Every window of LENGTH bytes has an anchor, the least hash of its GRAM-byte substrings, so equal windows have equal
anchors. Stretches of windows with one anchor that occurs once can't repeat and stay behind. Of equal stretches in a
portion of documents only the earliest travels, with its bytes, to the task of its anchor, where equal ones meet again.
A task sorts the cyclic rotations of each small shard once (of stretches, less the windows whose hash occurs once
there), and merges the shards' transforms without sorting suffixes again: the interleave of all shards is
refined symbol by symbol, each step a stable counting sort of the preceding symbols. Places whose prefixes still agree
after LENGTH steps are the repeated intervals, as their longest common prefix is LENGTH or more. All members of an
interval but the earliest are marked; marks that overlap merge, and their bytes go.

Null and empty texts lose nothing, extra columns are left behind, an empty table gives no rows. Rows that agree in
doc_id and text are one document, so neither removes the other's bytes; null
doc_ids come last; rows with one doc_id and other texts are ordered by a hash of the text. Bytes that are kept are
hashed as they are, even where a character has lost some of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm import exchange as X
from paceline.llm.common import cut, keyed, partitions
from paceline.llm.wordrepeat import mixed
from paceline.llm.workers import portions

LENGTH = 100
GRAM = 24
#: Symbols of one shard, and of the stretches that are merged together (more only where one anchor has more).
SHARD, MERGE = 1 << 15, 1 << 17
#: Bytes of text that are hashed at once.
PORTION = 1 << 22
#: Bytes of stretches that a merging task unpacks at once (more only where one anchor has more).
PART = 1 << 21
#: Bytes of compressed documents for each bucket of anchors, and how many merging tasks there are at most: beyond
#: that, a task takes several buckets, one after the other.
TASK, TASKS = 1 << 21, 20_000
#: Places of a portion that are hashed in one step: what is held beside the text is a few numbers for each of them.
BLOCK = 1 << 18
#: Windows of one stretch: longer runs with one anchor are cut.
MOST = 512
END = 0xFF  # no byte of UTF-8

_SPREAD = np.uint64(11400714819323198485)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM = 16 + 8 bytes from each place on; the last places wrap."""
    wide, out = np.concatenate([b, np.resize(b, GRAM)]), np.empty(len(b), np.uint64)
    for a in range(0, len(b), BLOCK):
        one, factor = mixed(wide[a : a + BLOCK + GRAM].astype(np.uint64) + np.uint64(1)), _SPREAD
        for size in (1, 2, 4, 8):
            eight = one
            one = one * factor + np.roll(one, -size)
            factor = factor * factor
        h = mixed(one * _SPREAD + np.roll(eight, -16))
        out[a : a + BLOCK] = h[: min(BLOCK, len(b) - a)]
    return out


def _window_min(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of h over the n places from each one on; the last n - 1 places mean nothing."""
    width = -(-len(h) // n) * n
    full = np.full(width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    blocks = full.reshape(-1, n)
    ahead, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = back[: len(h)].copy()
    out[: max(len(h) - n + 1, 0)] = np.minimum(out[: max(len(h) - n + 1, 0)], ahead[n - 1 : len(h)])
    return out


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the begins of the texts, and place, number of windows and anchor of each stretch."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    if len(b) < LENGTH:
        return b, begins, *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64)
    h, wide = _grams(b), LENGTH - GRAM + 1
    anchor = np.concatenate([_window_min(h[a : a + BLOCK + wide - 1], wide)[:BLOCK] for a in range(0, len(b), BLOCK)])
    ok = np.zeros(len(b) + 1, np.int32)
    whole = sizes >= LENGTH
    np.add.at(ok, begins[whole], 1)
    np.add.at(ok, (begins + sizes - LENGTH + 1)[whole], -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])])
    new[begins[sizes > 0]] = True
    at = np.flatnonzero(new)
    n = np.diff([*at, len(b)])
    at, n = at[ok[at]], n[ok[at]]
    key = anchor[at]
    if len(n) and n.max() > MOST:  # every part keeps the anchor
        parts = -(-n // MOST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, key, n = np.repeat(at, parts) + k * MOST, np.repeat(key, parts), np.minimum(np.repeat(n, parts) - k * MOST, MOST)
    return b, begins, at, n, key


def _within(b: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Stretches that hold their anchor twice or more, so that their windows may repeat one another."""
    h = _grams(b)
    same = np.zeros(len(b), bool)
    for k in range(n.max()):
        more = at[n > k] + k
        same[more] = h[more] == key[n > k]
    acc = np.concatenate([[0], np.cumsum(same)])
    times = acc[at + n] - acc[at]
    for k in range(LENGTH - GRAM):
        times += h[at + n + k] == key
    return times > 1


def _index(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(portions(batches, "text", PORTION)):
            b, begins, at, count, key = _stretches([t.encode() for t in batch.column("text").to_pylist()])
            if len(at):
                twice = _within(b, at, count, key)
                d = X.Directory.of_batch(batch, begins)
                low = key.astype(np.uint32)
                yield X.send(X.chunk_name(k), n, key, at, lambda i, low=low, twice=twice: (low[i].tobytes(), X.squeeze(np.packbits(twice[i]))), d, False)

    return apply


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of stretches whose anchor occurs more than once, in others or within them."""
    held: list[tuple] = []
    for batch in batches:
        for chunk, h, p, x, d in zip(*(batch.column(c).to_pylist() for c in ("chunk", "h", "p", "x", "dir")), strict=True):
            if d is not None:
                yield X.rows(X.FOUND, [(chunk, None, d)])
            if h is not None:
                h = np.frombuffer(h, np.uint32)
                held.append((chunk, h, X.ungaps(p), np.unpackbits(X.unsqueeze(x, np.uint8))[: len(h)].astype(bool)))
    if held:
        names, n = np.unique(np.concatenate([h for _, h, *_ in held]), return_counts=True)
        names = names[n > 1]
        for chunk, h, p, hit in held:
            if len(names):
                hit = hit | (names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h)
            if hit.any():
                yield X.rows(X.FOUND, [(chunk, X.squeeze(p[hit].astype(np.uint32)), None)])


def _carry(n: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(X.unpacked(batches, PORTION)):
            b, begins, at, count, key = _stretches(X.texts(batch))
            wanted = np.concatenate([X.unsqueeze(f, np.uint32).astype(np.int64) + x for x, f in zip(begins, batch.column("found").to_pylist(), strict=True)])
            hit = np.isin(at, wanted)
            at, count, key = at[hit], count[hit], key[hit]
            if not len(at):
                continue
            d = X.Directory.of_batch(batch, begins)
            whole = b.tobytes()
            # of equal stretches of a chunk only the earliest travels: the others are known to be repeats
            numbers: dict[bytes, int] = {}
            name = np.array([numbers.setdefault(whole[x : x + m + LENGTH - 1], len(numbers)) for x, m in zip(at.tolist(), count.tolist(), strict=True)])
            del numbers
            doc = d.of(at)
            again = X.later(name, d.none[doc], d.ids[doc], d.ths[doc], at - begins[doc])
            known = X.squeeze(np.stack([at[again], count[again]], axis=1).astype(np.uint32)) if again.any() else None
            at, count, key = at[~again], count[~again], key[~again]

            def payload(i, at=at, count=count, key=key, whole=whole):
                text = b"".join([whole[x : x + m + LENGTH - 1] for x, m in zip(at[i].tolist(), count[i].tolist(), strict=True)])
                return key[i].tobytes(), zstandard.compress(count[i].astype(np.uint16).tobytes() + text, 3)

            yield X.send(X.chunk_name(k), n, key, at, payload, d, True, known)

    return apply


def shard_order(text: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Order of the cyclic rotations of one shard's strings by their first 128 symbols, by doubling."""
    rank, jump = text.astype(np.int64), ahead
    for _ in range(7):
        order = np.argsort(rank * (int(rank.max()) + 1) + rank[jump], kind="stable")
        k = rank[order] * (int(rank.max()) + 1) + rank[jump][order]
        new = np.empty(len(text), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, jump = new, jump[jump]
        if rank.max() == len(text) - 1:
            break
    return np.argsort(rank, kind="stable")


def merged_classes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each string in their concatenation (each ended by END), and for each place there a class: places with
    equal classes have equal first LENGTH symbols, strings taken as cycles."""
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.cumsum(sizes) - sizes
    back = np.arange(-1, len(text) - 1, dtype=np.int32)
    back[begins] = begins + sizes - 1
    ahead = np.arange(1, len(text) + 1, dtype=np.int32)
    ahead[begins + sizes - 1] = begins
    # shards of whole strings; the transform of each, and where each symbol's rotation stands in its shard
    cuts = [0, *(int(begins[k]) for k in np.flatnonzero(np.diff(begins // SHARD)) + 1), len(text)]
    order, step = np.empty(len(text), np.int32), np.empty(len(text), np.int32)
    for a, b in zip(cuts, cuts[1:], strict=False):
        o = a + shard_order(text[a:b], back[a:b] - a, ahead[a:b] - a)
        order[a:b] = o
        step[a + np.argsort(text[back[o]], kind="stable")] = np.arange(a, b)
    symbol = text[back[order]]
    del back, ahead
    # the interleave: every rotation in order of its first symbols so far; to begin with, one shard after the other
    z, group = np.arange(len(text), dtype=np.int32), np.zeros(len(text), np.int32)
    for _ in range(LENGTH):
        c = symbol[z]
        perm = np.argsort(c, kind="stable")
        z, c, g = step[z[perm]], c[perm], group[perm]
        group = np.empty(len(text), np.int32)
        group[0] = 0
        np.cumsum((c[1:] != c[:-1]) | (g[1:] != g[:-1]), out=group[1:])
        if group[-1] == len(text) - 1:
            break
    out = np.empty(len(text), np.int32)
    out[order[z]] = group
    return begins, out


def _again(strings: list[bytes], count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, place, number) of windows whose hash occurs more than once among all of the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    total, starts = np.cumsum(sizes), np.cumsum(count) - count
    h, a = np.zeros(int(count.sum()), np.uint32), 0  # a false repeat only sends more to the merge
    while a < len(strings):
        b = max(a + 1, int(np.searchsorted(total, total[a] - sizes[a] + BLOCK)))
        one, factor, kept = mixed(np.frombuffer(b"".join(strings[a:b]), np.uint8).astype(np.uint64) + np.uint64(1)), _SPREAD, {}
        for n in (1, 2, 4, 8, 16, 32):
            one = one * factor + np.roll(one, -n)
            factor = factor * factor
            if n in (2, 16):
                kept[2 * n] = one
        low = (mixed((one * _SPREAD + np.roll(kept[32], -64)) * _SPREAD + np.roll(kept[4], -96)) >> np.uint64(32)).astype(np.uint32)
        m, begins = count[a:b], np.cumsum(sizes[a:b]) - sizes[a:b]
        h[starts[a] : starts[a] + m.sum()] = low[np.repeat(begins, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        a = b
    order = np.sort(h)
    names = np.unique(order[1:][order[1:] == order[:-1]])
    del order
    twice = np.zeros(len(h), bool)
    for a in range(0, len(h) if len(names) else 0, BLOCK):
        x = h[a : a + BLOCK]
        twice[a : a + BLOCK] = names[np.minimum(np.searchsorted(names, x), len(names) - 1)] == x
    new = np.zeros(len(h), bool)
    new[starts[count > 0]] = True
    new[1:] |= twice[1:] != twice[:-1]
    begins = np.flatnonzero(new)
    n = np.diff([*begins, len(h)])
    begins, n = begins[twice[begins]], n[twice[begins]]
    who = np.searchsorted(starts, begins, "right") - 1
    return who, begins - starts[who], n


def _repeats(texts: list[bytes], key: np.ndarray, count: np.ndarray, none: np.ndarray, ids: np.ndarray, ths: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (stretch, place, number) of windows that have an earlier equal, among stretches in order of their anchors."""
    # equal stretches are one string: all windows of its later occurrences are repeats
    numbers: dict[bytes, int] = {}
    name = np.array([numbers.setdefault(t, len(numbers)) for t in texts])
    again = X.later(name, none, ids, ths, rel)
    first = np.full(len(numbers), -1)
    one = np.flatnonzero(~again)
    first[name[one]] = one
    found = [(np.flatnonzero(again), np.zeros(again.sum(), np.int64), count[again])]
    # of the rest only runs of windows that occur again are merged; equal runs are one string once more
    run, at, count_of = _again([texts[i] for i in first.tolist()], count[first])
    i = first[run]
    parts = [texts[j][a : a + m + LENGTH - 1] for j, a, m in zip(i.tolist(), at.tolist(), count_of.tolist(), strict=True)]
    numbers = {}
    name = np.array([numbers.setdefault(t, len(numbers)) for t in parts], np.int64)
    again = X.later(name, none[i], ids[i], ths[i], rel[i] + at)
    found.append((i[again], at[again], count_of[again]))
    runs = np.flatnonzero(~again)
    runs = runs[np.argsort(key[i[runs]], kind="stable")]
    k = key[i[runs]]
    begin = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
    alone = begin & np.concatenate([begin[1:], [True]])[: len(k)]
    # a run alone with its anchor may still repeat within itself
    runs = runs[~alone | (count_of[runs] > 1)]
    k = key[i[runs]]
    size, batch = 0, []

    def settle(batch: list[int]) -> None:
        begins, cls = merged_classes([parts[r] for r in batch])
        m = count_of[batch]
        who = np.repeat(np.arange(len(batch)), m)
        off = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)
        r = np.array(batch)[who]
        late = X.later(cls[begins[who] + off], none[i[r]], ids[i[r]], ths[i[r]], rel[i[r]] + at[r] + off)
        found.append((i[r][late], (at[r] + off)[late], np.ones(late.sum(), np.int64)))

    for j, r in enumerate(runs.tolist()):
        if size > MERGE and k[j] != k[j - 1]:
            settle(batch)
            size, batch = 0, []
        batch.append(r)
        size += len(parts[r]) + 1
    if batch:
        settle(batch)
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SENT rows, those of a bucket together, to FOUND rows of (place, number of windows), all windows that have an
    earlier equal. What the rows of a bucket carry stays packed but for a few anchors at a time."""
    now, held = None, _Held()
    for batch in batches:
        for row in range(batch.num_rows):
            bucket, chunk, h, p, x, d = (batch.column(c)[row].as_py() for c in ("bucket", "chunk", "h", "p", "x", "dir"))
            if h is None:
                yield X.rows(X.FOUND, [(chunk, p, d)])
                continue
            if bucket != now:
                yield from held.settled()
                now, held = bucket, _Held()
            held.add(chunk, h, p, x, d)
    yield from held.settled()


class _Held:
    """The stretches of one bucket."""

    def __init__(self):
        self.chunks, self.directories, self.raws, self.columns = [], [], [], []

    def add(self, chunk: str, h: bytes, p: bytes, x: bytes, d: bytes) -> None:
        key, raw = np.frombuffer(h, np.uint64), zstandard.decompress(x)
        n = np.frombuffer(raw, np.uint16, len(key)).astype(np.int32)
        start = (2 * len(key) + np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)).astype(np.int32)
        self.columns.append((key, n, X.ungaps(p).astype(np.uint32), start, np.full(len(key), len(self.chunks), np.int32)))
        self.raws.append(raw)
        self.chunks.append(chunk)
        self.directories.append(X.Directory.unpack(d))

    def settled(self) -> Iterator[pa.RecordBatch]:
        if not self.chunks:
            return
        key, count, place, start, source = (np.concatenate(v) for v in zip(*self.columns, strict=True))
        self.columns = []
        order, found = np.argsort(key, kind="stable"), []
        # anchors in portions of about PART bytes; all stretches of an anchor are in one
        begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        part = (np.cumsum(count[order].astype(np.int64) + LENGTH - 1) // PART)[begin]
        cuts = [*begin[np.concatenate([[True], np.diff(part) != 0])].tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            i = order[a:b]
            texts = [self.raws[s][x : x + m + LENGTH - 1] for s, x, m in zip(source[i].tolist(), start[i].tolist(), count[i].tolist(), strict=True)]
            none, (ids, ths, rel) = np.zeros(len(i), bool), np.zeros((3, len(i)), np.int64)
            by = np.argsort(source[i], kind="stable")
            for mine in np.split(by, np.flatnonzero(np.diff(source[i][by])) + 1):
                d, p = self.directories[source[i[mine[0]]]], place[i[mine]].astype(np.int64)
                doc = d.of(p)
                none[mine], ids[mine], ths[mine], rel[mine] = d.none[doc], d.ids[doc], d.ths[doc], p - d.begins[doc]
            who, off, n = _repeats(texts, key[i], count[i].astype(np.int64), none, ids, ths, rel)
            found.append((i[who].astype(np.int32), off.astype(np.int32), n.astype(np.int32)))
        i, off, n = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(source[i], kind="stable")
        i, off, n = i[order], off[order], n[order]
        for s, chunk in enumerate(self.chunks):
            a, b = np.searchsorted(source[i], [s, s + 1])
            if b > a:
                yield X.rows(X.FOUND, [(chunk, X.squeeze(np.stack([place[i[a:b]] + off[a:b].astype(np.uint32), n[a:b].astype(np.uint32)], axis=1)), None)])


def later_bytes(docs: DataFrame) -> DataFrame:
    """BACK rows: (place, number) of the windows of each document that start earlier elsewhere."""
    n = partitions(docs.sparkSession)
    d = keyed(docs)
    found = d.mapInArrow(_index(n), X.SENT).repartitionById(n, "bucket").mapInArrow(_shared, X.FOUND)
    both = X.with_found(X.squeezed(d), X.united(X.give_back(found, 1))).filter("found is not null")
    both = cut(both)
    # bytes travel here, and each task holds those of its anchors
    buckets = max(n, int(both.agg(F.sum(F.octet_length("z"))).first()[0] or 0) // TASK)
    tasks = min(buckets, max(n, TASKS))
    task = F.floor(F.col("bucket").cast("long") * tasks / buckets).cast("int")
    sent = both.mapInArrow(_carry(buckets), X.SENT).repartitionById(tasks, task)
    if tasks < buckets:
        sent = sent.sortWithinPartitions("bucket")
    found = sent.mapInArrow(_merge, X.FOUND)
    return X.united(X.give_back(found, 2))


_KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each document: the maximal removed runs, in bytes, end exclusive, and the bytes
    that stay (not always whole characters)."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.unpacked(batches, PORTION):
            sizes, spans, kept = [], [], []
            for t, f in zip(X.texts(batch), batch.column("found").to_pylist(), strict=True):
                sizes.append(len(t))
                runs = []
                if f is not None:
                    v = X.unsqueeze(f, np.uint32).astype(np.int64).reshape(-1, 2)
                    runs = X.merged(v[:, 0], v[:, 0] + v[:, 1] + LENGTH - 1)
                    t = b"".join(t[a:b] for a, b in X.between(runs, len(t)))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, _SPAN), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return X.with_found(X.squeezed(keyed(docs)), later_bytes(docs)).mapInArrow(apply, _KEPT)


def byte_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    gone = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
