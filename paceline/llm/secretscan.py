"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order models over the characters of KEY_CHARS are trained from labelled samples, counted over all documents:
what the patterns match is labelled random, and as much again of strings in which each letter and digit follows each
other one alike; all other text but unlabelled candidates is labelled ordinary, as the words
that identifiers are made of. To these, STYLES of their weight is added as words are joined in identifiers: capitals
within and between words, all capitals, and the joining characters. A candidate of MIN_LENGTH characters or more that no
pattern covers is reported where the log-likelihood ratio of the models exceeds MIN_RATIO nats, whatever it consists of.
Null and empty texts have no spans; texts of any length are read whole; repeated rows each get theirs; null doc_ids stay
null; extra columns are left behind; an empty table gives no rows. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
MIN_LENGTH = 16
MIN_RATIO = 9.0
#: Weight of identifier styles, beside text as it stands, in the ordinary model, and of strings over all letters and
#: digits alike, beside what the patterns match, in the random one.
STYLES, ALIKE = 0.1, 1.0
#: Weight, in pairs, of the single characters in the smoothed transitions.
PRIOR = 20.0

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+\Z")
_N = len(KEY_CHARS) + 1
_CLASS = np.zeros(256, np.uint16)
_CLASS[np.frombuffer(KEY_CHARS.encode(), np.uint8)] = np.arange(1, _N)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of what the patterns match, in order."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if b"token" in low or b"secret" in low or b"passw" in low or b"api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _uncovered(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates that overlap none of the found spans."""
    starts, ends = [s for s, _, _ in found], list(accumulate((e for *_, e in found), max))
    for m in _CANDIDATE.finditer(text):
        k = bisect_left(starts, m.end())
        if not k or ends[k - 1] <= m.start():
            yield m.span()


def _transitions(data: bytes) -> np.ndarray:
    k = _CLASS[np.frombuffer(data, np.uint8)]
    return np.bincount(k[:-1].astype(np.int32) * _N + k[1:], minlength=_N * _N).astype(np.int64) if len(k) > 1 else np.zeros(_N * _N, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary, random = np.zeros(_N * _N, np.int64), np.zeros(_N * _N, np.int64)
    for batch in batches:
        held, taken, apart = [], [], []
        for text in batch.column("text").to_pylist():
            if text:
                held.append(text)
                found = base_spans(text)
                taken += [_VALUE.search(text[s:e])[0] for s, _, e in found]
                apart += [text[s:e] for s, e in _uncovered(text, found)] + [text[s:e] for s, _, e in found]
            if len(held) >= 300:
                ordinary += _transitions("\n".join(held).encode("utf-8", "replace"))
                held = []
        ordinary += _transitions("\n".join(held).encode("utf-8", "replace")) - _transitions("\n".join(apart).encode("utf-8", "replace"))
        random += _transitions("\n".join(taken).encode("utf-8", "replace"))
    ordinary = np.maximum(ordinary, 0)
    cells = np.flatnonzero(ordinary + random)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "ordinary": ordinary[cells], "random": random[cells]})


def _styled(text: np.ndarray) -> np.ndarray:
    """Transitions of identifiers in the usual styles, from those of text (class 0: any character that ends a word): as
    many as those within words, half of them with capitals within and between words, the rest with all capitals, and as
    many joints and pairs of digits as words."""
    lower = np.array([KEY_CHARS.index(c) + 1 for c in "abcdefghijklmnopqrstuvwxyz"])
    upper = np.array([KEY_CHARS.index(c) + 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    digits = np.array([KEY_CHARS.index(c) + 1 for c in "0123456789"])
    joints = np.array([KEY_CHARS.index(c) + 1 for c in "_./-=" + "0123456789"])
    within, ends, starts = text[np.ix_(lower, lower)], text[lower, 0], text[0, lower]
    out = np.zeros((_N, _N))
    out[np.ix_(upper, upper)] = within / 2
    first = within * (starts / np.maximum(within.sum(axis=1), 1))[:, None]
    out[np.ix_(upper, lower)] = first / 2
    share = starts / max(starts.sum(), 1)
    for case in (lower, upper):
        out[np.ix_(case, joints)] += np.outer(ends, np.ones(len(joints))) / len(joints) / 4
        out[np.ix_(joints, case)] += np.outer(np.ones(len(joints)), share * ends.sum()) / len(joints) / 4
    out[np.ix_(lower, upper)] = np.outer(ends, share) / 2
    out[np.ix_(digits, joints)] += ends.sum() / len(digits) / len(joints)
    out[np.ix_(joints, digits)] += ends.sum() / len(digits) / len(joints)
    return out


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random against ordinary, of each pair of characters; counts of all documents, smoothed.
    The driver gets one row for each pair that occurs, no more than (len(KEY_CHARS) + 1) ** 2."""
    rows = docs.select("text").mapInArrow(_count, "cell int, ordinary long, random long").groupBy("cell").agg(F.sum("ordinary"), F.sum("random")).collect()
    counts = np.zeros((2, _N * _N))
    for cell, ordinary, random in rows:
        counts[:, cell] = ordinary, random
    counts = counts.reshape(2, _N, _N)
    styled = _styled(counts[0])
    counts[0] += STYLES * styled * counts[0].sum() / max(styled.sum(), 1)
    counts[1, 1:63, 1:63] += ALIKE * (counts[1].sum() + 62.0) / 62**2
    counts = counts[:, 1:, 1:]
    single = [(x.sum(axis=0) + 0.1) / (x.sum() + 0.1 * (_N - 1)) for x in counts]
    p = [(x + PRIOR * s) / (x.sum(axis=1, keepdims=True) + PRIOR) for x, s in zip(counts, single, strict=True)]
    out = np.zeros((_N, _N))
    out[1:, 1:] = np.log(p[1]) - np.log(p[0])
    return out


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end): those of the patterns, and those that the models add beside them."""
    out, more = base_spans(text), []
    for start, end in _uncovered(text, out):
        c = _CLASS[np.frombuffer(text[start:end].encode(), np.uint8)]
        if ratio[c[:-1], c[1:]].sum() > MIN_RATIO:
            more.append((start, 3, end))
    return sorted(out + more)


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each document; trains on docs unless given models."""
    ratio = train(docs) if ratio is None else ratio

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [spans(t, ratio) if t else [] for t in batch.column("text").to_pylist()]
            base = [[x for x in f if x[1] < 3] for f in every]
            n = [pa.array([sum(x[1] == k for x in f) for f in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, pa.array([hashlib.sha256(shown(f).encode()).hexdigest() for f in base], pa.string()), pa.array([shown(f) for f in every], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
