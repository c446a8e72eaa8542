"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import zstandard
from helpers import ODD, docs, prose

from paceline.llm import exchange, suffixmerge, wordrepeat


def brute_words(rows):
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for none, k, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[None if none else k, t] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted(str((r[0], *out[r[0], r[1] or ""])) for r in rows)


def test_portions_count_unpacked_bytes():
    texts = [b"the same phrase again " * 50_000, *[b"short"] * 3, b"the same phrase again " * 50_000, b""]
    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.compress(t, 3) for t in texts], pa.binary())], names=["z"])
    assert batch.nbytes < 2000
    got = [exchange.texts(b) for b in exchange.unpacked([batch] * 20, 1 << 20)]
    assert [t for x in got for t in x] == texts * 20
    assert max(sum(map(len, x)) for x in got) < 2 * (1 << 20) + len(texts[0])


def test_words(spark, monkeypatch):
    rows = prose(21, 200, 120) + [r for r in ODD if r[0] != 5] + [(900, "a b c " * 400, None, None, 0), (901, "a b c " * 30 + "x", None, None, 0)]
    rng = random.Random(1)
    rows = [(r[0] if r[0] is None or k >= 200 else 5000 - r[0], *r[1:]) for k, r in enumerate(rows)]
    rng.shuffle(rows)
    got = wordrepeat.word_report(docs(spark, rows).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_words(rows)
    assert sum(r.n_removed for r in got) > 500
    monkeypatch.setattr(wordrepeat, "PORTION", 4000)
    assert sorted(str(tuple(r)) for r in wordrepeat.word_report(docs(spark, rows).repartition(2)).collect()) == brute_words(rows)
    assert wordrepeat.word_report(docs(spark, [])).count() == 0
    assert wordrepeat.word_report(docs(spark, ODD)).count() == len(ODD)


def brute_bytes(rows, n=100):
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for none, k, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            g = b[i : i + n]
            if g in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(g)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[None if none else k, t] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(str((r[0], *out[r[0], r[1] or ""])) for r in rows)


def test_bytes(spark, monkeypatch):
    rows = prose(22, 150, 100) + [r for r in ODD if r[0] != 5] + [(900, "a" * 3000, None, None, 0), (901, "ab" * 700 + "é" * 300, None, None, 0), (902, "x" * 99, None, None, 0), (903, "y" * 100, None, None, 0), (904, "y" * 101, None, None, 0)]
    rows = [(r[0] if r[0] is None or k >= 150 else 5000 - r[0], *r[1:]) for k, r in enumerate(rows)]
    random.Random(2).shuffle(rows)
    want = brute_bytes(rows)
    got = suffixmerge.byte_report(docs(spark, rows).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    monkeypatch.setattr(suffixmerge, "SHARD", 500)
    monkeypatch.setattr(suffixmerge, "MERGE", 3000)
    monkeypatch.setattr(suffixmerge, "PART", 2000)
    got = suffixmerge.byte_report(docs(spark, rows).repartition(2)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert suffixmerge.byte_report(docs(spark, [])).count() == 0


def test_merged_classes():
    rng = random.Random(3)
    for shard in (50, 1000, 1 << 15):
        suffixmerge.SHARD, old = shard, suffixmerge.SHARD
        strings = ["".join(rng.choice("ab") for _ in range(3)).encode() * rng.randint(30, 60) for _ in range(30)]
        begins, cls = suffixmerge.merged_classes(strings)
        seen: dict = {}
        for b, s in zip(begins, strings, strict=True):
            for i in range(len(s) - 99):
                assert seen.setdefault(s[i : i + 100], cls[b + i]) == cls[b + i]
        assert len(set(seen.values())) == len(seen)
        suffixmerge.SHARD = old
