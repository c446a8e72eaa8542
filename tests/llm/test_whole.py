"""Operators do the whole job: cases that a bound or a default once left out."""

import random

from helpers import ODD, docs, prose
from test_repeats import brute_bytes

import corpus_pipeline
from paceline.llm import docprint, suffixmerge


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_of_every_similarity(spark, tmp_path):
    rng, rows = random.Random(31), [(i, t, *r) for i, t, *r in prose(32, 60, 200)]
    for base in range(30):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 300))]
        rows.append((1000 + 10 * base, " ".join(w), "en", "a", 0))
        for k in range(1, 4):
            v = list(w)
            for _ in range(max(1, len(w) * rng.randint(0, 4) // 100)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(1000)}"
            rows.append((1000 + 10 * base + k, " ".join(v), "en", "a", 0))
    rng.shuffle(rows)
    sets = [_sets(r[1]) for r in rows]
    group, near = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                near += a != sets[j]
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    assert near > 30 and len(least) < len(rows) - 30
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows).repartition(3), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(least.values())
    odd = corpus_pipeline.drop_near_duplicates(spark, docs(spark, ODD), str(tmp_path)).collect()
    assert {r.doc_id for r in odd} == {1, 4, 5, 6, None}


def test_copies_of_a_row_are_dealt_apart(spark):
    rows = [(i, f"text {i}", "en", "a", 0) for i in range(1500) for _ in range(2)]
    got = corpus_pipeline.assign_shards(spark, docs(spark, rows).repartition(3), "").collect()
    assert len(got) == 3000 and len({(r.shard, r.slot) for r in got}) == 3000
    at = {}
    for r in got:
        at.setdefault(r.doc_id, []).append((r.shard, r.slot))
    same = [abs(a[1] - b[1]) for a, b in at.values() if a[0] == b[0]]
    # one pair in 40, of 1,500, within five standard deviations
    assert 8 <= len(same) <= 68
    assert sum(x == 1 for x in same) <= 10


def test_repeated_rows_with_partly_shared_passages(spark):
    rng, rows = random.Random(41), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(8)]
    for i in range(40):
        parts = []
        for p in rng.sample(passages, 3):
            a = rng.randrange(len(p) // 2)
            parts += [" ".join(word() for _ in range(rng.randint(5, 40))), p[a : a + rng.randint(120, 300)]]
        rows += [(i, " ".join(parts), "en", "a", 0)] * rng.choice([1, 2, 3])
    want = brute_bytes(rows)
    for order in (rows, rows[::-1]):
        for parts in (1, 3):
            got = suffixmerge.byte_report(docs(spark, order).repartition(parts)).collect()
            assert sorted(str(tuple(r)) for r in got) == want


def test_fingerprints_of_many_repeats_do_not_wrap():
    often, none = docprint.vectors(["a b c d " * 65536]), docprint.vectors([""])
    assert docprint.likeness(often, none)[0] == 0.0
    more = docprint.vectors(["a b c d " * 40000])
    assert docprint.likeness(more, docprint.vectors(["a b c d " * 39000]))[0] > 0.9


def test_secret_models_find_random_strings_and_leave_identifiers(spark):
    from paceline.llm import secretscan

    rng = random.Random(71)
    rows = [(i, f"{t} token={''.join(rng.choice('abcdef0123456789') for _ in range(30))}", *r) for i, t, *r in prose(72, 200)]
    ratio = secretscan.train(docs(spark, rows))
    words = [w for r in prose(73, 40) for w in r[1].split()]
    styles = (lambda w: "".join(x.title() for x in w), lambda w: "_".join(w), lambda w: "_".join(w).upper(), lambda w: ".".join(w) + "2", lambda w: w[0] + "".join(x.title() for x in w[1:]))
    names = [x for x in (styles[k % 5]([rng.choice(words) for _ in range(4)]) for k in range(2000)) if len(x) >= 16]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    found = lambda x: any(k == 3 for _, k, _ in secretscan.spans(f"see {x} here", ratio))
    assert sum(map(found, names)) <= 0.01 * len(names)
    for alphabet in (letters, letters + "0123456789", letters + "0123456789+/"):
        strings = ["".join(rng.choice(alphabet) for _ in range(24)) for _ in range(500)]
        assert sum(map(found, strings)) >= 0.95 * len(strings), alphabet
    assert not any(map(found, ("2024-05-17T12.33.10", "1234567890123456", "192.168.100.200/8080")))


def test_windows_whose_first_hash_collides_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import zstandard

    from paceline.llm import exchange, wordrepeat

    rng = random.Random(81)
    word = lambda: rng.choice("abcdefgh")
    passage = [word() for _ in range(35)]
    texts = [" ".join([word() for _ in range(40)] + passage[: 20 + k] + [word() for _ in range(30)]).encode() for k in range(12)]
    real = wordrepeat._words

    def collide(t, digest, width):
        h, sizes = real(t, digest, width)
        h = h.copy()
        h[::2] = 0
        return h, sizes

    monkeypatch.setattr(wordrepeat, "_words", collide)
    monkeypatch.setattr(exchange, "chunk_name", lambda k: f"0-{k}")
    every = [exchange.squeeze(np.arange(len(t.split()), dtype=np.uint32)) for t in texts]
    batch = pa.RecordBatch.from_pydict({"none": [False] * 12, "k": list(range(12)), "th": list(range(12)), "z": [zstandard.compress(t) for t in texts], "found": every})
    sent = list(wordrepeat._extend(3)(iter([batch])))
    assert len({b for r in sent for b, h in zip(r.column("bucket").to_pylist(), r.column("h").to_pylist(), strict=True) if h}) == 1
    begins = np.cumsum([0, *(len(t.split()) for t in texts)])
    got = {(int(np.searchsorted(begins, p, "right")) - 1, int(p)) for r in wordrepeat._later(iter(sent)) for x in r.column("p").to_pylist() if x for p in exchange.unsqueeze(x, np.uint32)}
    seen, want = set(), set()
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                want.add((k, int(begins[k]) + i))
            seen.add(tuple(w[i : i + 20]))
    assert want and got == want


def test_small_shards_and_merges_give_the_same(monkeypatch):
    import numpy as np

    from paceline.llm import suffixmerge

    rng = random.Random(91)
    parts = ["".join(rng.choice("abc") for _ in range(130)) for _ in range(6)]
    texts = ["".join(rng.choice([*parts, "".join(rng.choice("abc") for _ in range(50))]) for _ in range(4)).encode() for _ in range(25)]
    count = np.array([len(t) - 99 for t in texts])
    n = len(texts)
    args = (np.zeros(n, bool), np.arange(n), np.arange(n), np.zeros(n, np.int64))
    seen, want = set(), set()
    for k, t in enumerate(texts):
        for i in range(count[k]):
            if t[i : i + 100] in seen:
                want.add((k, i))
            seen.add(t[i : i + 100])
    for shard, merge in ((1 << 15, 1 << 17), (300, 900)):
        monkeypatch.setattr(suffixmerge, "SHARD", shard)
        monkeypatch.setattr(suffixmerge, "MERGE", merge)
        who, off, m = suffixmerge._repeats(texts, np.zeros(n, np.uint64), count, *args)
        got = {(int(w), int(o) + j) for w, o, x in zip(who, off, m, strict=True) for j in range(x)}
        assert want and got == want
