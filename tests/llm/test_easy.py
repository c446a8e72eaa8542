"""Mixing, secret scan, sharding, fingerprints and language identification against brute force."""

import hashlib
import re
import zlib

import numpy as np
from helpers import ODD, docs, prose

from pyspark.sql import functions as F

from paceline.llm import docprint, langid, mixture, secretscan, shards


def test_shares_fill_and_stop():
    t = mixture.shares([100, 10, 1000], [5.0, 2.0, 1.0])
    assert t[0] == 300 and t[1] == 30 and abs(sum(t) - 1110) < 1e-9
    assert mixture.shares([0, 5], [5.0, 2.0]) == [0.0, 5.0]
    assert mixture.shares([], []) == []


def test_multipliers_are_the_optimum_of_the_dual(spark):
    rng = np.random.default_rng(3)
    sizes = {f"s{k}": rng.integers(1, 10 ** (k + 1), 50 + 40 * k) for k in range(4)}
    targets = {k: float(v.sum()) * f for (k, v), f in zip(sizes.items(), (0.01, 0.9, 2.4, 3.0), strict=True)}
    rows = [(k, int(s), 1) for k, v in sizes.items() for s in v] + [("s1", 0, 5)]
    table = spark.createDataFrame(rows, "key string, size long, n long").groupBy("key", "size").agg(F.sum("n").alias("n"))
    x = mixture.multipliers(table, targets)
    for k, v in sizes.items():
        rates = np.minimum(3, np.exp(x[k] * v))
        assert abs((rates * v).sum() - targets[k]) <= 1e-9 * targets[k]
        # no other rates that meet the constraint are nearer to 1: moving words between two documents costs entropy
        cost = lambda r: (r * np.log(np.maximum(r, 1e-300)) - r + 1).sum()
        for _ in range(200):
            i, j = rng.integers(0, len(v), 2)
            other = rates.copy()
            move = 0.01 * min(rates[i], rates[j])
            other[i] += move / v[i]
            other[j] -= move / v[j]
            if i != j and other.max() <= 3 and other.min() >= 0:
                assert cost(other) >= cost(rates) - 1e-9


def test_mixture(spark):
    rows = prose(1, 200) + ODD
    got = mixture.mixture_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {}
    for r in rows:
        source.setdefault(r[3], []).append(size(r[1]))
    taken, target = {}, {}
    for r in got:
        assert r.taken <= 3 * r.size
    by_id = {r.doc_id: r for r in got}
    for r in rows:
        if r[0] is not None and r[0] != 4:
            g = by_id[r[0]]
            if [x[0] for x in rows].count(r[0]) == 1:
                assert g.size == size(r[1])
            assert sum(source[r[3]]) in (g.source_size, by_id[r[0]].source_size) or [x[0] for x in rows].count(r[0]) > 1
    for r in got:
        taken[r.target, r.source_size] = taken.get((r.target, r.source_size), 0) + r.taken
        target[r.target, r.source_size] = r.target
    for k in taken:
        assert abs(taken[k] - target[k]) <= 140
    assert sorted(map(str, got)) == sorted(map(str, mixture.mixture_report(docs(spark, rows[::-1])).collect()))
    assert mixture.mixture_report(docs(spark, [])).count() == 0


def test_mixture_sql(spark, tmp_path):
    import duckdb

    rows = prose(2, 150) + ODD + [(None, f"no id {'x ' * (i % 7)}", None, "s0", 0) for i in range(40)]
    path = str(tmp_path / "d.parquet")
    docs(spark, rows).write.parquet(path)
    want = duckdb.sql(mixture.MIXTURE_SQL.format(docs=f"'{path}/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, mixture.mixture_report(docs(spark, rows)).collect()))) == sorted(map(str, want))


def test_secret_spans(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = ["password = 'abcdefghijklmnop' x", "PassWd:short token=abcdef123456", key + " " + "0123456789abcdef0", "api_key: secret:abcdefghijklmnop", "ſecret=abcdefghijklmnop", None, "", "p" * 50_000, "AKIA1234"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + prose(3, 40)

    def brute(text):
        out = []
        for k, rx, least, g in ((0, r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), (1, "AKIA[A-Z0-9]+", 18, 0), (2, "[0-9a-f]+", 16, 0)):
            out += [(m.start(), k, m.end()) for m in re.finditer(rx, text or "") if len(m[g]) >= least]
        return sorted(out)

    got = sorted(secretscan.scan(docs(spark, rows)).collect(), key=str)
    assert len(got) == len(rows)
    texts = sorted((r[0], r[1]) for r in rows if r[1] is not None)
    for r in got:
        if r.doc_id >= len(prose(3, 40)) or [x[0] for x in rows].count(r.doc_id) > 1:
            continue
        want = brute(dict(texts).get(r.doc_id))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[1] for x in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(secretscan.shown(want).encode()).hexdigest()
        assert {x for x in secretscan.shown(want).split(",") if x} <= set(r.spans.split(","))
    for t in [x for _, x in texts]:
        assert secretscan.base_spans(t) == brute(t)
    assert secretscan.scan(docs(spark, [])).count() == 0


def test_secret_models_add_random_strings(spark):
    import random

    rng = random.Random(4)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rnd = lambda n: "".join(rng.choice(b62) for _ in range(n))
    rows = [(i, f"{r[1]} token={rnd(30)}", "en", "a", 0) for i, r in enumerate(prose(5, 150))]
    rows += [(1000, f"see {rnd(32)} here", "en", "a", 0), (1001, "thereonanotherwordoftheline and more", "en", "a", 0)]
    got = {r.doc_id: r for r in secretscan.scan(docs(spark, rows)).collect()}
    assert got[1000].spans == "markov:4:36" and got[1001].spans == ""


def test_hypergeometric_is_exact():
    import random

    rng, n = random.Random(1), 20_000
    x = np.array([shards.hypergeometric(rng, 30, 50, 20) for _ in range(n)])
    assert abs(x.mean() - 20 * 30 / 80) < 0.05 and abs(x.var() - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.12
    m = shards.communication([5, 0, 17, 100], 7, 3)
    assert [sum(r) for r in m] == [5, 0, 17, 100] and sorted(map(sum, zip(*m, strict=True))) == [17, 17, 17, 17, 18, 18, 18]


def test_shards(spark):
    rows = prose(6, 333) + ODD
    got = shards.shard_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, shards.shard_report(docs(spark, rows[::-1]).repartition(3)).collect()))
    assert shards.shard_report(docs(spark, [])).count() == 0


def test_the_deal_is_uniform(spark):
    n, shards_, per = 24_000, 8, 500
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("__h"), F.lit("x").alias("shard"))
    got = shards.shard(d, [F.col("doc_id")], shards_, per_part=per).collect()
    assert {r["__h"] for r in got} == {1} and sorted(r.doc_id for r in got) == list(range(n))
    table = np.zeros((12, shards_))
    for r in got:
        table[r.doc_id * 12 // n, r.shard] += 1
    # chi-square with 77 degrees of freedom: mean 77, deviation 12.4
    assert 35 < ((table - n / 96) ** 2 / (n / 96)).sum() < 130 and (table.sum(axis=0) == n / shards_).all()
    order = np.array([r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))], float)
    for lag in (1, 2, 7):
        assert abs(np.corrcoef(order[:-lag], order[lag:])[0, 1]) < 0.03
    slots = np.array([(r.doc_id, r.slot) for r in got], float)
    assert abs(np.corrcoef(slots.T)[0, 1]) < 0.03


def test_fingerprints(spark):
    a, b = "one two three\nfour five six seven eight", "nine ten"
    assert (docprint.vectors([a + "\n" + b]) == docprint.vectors([b + "\n" + a])).all()
    f = docprint.pack(docprint.vectors([a])[0])
    assert docprint.delete(docprint.insert(f, b), b) == f
    rows = prose(7, 120) + ODD + [(None, f"text {i}", None, None, 0) for i in range(60)] + [(77, f"text {i} again", None, None, 0) for i in range(80)]
    table = docs(spark, rows).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = sorted((r.doc_id is None, r.doc_id or 0, r.th, r.text or "") for r in table.collect())
    want = []
    for i, (none, k, _, t) in enumerate(order):
        u = order[(i + 1) % len(order)][3]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        va, vb, vc = (docprint.vectors([x]) for x in (t, e, u))
        want.append((None if none else k, len(t), hashlib.sha256(e.encode()).hexdigest(), docprint.pack(va[0]), docprint.pack(vb[0]), float(docprint.likeness(va, vb)[0]), float(docprint.likeness(va, vc)[0])))
    for n in (None, 1, 9):
        got = docprint.neighbours(docs(spark, rows), n).mapInArrow(docprint._compare, docprint.compare_edits(docs(spark, [])).schema).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)), n
    assert docprint.compare_edits(docs(spark, [])).count() == 0
    one = docprint.compare_edits(docs(spark, [(9, "abcd ef", None, None, 7)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # rows without an id, or with one id, are not all in one partition
    spread = docprint.neighbours(docs(spark, rows), 9).filter("not tail").groupBy("bucket", "doc_id").count().collect()
    assert sum(r.doc_id is None for r in spread) >= 3 and sum(r.doc_id == 77 for r in spread) >= 3


def test_likeness_is_the_share_of_common_pieces():
    """Against the sets themselves, counted by hand: pieces of four words."""
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**6)}"
    apart = []
    for _ in range(60):
        a = [[word() for _ in range(4)] for _ in range(200)]
        share = rng.random()
        b = [p if rng.random() < share else [word() for _ in range(4)] for p in a]
        texts = ["\n".join(" ".join(p) for p in x) for x in (a, b)]
        true = sum(p == q for p, q in zip(a, b, strict=True)) / 200
        v = docprint.vectors(texts)
        apart.append(float(docprint.likeness(v[:1], v[1:])[0]) - true)
    # 128 lanes: a deviation of about sqrt(2 / 128) of what is not shared
    assert abs(np.mean(apart)) < 0.03 and np.std(apart) < 0.1


def test_language(spark):
    rows = prose(8, 400) + [(9000, None, None, None, 0), (9001, "12 34", "en", "a", 5), (9002, "", "en", "a", 0)]
    got = {r.doc_id: r for r in langid.language_report(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert {got[i].lang_pred for i in (9000, 9001, 9002)} == {"und"}
    test = [r for r in rows if r[0] < 9000 and got[r[0]].held_out and len(r[1]) > 40]
    assert sum(got[r[0]].lang_pred == r[2] for r in test) >= 0.97 * len(test)
    assert sum(got[r[0]].rejected for r in test) <= 0.03 * len(test)
    odd = docs(spark, [(8001, "½ ² ① Ⅷ", None, None, 0), (8002, "😀", None, None, 0), (8003, "𠀀", None, None, 0), (8004, "ª", None, None, 0), (None, "the " * 200_000, "en", None, 0)] + rows[:60])
    found = {r.doc_id: r.lang_pred for r in langid.language_report(odd).collect()}
    assert found[8001] == found[8002] == "und" and found[8003] != "und" and found[8004] != "und" and found[None] in ("en", "de")
    none = langid.language_report(docs(spark, [(i, t, None, s, n) for i, t, _, s, n in rows[:20]])).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, False)}
    assert langid.language_report(docs(spark, [])).count() == 0


def test_language_probabilities_sum_to_one(spark):
    rows = [(i, t, "en", s, n) for i, t, _, s, n in prose(9, 60)]
    m = langid.fit(docs(spark, rows))
    assert m.bits == 20 and set(m.limit) == {"en"}
    many = langid.fit(docs(spark, [(i, t, f"l{i % 23}", s, n) for i, t, _, s, n in rows + [(r[0] + 100, *r[1:]) for r in rows]]))
    assert many.bits == 17 and len(many.langs) == 23 and max(len(x[0]) for v in many.tables.values() for x in v) <= 1 << 17
    every = np.arange(0, 0x250, dtype=np.int64)
    for context in ("the", "\x01\x01\x01", "qqq"):
        c = [ord(x) for x in context]
        total = np.exp(m.log_p("en", every | (c[2] << 16) | (c[1] << 32) | (c[0] << 48))).sum()
        assert 0.9 < total < 1.2
