"""Near-duplicates, decontamination, line dedup and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import xxhash
from helpers import ODD, SCHEMA, docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import leakage, linedup, simhash
from paceline.llm.components import components


def _fp(text, n=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + n]).encode(), 42).intdigest() for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    names = list(dict.fromkeys(fps))
    root = {f: f for f in names}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(names):
        for b in names[:i]:
            if bin(a ^ b).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in names}


def _check_groups(rows, got):
    fps = [_fp(r[1]) for r in rows]
    comp, least = _components(fps), {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[comp[f]] = min(least.get(comp[f], r[0]), r[0])
    want = sorted(str((r[0], f"{f:016x}", least.get(comp[f]))) for r, f in zip(rows, fps, strict=True))
    assert sorted(str(tuple(g)) for g in got) == want


def test_simhash(spark):
    rows = prose(11, 250) + ODD
    _check_groups(rows, simhash.near_duplicate_report(docs(spark, rows)).collect())
    assert simhash.near_duplicate_report(docs(spark, [])).count() == 0


def test_links_hot_and_small(spark, monkeypatch):
    rng, fps = random.Random(2), {0}
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            f = c
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    want = _components(sorted(fps))
    for bucket in (128, 4, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        got = {np.int64(r.node).astype(np.uint64).item(): np.int64(r.root).astype(np.uint64).item() for r in components(simhash.links(table)).collect()}
        groups: dict = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        theirs: dict = {}
        for f, r in want.items():
            theirs.setdefault(r, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values())), bucket


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    e = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    got = components(e).collect()
    assert len(got) == n - 1 and {r.root for r in got} == {0}


def _duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(map(str, con.sql(sql).fetchall()))


def test_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        lines = [f"line {rng.randrange(30)}" for _ in range(rng.randint(0, 12) if i % 4 else rng.randint(0, 2))]
        if i % 5 == 0:
            lines[2:2] = ["a", "b", "c", "d"]
        if i % 3 == 0:
            lines[rng.randrange(len(lines) + 1) : 0] = ["é" * rng.choice([20, 39, 40, 60]) for _ in range(rng.randint(1, 2))]
        rows.append((i, "\n".join(lines), "en", "a", 0))
    rows += [(500, None, None, None, 0), (501, "", None, None, 0), (502, "x\n" * 10_000, None, None, 0), (503, "\n\n\n\n\n", None, None, 0), (504, "\n\n\n\n", None, None, 0)]
    d = docs(spark, rows).repartition(3)
    got = linedup.line_report(d).collect()
    assert sorted(str(tuple(r)) for r in got) == _duck(linedup.LINES_SQL, documents=d)
    removed = {r.doc_id: (r.n_lines, r.n_removed) for r in got}
    assert removed[502] == (10_001, 9_999) and removed[503][1] == removed[504][1] == 0
    assert linedup.line_report(docs(spark, ODD)).count() == len(ODD)
    assert linedup.line_report(docs(spark, [])).count() == 0


def test_single_long_lines_and_short_documents(spark):
    long, short = "This line has more than sixty characters, so it is a run of its own.", "two\nlines"
    rows = [(1, f"a\n{long}\nb", None, None, 0), (2, f"c\n{long}\nd", None, None, 0), (3, short, None, None, 0), (4, short, None, None, 0), (5, "x\ntwo\nlines\ny", None, None, 0)]
    d = docs(spark, rows).withColumns({"n_removed": F.lit("old"), "__drop": F.lit(1), "__th": F.lit(2)})
    got = {r.doc_id: (r.text, r.n_removed, r["__drop"], r["__th"]) for r in linedup.remove_repeated_lines(d).collect()}
    assert got == {1: (rows[0][1], 0, 1, 2), 2: ("c\nd", 1, 1, 2), 3: (short, 0, 1, 2), 4: ("", 2, 1, 2), 5: (rows[4][1], 0, 1, 2)}


def test_winnowing_selects_equal_lines_of_equal_runs_only(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(f"{rng.getrandbits(40)}" for _ in range(50)), None, None, 0) for i in range(40)]
    assert linedup.shared_fingerprints(linedup._runs(docs(spark, rows))).count() == 0
    passage = "\n".join(rows[0][1].split("\n")[10:20])
    rows.append((99, "head\n" + passage + "\ntail", None, None, 0))
    assert 1 <= linedup.shared_fingerprints(linedup._runs(docs(spark, rows))).count() <= 8
    got = {r.doc_id: r.text for r in linedup.remove_repeated_lines(docs(spark, rows)).collect()}
    assert got[99] == "head\ntail" and got[0] == rows[0][1]


def test_leakage(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "c", "d", "épée", "f1", "g", "h"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, ""), (52, "!!"), (3, "repeated id here"), (53, "absent words only zz")]
    rows = []
    for i in range(120):
        w = [rng.choice(["x", "y", "z", word()]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            part = (rng.choice(items[4:12])[1]).split()
            w[rng.randrange(len(w) + 1) : 0] = part[rng.randrange(2) :]
        rows.append((i, ", ".join(w).upper() if i % 4 == 0 else " ".join(w), "en", "a", 0))
    rows += [r for r in ODD if r[0] != 4]
    d, b = docs(spark, [(r[0] if k >= 120 or r[0] is None else r[0] + 100, *r[1:]) for k, r in enumerate(rows)]), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str(tuple(r)) for r in leakage.leakage_report(d, b).collect()) == _duck(leakage.LEAKAGE_SQL, documents=d, benchmark=b)
    dirty = {r.doc_id for r in leakage.leakage_report(d, b).collect() if r.contaminated}
    kept = [r.doc_id for r in leakage.decontaminate(d, b).collect()]
    assert sorted(map(str, kept)) == sorted(str(r.doc_id) for r in d.collect() if r.doc_id not in dirty)
    none = b.filter("item_id > 1000")
    assert not any(r.contaminated for r in leakage.leakage_report(d, none).collect())
    assert leakage.leakage_report(docs(spark, []), b).count() == 0
    near = leakage.Index(docs(spark, [(1, "alpha one two three Beta", None, None, 0), (2, "alpha" + " q" * 40 + " beta", None, None, 0)]), spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")).proximity(5)
    assert [(r.k, r.n_near) for r in near.collect()] == [(1, 1)]


def test_pipeline(spark, tmp_path):
    rows = [(i, t, lang, s, n) for i, t, lang, s, n in prose(12, 300)]
    rows += [(1000, None, None, None, 0), (1001, "12 34 !!", None, "s1", 0), (1002, rows[5][1], "en", "s0", 0)]
    quoted = "never seen before this passage of twelve entirely fresh test words is"
    rows.append((1003, rows[8][1] + " " + quoted, rows[8][2], "s2", 0))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, quoted)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, columns = docs(spark, rows), SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        assert d.columns == columns
        d = stage(spark, d, str(tmp_path))
        d = spark.createDataFrame(d.collect(), d.schema)
        kept.append([r.doc_id for r in d.collect()])
    assert not {1000, 1001} & set(kept[0]) and len(kept[0]) >= 0.99 * (len(rows) - 2)
    assert 1002 not in kept[1] and len(set(kept[1])) == len(kept[1])
    assert set(kept[1]) - set(kept[2]) == {1003}
    assert set(kept[3]) <= set(kept[2]) and sorted(kept[3]) == sorted(kept[4])
    sizes = [r["count"] for r in d.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in d.collect())


def test_stages_with_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["score", "size", "copies", "target", "component_id", "fp", "key", "shard", "item", "words", "term", "n", "__size", "__key", "__row1", "__h", "__copies", "__rejected", "__copy", "none", "k", "th", "__th", "source_size", "lang_pred"]
    d = spark.createDataFrame([(*r, *range(len(names))) for r in prose(13, 40) + ODD], SCHEMA + "".join(f", {x} long" for x in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert set(d.columns) <= set(out.columns) and (k == 4 or out.columns == d.columns)
        assert out.count() >= 0
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_near_duplicate_stage_keeps_rows_without_an_id_of_their_own(spark, tmp_path):
    rng = random.Random(61)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    rows = [(None, text(), "en", "a", 0) for _ in range(100)]
    rows += [(i, text(), "en", "a", 0) for i in range(20) for _ in range(2)]
    copies = [(r[0], r[1], "de", "b", 1) for r in rows[:10]] + rows[10:15] + [(7000, rows[120][1] + " more", "en", "a", 0)]
    every = rows + copies + [(None, None, None, None, None), (None, "", None, None, None), (None, None, None, None, None)]
    d = docs(spark, every).repartition(3)
    got = sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect())))
    assert len(got) == 141 and len({eval(x)[1] or "" for x in got}) == 141
    assert not [x for x in got if "7000" in x]
    again = corpus_pipeline.drop_near_duplicates(spark, docs(spark, every[::-1]).repartition(5), str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, again))) == got
