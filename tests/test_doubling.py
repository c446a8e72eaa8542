"""Segmentation by pointer doubling against the fold and the recurrence over ends."""

import random
import re

from test_planner import closed_groups

from paceline.operators import doubling, segment

SCHEMA = "rank int, round long, sample_id long, length long, n_patches long, arrival_idx long"


def test_small_windows_equal_the_fold(spark):
    rng = random.Random(4)
    rows = [(k % 3, k, i, rng.choice([None, 0, rng.randint(1, 60)]) if k == 5 else rng.randint(1, 300), i % 4, i) for k in range(12) for i in range(1 if k < 2 else rng.randint(2, 120))]
    df = spark.createDataFrame(rows, SCHEMA)
    for per_range in (50, 10**6):
        got = doubling.greedy_groups(df, 500, per_range=per_range)
        want = segment.greedy_groups(df, 500)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert doubling.greedy_groups(df.limit(0), 500).count() == 0


def test_a_window_of_100_000(spark):
    rng = random.Random(5)
    lengths = [int(rng.paretovariate(1.1) * 20) for _ in range(100_000)]
    df = spark.createDataFrame([(0, 0, i, x, 0, i) for i, x in enumerate(lengths)], SCHEMA)
    got = doubling.greedy_groups(df, 4096, per_range=30_000).groupBy("group_idx").count().collect()
    assert [r["count"] for r in sorted(got)] == closed_groups(lengths, 4096)


def test_places_are_never_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(0, 0, i, 1 + i % 50, 0, i) for i in range(400)], SCHEMA)
    plans, stored = [], doubling.stored
    plan = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d
    monkeypatch.setattr(doubling, "stored", lambda d: stored(plan(d)))
    assert plan(doubling.greedy_groups(df, 100)).count() == 400
    joins = [keys for p in plans for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)]
    assert sum("SortMergeJoin" in p for p in plans) > 4
    assert joins and not [k for k in joins if re.search(r"\b(q|t|end|a_to)#", k)]
