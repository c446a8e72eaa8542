"""The planner against a literal sequential model, hand-derived cases, and invariants."""

import random

import pytest

from paceline.config import PlanConfig, default_window, flip_mode, scaling_mode
from paceline.functions.flips import flips
from paceline.operators import align, emit, planner, progress, segment, windows


def closed_groups(lengths, budget):
    """Sizes, the shortest group first, by the recurrence over the ends of groups of a window sorted downwards: the first
    group is the longest sample, and each next one holds as many as fit beside the last sample of the one before."""
    down = sorted(lengths, reverse=True)
    ends = [1] if down else []
    while ends and ends[-1] < len(down):
        ends.append(min(len(down), ends[-1] + max(budget // down[ends[-1] - 1], 1)))
    return [b - a for a, b in zip([0, *ends], ends, strict=False)][::-1]


def sizes(lengths, budget, patches=None, cap=0):
    rows = sorted(((n, i, p) for i, (n, p) in enumerate(zip(lengths, patches or [0] * len(lengths), strict=True))), key=lambda x: x[0])
    return [len(g) for g in planner.cut_groups(rows, budget, cap)]


@pytest.mark.parametrize("lengths, budget, want", [([100] * 20, 8192, [19, 1]), ([100, 200, 500, 1000, 2000, 4000, 8000], 8192, [3, 2, 1, 1]), ([4000, 5000, 6000, 7000, 8000], 8192, [1] * 5), ([], 10, [])])
def test_known_groups(lengths, budget, want):
    assert sizes(lengths, budget) == want == closed_groups(lengths, budget)


@pytest.mark.parametrize("lengths, patches, cap, want", [
    ([10, 10, 10, 10, 10], [3, 3, 3, 3, 3], 7, [2, 2, 1]), ([10, 10, 10, 10], [0, 0, 9, 9], 7, [1, 1, 1, 1]), ([5, 6, 7, 8], [1, 1, 1, 1], 2, [1, 2, 1]), ([100], [50], 7, [1])])
def test_known_groups_with_patches(lengths, patches, cap, want):
    assert sizes(lengths, 500, patches, cap) == want


def test_groups_match_the_recurrence_and_the_fold(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(60):
        n = rng.randint(1, 40) if k else 3000
        lengths, patches = [rng.randint(1, 300) for _ in range(n)], [rng.randint(0, 5) for _ in range(n)]
        order = sorted(range(n), key=lambda i: (lengths[i], i))
        lengths_, patches_ = [lengths[i] for i in order], [patches[i] for i in order]
        want[k, 0] = closed_groups(lengths, 500)
        assert sizes(lengths_, 500, patches_) == want[k, 0]
        want[k, 7] = sizes(lengths_, 500, patches_, 7)
        at = 0
        for size in want[k, 7]:
            assert size == 1 or sum(patches_[at : at + size]) <= 7
            at += size
        assert at == n
        rows += [(0, k, i, lengths[i], patches[i], i) for i in range(n)]
    df = spark.createDataFrame(rows, "rank int, round long, sample_id long, length long, n_patches long, arrival_idx long")
    for cap in (0, 7):
        got = {}
        for r in segment.group_table(segment.greedy_groups(df, 500, cap)).collect():
            got.setdefault(r["round"], {})[r.group_idx] = r["size"]
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: want[k, cap] for k in range(60)}


def closed_fit(groups, target):
    """What alignment makes of the groups of one rank: the largest ones, or the same samples in order with as many more
    cuts as are missing, each in front of one of the last samples that begin no group."""
    flat = [s for g in groups for s in g]
    starts = [sum(map(len, groups[:j])) for j in range(len(groups))]
    if len(groups) >= target:
        largest = sorted(range(len(groups)), key=lambda j: (-len(groups[j]), j))[:target]
        return [groups[j] for j in sorted(largest)], [s for j in range(len(groups)) if j not in largest for s in groups[j]]
    inner = [i for i in range(len(flat)) if i not in starts]
    cuts = sorted(starts + inner[len(inner) - (target - len(groups)) :])
    return [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True)], []


def test_fit_groups_matches_the_closed_form():
    rng = random.Random(2)
    for _ in range(500):
        groups = [[(1, rng.random(), 0) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
        target = rng.randint(1, sum(map(len, groups)))
        assert planner.fit_groups([list(g) for g in groups], target) == closed_fit(groups, target)


def whole_plan(rows, config):
    """The status and place of every sample, planned round after round over whole lists."""
    world = config.world_size
    queue = [[(n, i, p) for i, rank, _, n, p in sorted(rows, key=lambda x: x[2]) if rank == r] for r in range(world)]
    place = {s[1]: ("filtered" if s[0] <= 0 else "dropped",) for q in queue for s in q}
    carry, rng, step, k = [[] for _ in range(world)], random.Random(config.seed + config.epoch), 0, 0
    widths = windows.ramp(config.window, config.warmup)
    while any(queue):
        width = widths[k] if k < len(widths) else config.window
        slots = [min(width, len(q)) for q in queue]
        made = []
        for r in range(world):
            here = sorted([s for s in carry[r] + queue[r][: slots[r]] if s[0] > 0], key=lambda s: s[0]) if slots[r] else []
            cuts = [0]
            for n in closed_groups([s[0] for s in here], config.token_budget):
                cuts.append(cuts[-1] + n)
            made.append([here[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
            queue[r] = queue[r][slots[r] :]
        some = [r for r in range(world) if made[r]]
        target = max(1, min([max(len(made[r]) for r in some)] + [x for r in some for x in (slots[r], sum(map(len, made[r])))])) if some else 0
        order = list(range(target))
        if config.order == "seeded":
            rng.shuffle(order)
        for r in range(world):
            if slots[r]:
                clamped, beyond = made[r][: config.window], [s for g in made[r][config.window :] for s in g]
                kept, over = closed_fit(clamped, target) if r in some else ([], [])
                carry[r] = over + beyond
                if flips(config.group_order_flip, config.seed + config.epoch, k, r, world):
                    kept = kept[::-1]
                for pos, i in enumerate(order if kept else []):
                    for s in kept[i]:
                        place[s[1]] = ("emitted", k, pos, step + pos, len(kept[i]))
        step, k = step + target, k + 1
        if not (config.join and world > 1) and not all(slots):
            break
    return place


def test_whole_plans_match_the_sequential_model(spark):
    rng, frames, want = random.Random(11), [], {}
    for job in range(60):
        world, config = rng.randint(1, 4), None
        rows = []
        for r in range(world):
            for i in range(rng.choice([0, 3, 20, 60])):
                rows.append((job * 10_000 + 1000 * r + i, r, i, rng.choice([0, *[rng.randint(1, 400)] * 9]), 0))
        config = PlanConfig(500, rng.choice([4, 16, 25]), world, join=rng.random() < 0.5, warmup=rng.random() < 0.5, group_order_flip=rng.choice([None, "balanced", "b", "c"]), order=rng.choice(["seeded", "index"]))
        if not rows:
            continue
        want[job] = whole_plan(rows, config)
        state = planner._Job(job, config)
        got = []
        for sid, r, i, n, p in sorted(rows, key=lambda x: (_round(x[2], config), x[1], x[2])):
            got += state.add(_round(i, config), r, (n, sid, p))
        got += state.finish()
        seen = {x[1]: (x[7],) if x[7] != "emitted" else ("emitted", x[3], x[4], x[6], x[8]) for x in got}
        assert len(got) == len(seen) and seen == want[job], (job, config)
        if len(frames) < 5:
            df = spark.createDataFrame(rows, "sample_id long, rank int, arrival_idx long, length long, n_patches long")
            frames.append((df, config, want[job]))
    for df, config, expected in frames:
        got = {x.sample_id: (x.status,) if x.status != "emitted" else ("emitted", x["round"], x.pos, x.step, x.group_size) for x in planner.plan(df.repartition(3), config).collect()}
        assert got == expected


def _round(arrival, config):
    ends, k = 0, 0
    for n in windows.ramp(config.window, config.warmup):
        ends += n
        if arrival < ends:
            return k
        k += 1
    return k + (arrival - ends) // config.window


def test_a_gap_in_arrivals_fails(spark):
    df = spark.createDataFrame([(i, 0, i if i < 5 else i + 20, 5, 0) for i in range(9)], "sample_id long, rank int, arrival_idx long, length long, n_patches long")
    with pytest.raises(Exception, match="gap in arrival_idx|no rows in round"):
        planner.plan(df, PlanConfig(50, 8, 1, warmup=False)).collect()


def test_ramp():
    assert windows.ramp(64)[:20] == [1, 3, 6, 9, 12, 16, 19, 22, 25, 28, 31, 35, 38, 41, 44, 48, 51, 54, 57, 60]
    assert windows.ramp(64, False) == []


def test_balanced_flips_half():
    assert sum(flips("balanced", 123, 7, r, 4) for r in range(4)) == 2
    assert not any(flips(None, 1, 2, r, 4) for r in range(4))


def test_modes_and_config():
    assert flip_mode(" Window-Balanced ") == "rank_window_balanced" and scaling_mode(True) == "approx" and scaling_mode(True, False) == "exact"
    assert scaling_mode("token-exact") == "exact" and default_window(None, 4) == 8
    for bad in (lambda: flip_mode("x"), lambda: scaling_mode("x"), lambda: PlanConfig(0), lambda: PlanConfig(5, tail="x")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        progress.max_steps(5, 6, "error")
    assert progress.max_steps(5, 6, "preserve") == 6 and progress.sample_budget(3, 1.5) == 5


def _samples(spark, shares, seed=1, zero=0):
    rng, rows = random.Random(seed), []
    for r, n in enumerate(shares):
        rows += [(1000 * r + i, r, i, 0 if i < zero else int(rng.paretovariate(1.2) * 40) % 4000 + 1, rng.randint(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, rank int, arrival_idx long, length long, n_patches long"), rows


@pytest.mark.parametrize("shares, join, warmup, tail", [((200, 200), True, True, "drop"), ((104, 66), True, False, "drop"), ((104, 66), True, False, "flush"), ((90, 50, 20), False, True, "drop"), ((150,), True, True, "drop")])
def test_plan_invariants(spark, shares, join, warmup, tail):
    df, rows = _samples(spark, shares, zero=2)
    c = PlanConfig(token_budget=2048, window=64, world_size=len(shares), join=join, warmup=warmup, tail=tail, group_order_flip="balanced")
    got = planner.plan(df, c).collect()
    length = {r[0]: r[3] for r in rows}
    assert sorted(r.sample_id for r in got) == sorted(length)
    assert {r.sample_id for r in got if r.status == "filtered"} == {i for i, n in length.items() if n == 0}
    groups, by_step = {}, {}
    for r in got:
        if r.status == "emitted":
            groups.setdefault((r.rank, r.step), []).append(r)
    for (rank, step), g in groups.items():
        assert {r.group_size for r in g} == {len(g)} and {r.group_tokens for r in g} == {sum(length[r.sample_id] for r in g)}
        assert len(g) == 1 or len(g) * max(length[r.sample_id] for r in g) <= 2048
        by_step.setdefault(step, []).append(g)
    for g in by_step.values():
        assert {r.total_size for x in g for r in x} == {sum(map(len, g))}
        assert {r.total_tokens for x in g for r in x} == {sum(x[0].group_tokens for x in g)}
    if len(shares) == 1 or tail == "flush":
        assert not [r for r in got if r.status == "dropped"]
    if len(set(shares)) == 1:
        assert len({sum(1 for k in groups if k[0] == r) for r in range(len(shares))}) == 1
    again = planner.plan(df.repartition(3), c).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_alignment_matches_the_planner(spark):
    df, rows = _samples(spark, (64, 40, 9), seed=3)
    c = PlanConfig(token_budget=2048, window=64, world_size=3, warmup=False, order="index")
    first = {(r, k): g for r, k, _, g, *_ in planner.rounds([[(x[3], x[0], x[4]) for x in rows if x[1] == r] for r in range(3)], c)}
    w = windows.windows(df, 64)
    from pyspark.sql import functions as F

    m = segment.greedy_groups(w, 2048)
    t = align.targets(segment.group_table(m), w.groupBy("round", "rank").agg(F.count(F.lit(1)).alias("slots")))
    got = {}
    for r in align.aligned(m, t).filter("aligned_idx is not null").collect():
        got.setdefault((r.rank, r["round"]), {}).setdefault(r.aligned_idx, set()).add(r.sample_id)
    assert got == {k: {p: {s[1] for s in g} for p, g in v} for k, v in first.items()}


@pytest.mark.parametrize("join, tail", [(True, "drop"), (True, "flush"), (False, "drop")])
def test_the_stream_over_ranks_is_the_batch_plan(spark, tmp_path, join, tail):
    from paceline.streaming.ranks import plan_ranks

    df, rows = _samples(spark, (70, 33, 5, 0), seed=6, zero=2)
    schema = "job long, epoch long, rank int, seq long, sample_id long, length long, n_patches long, error string"
    every = [(0, e, r[1], r[2], r[0], r[3], r[4], None) for r in rows for e in (0, 1)] + [(0, e, r, n, None, None, None, None) for r, n in enumerate((70, 33, 5, 0)) for e in (0, 1)]
    random.Random(7).shuffle(every)
    for k in range(4):
        spark.createDataFrame(every[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = PlanConfig(2048, 16, 4, join=join, tail=tail, group_order_flip="balanced")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = plan_ranks(stream, config).writeStream.format("memory").queryName(f"ranks_{join}_{tail}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.sql(f"select * from ranks_{join}_{tail}").collect()
    slots = windows.windows(df, 16, warmup=True).groupBy("round", "rank").count().collect()
    for epoch in (0, 1):
        import dataclasses

        batch = planner.plan(df, dataclasses.replace(config, epoch=epoch)).collect()
        mine = [r for r in found if r.epoch == epoch]
        got = {(r.rank, r["round"], r.slot, r.step, r.size, r.tokens, r.total_size, r.total_tokens, tuple(sorted(r.sample_ids))) for r in mine if r.kind == "group"}
        want = {}
        for r in batch:
            if r.status == "emitted":
                want.setdefault((r.rank, r["round"], r.slot, r.step, r.group_size, r.group_tokens, r.total_size, r.total_tokens), []).append(r.sample_id)
        assert got == {(*k, tuple(sorted(v))) for k, v in want.items()} and (len(got) > 10 or not join)
        for kind in ("dropped", "flushed"):
            assert sorted(i for r in mine if r.kind == kind for i in r.sample_ids) == sorted(r.sample_id for r in batch if r.status == kind)
        idle = sum(r.kind == "idle" for r in mine)
        emitted_rounds = {r["round"] for r in mine}
        assert idle + len(got) == sum(s["count"] for s in slots if s["round"] in emitted_rounds)


def test_late_and_failed_rows_of_a_stream(spark, tmp_path):
    from paceline.streaming.ranks import Job

    config = PlanConfig(100, 4, 2, warmup=False, order="index")
    job = Job(0, 0, config)
    out = job.add(0, 1, (5, 11, 0), None, "side")
    out += job.add(0, 0, (5, 10, 0), "could not be read", "side") + job.add(0, 1, (5, 11, 0), None, "side")
    assert [(r[2], r[5], r[-1]) for r in out] == [("error", 0, "could not be read"), ("late", 1, None)]
    with pytest.raises(ValueError, match="already come"):
        job.add(0, 0, (5, 10, 0), None, "fail")
    for seq in (2, 3, 4):
        out += job.add(0, seq, (5, 10 + seq, 0), None, "fail")
    assert not [r for r in out if r[2] == "group"]
    more = job.add(0, 5, None, None, "fail") + job.add(1, 0, (7, 100, 0), None, "fail") + job.add(1, 1, None, None, "fail")
    assert sorted(i for r in more for i in r[-2]) == [11, 12, 13, 14, 100] and job.finished


def test_stream_windows_do_not_depend_on_batches(spark, tmp_path):
    from paceline.streaming.plan import plan_stream

    df, rows = _samples(spark, (70, 33), seed=4)
    schema = "rank int, seq long, sample_id long, length long, n_patches long"
    every = [(r[1], r[2], r[0], r[3], r[4]) for r in rows] + [(0, 70, None, 0, 0), (1, 33, None, 0, 0)]
    random.Random(5).shuffle(every)
    for k in range(4):
        spark.createDataFrame(every[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = plan_stream(stream, 16, 2048).writeStream.format("memory").queryName("planned").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.rank, r["round"], r.group_idx): (r["size"], r.tokens) for r in spark.sql("select * from planned").collect()}
    want = {(r.rank, r["round"], r.group_idx): (r["size"], r.tokens) for r in segment.group_table(segment.greedy_groups(windows.windows(df, 16), 2048)).collect()}
    assert got == want


def test_id_log(spark, tmp_path):
    df, _ = _samples(spark, (20, 20))
    p = planner.plan(df, PlanConfig(token_budget=2048, window=8, world_size=2))
    emit.write_id_log(p, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert set(back.columns) == {"step", "ids", "rank"} and back.count() == p.filter("status = 'emitted'").select("rank", "step").distinct().count()


def test_queries_have_oracles():
    import __spark_entry__ as e

    assert "padding_ratio" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_configuration():
    from types import SimpleNamespace

    from paceline.config import from_objects, resolve

    c = resolve(max_input_length=7, no_warmup=True, join_mode=False, workers=3, prefetch=4)
    assert (c.token_budget, c.warmup, c.join, c.window, c.no_sync, c.scales_loss) == (7, False, False, 12, False, False)
    assert resolve(c, token_budget=7, group_order_flip="none") is c and not resolve(token_budget=1, world_size=2, no_sync=True).effective_join
    for error, given in ((TypeError, {}), (TypeError, {"token_budget": 1, "x": 2}), (ValueError, {"token_budget": 1, "max_input_length": 2}), (ValueError, {"token_budget": -1}), (ValueError, {"config": c, "window": 5})):
        with pytest.raises(error):
            resolve(**given)
    a, b = SimpleNamespace(pack_token_budget=None, pack_loss_scaling="exact", join=None), SimpleNamespace(token_budget=9, loss_scaling="none", join=False)
    d = from_objects(a, b, names=("pack_",), window=5)
    assert (d.token_budget, d.loss_scaling, d.join, d.window) == (9, "exact", False, 5)


def test_training_progress():
    from paceline import training as T

    info = T.pop_info({"input_ids": [[1] * 8] * 2, "local_batch_size": [2], "total_batch_size": 8, "local_tokens": 20, "total_tokens": 100}, "auto", 4)
    assert info == T.StepInfo(8, 0.8)
    flat = {"input_ids": [[1]] * 2, "total_batch_size": [[8]], "local_tokens": None}
    assert T.pop_info(dict(flat), "auto", 4) == T.StepInfo(8, 1.0) and T.pop_info(dict(flat), "none", 4).loss_scale == 1.0
    batch = {**flat, "step_info": T.StepInfo(11, 0.5)}
    assert T.pop_info(batch) == T.StepInfo(11, 0.5) and set(batch) == {"input_ids"}
    p = T.TrainingProgress.for_source(100, 1.0, world=4)
    step = T.scaled_step(p, lambda batch: (2.0, len(batch)))
    assert step({"x": [1], "local_tokens": 1, "total_tokens": 2, "total_batch_size": 5}) == (4.0, 1)
    assert step({"x": [1], "total_batch_size": 3}) == (2.0, 1) and p.pop_unscaled_mean() == 2.0 and p.pop_unscaled_mean() is None
    assert (p.optimizer_step(), p.total, p.epoch, p.should_stop) == (7, 8, 0.08, False)
    p.sizes.append(92)
    assert step("no dict") == (2.0, 7) and p.should_stop and p.scaled({"loss": 3.0, "y": 1}) == {"loss": 3.0, "y": 1}
    with T.uneven_inputs(None, []) as x:
        assert x is None
    assert T.enable(10, 1.5, steps=5, existing_max_steps=9)[0].budget == 15 and T.enable(10, 1.5, steps=5, existing_max_steps=9)[1] == 5
    for bad in ({"per_device_batch_size": 2}, {"workers": 0}, {"steps": 5, "existing_max_steps": 9, "policy": "error"}):
        with pytest.raises(ValueError):
            T.enable(10, 1.0, **bad)
    with pytest.raises(ValueError, match="unknown"):
        T.enable(None, 1.0)


def test_consumer(spark, tmp_path, monkeypatch):
    from paceline import consumer

    df, rows = _samples(spark, (40, 30), seed=9)
    p = planner.plan(df, PlanConfig(2048, 16, 2, warmup=False))
    per_round = windows.windows(df, 16).groupBy("round", "rank").count().withColumnRenamed("count", "slots")
    every = consumer.slots(p, per_round)
    assert every.count() == 70
    monkeypatch.setenv(consumer.ID_LOG, str(tmp_path))
    read = [r for rank in (0, 1) for r in consumer.iterate(every, rank)]
    emitted = {r.sample_id for r in p.filter("status = 'emitted'").collect()}
    assert {i for r in read for i in r.ids} == emitted and [(r["round"], r.slot) for r in read if r.rank == 0] == sorted((r["round"], r.slot) for r in read if r.rank == 0)
    assert len((tmp_path / "rank0.jsonl").read_text().splitlines()) == sum(r.rank == 0 for r in read)
    nested = spark.createDataFrame([([],), ([[]],), ([[7, 8]],), (None,)], "x array<array<long>>")
    assert [r[0] for r in nested.select(consumer.first_int(nested, "x", 3)).collect()] == [3, 3, 7, 3]


def test_readiness_and_audit(spark):
    from paceline.sources import samples as S

    raw = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="input_ids"):
        S.ready(raw)
    assert S.ready(raw, declared=True) is raw
    rows = spark.createDataFrame([([{"input_ids": None}],), ([{"input_ids": None}, {"input_ids": [1]}],), (None,)], "x array<struct<input_ids: array<int>>>")
    assert [r[0] for r in S.ready(rows).select(S.has_tokens(rows)).collect()] == [False, True, False]
    code = spark.createDataFrame([(f"f{k % 12:02}.py", "loss.backward()" if k else "nothing") for k in range(40)], "file string, text string")
    hits = {r.rule: (r.hits, r.names) for r in S.rule_audit(code, "text", S.FRAMEWORK_RULES, "file").collect()}
    assert hits["pytorch_loop"] == (39, [f"f{k:02}.py" for k in range(8)]) and hits["accelerate"] == (0, None)


def test_code_audit_reads_a_source_tree(spark, tmp_path):
    from paceline.sources import codeaudit as A

    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "train.py").write_text("from paceline.operators import planner as planner\np = (planner\n  .plan)(rows, c)\nprint(p.toPandas())\n")
    (tmp_path / "deep" / "good.py").write_text("import paceline.operators.planner\nplanner.coverage(planner.plan(r, c)).show()  # collect()\n")
    (tmp_path / "deep" / "er" / "idle.py").write_text("import paceline\ns = 'planner.plan(x)'\n")
    (tmp_path / "deep" / "old.py").write_text("print 'paceline'\n")
    (tmp_path / "deep" / "notes.txt").write_text("planner.plan(x)\n")
    files = A.code_files(spark, str(tmp_path))
    found = A.met(A.code_facts(files))
    got = {}
    for r in found.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], set()).add(r.rule)
    assert got == {"train.py": {"imports", "plans", "brings_home"}, "good.py": {"imports", "plans", "checks_coverage"}, "idle.py": {"imports"}, "old.py": {"not_python"}}
    said = {(r.file.rsplit("/", 1)[1], r.advice) for r in A.advice(found).collect()}
    assert said == {("train.py", A.ADVICE[0][2]), ("train.py", A.ADVICE[1][2]), ("idle.py", A.ADVICE[3][2])}
    assert A.facts_of(None) == set() and A.facts_of("a().b.c(d())") == {("call", "a"), ("call", "b.c"), ("call", "d")}


def test_blocks_do_not_change_running_sums_or_arrivals(spark):
    from pyspark.sql import functions as F

    from paceline.sources import samples as S

    d = spark.range(300).select((F.col("id") % 3).alias("job"), F.floor(F.col("id") / 3).alias("step"), (F.col("id") % 7).alias("samples"))
    for block in (1, 7, 1000):
        got = {(r.job, r.step): r.total for r in progress.running_total(d, F.col("samples"), "total", block=block).collect()}
        assert got == {(j, s): sum((3 * t + j) % 7 for t in range(s + 1)) for j in range(3) for s in range(100)}
    for per in (7, 50, 10_000):
        got = S.arrivals(spark.range(300), F.col("id") % 2, "id", per)
        assert {(r.id, r.rank, r.arrival_idx) for r in got.collect()} == {(i, i % 2, i // 2) for i in range(300)}


def test_numbers_in_order(spark):
    from pyspark.sql import functions as F

    from paceline.operators.order import numbered

    rows = [(i % 3 if i % 5 else None, i * 7 % 40) for i in range(300)] + [(1, 5)] * 100
    df = spark.createDataFrame(rows, "g int, k int").repartition(5)
    for per_range in (7, 1000):
        one = sorted((r.k, r.n) for r in numbered(df, [F.desc("k")], "n", per_range=per_range).collect())
        assert sorted(n for _, n in one) == list(range(400)) and [k for k, n in sorted(one, key=lambda x: x[1])] == sorted((k for _, k in rows), reverse=True)
        got = numbered(df, [F.col("k")], "n", ("g",), per_range)
        assert got.columns == ["g", "k", "n"]
        for g in (0, 1, 2, None):
            mine = sorted((r.n, r.k) for r in got.collect() if r.g == g)
            assert [n for n, _ in mine] == list(range(sum(x == g for x, _ in rows))) and [k for _, k in mine] == sorted(k for x, k in rows if x == g)


@pytest.mark.parametrize("join, tail, order, zero", [(True, "drop", "seeded", 0), (True, "flush", "seeded", 9), (False, "drop", "seeded", 3), (True, "drop", "index", 40)])
def test_plans_in_pieces_are_plans_in_one(spark, join, tail, order, zero):
    from pyspark.sql import functions as F

    rng, rows = random.Random(17), []
    for job, shares in enumerate([(400, 380, 90), (150, 149, 151), (33, 0, 70), (64, 64, 64)]):
        for r, n in enumerate(shares):
            rows += [(job, job * 10_000 + r * 1000 + i, r, i, 0 if rng.random() * 100 < zero else int(rng.paretovariate(1.1) * 40) % 3000 + 1, rng.randint(0, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "j long, sample_id long, rank int, arrival_idx long, length long, n_patches long").repartition(4)
    c = PlanConfig(2048, 8, 3, join=join, tail=tail, order=order, group_order_flip="balanced", max_patches=5)
    want = sorted(map(str, planner.plan(df, c, "j").collect()))
    for block, reach in ((3, 1), (64, 8)):
        got = planner.plan(df, c, "j", alone=0, block=block, reach=reach)
        assert got.columns == [x.split()[0] for x in planner.SCHEMA.split(", ")]
        assert sorted(map(str, got.collect())) == want
    assert len(want) == len(rows)


def test_one_job_is_planned_by_several_tasks(spark):
    from pyspark.sql import functions as F

    df, _ = _samples(spark, (300, 200), seed=12)
    d = df.select(F.lit(0).cast("long").alias("job"), windows.round_of(F.col("arrival_idx"), 8).alias("round"), "*", F.when(F.col("rank") == 0, 37).otherwise(24).cast("long").alias("last"))
    c = PlanConfig(2048, 8, 2, warmup=False)
    pieces = planner.restart_pieces(d, c, 4, 2)
    assert pieces.select("piece").distinct().count() > 4 and pieces.count() == 38
    done = planner._in_pieces(d, pieces, c).withColumn("part", F.spark_partition_id()).filter("status = 'emitted'")
    assert done.select("part").distinct().count() > 1
    with pytest.raises(ValueError, match="gap"):
        planner.plan(df.filter("arrival_idx != 20"), c, alone=0)


ROWS = "job long, epoch long, rank int, seq long, sample_id long, length long, n_patches long, error string"


def _stream(spark, tmp_path, parts, config, name, **more):
    """Rows of a stream, each part a batch, planned to the end; with the state that is left."""
    from paceline.streaming.ranks import plan_ranks

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    out = plan_ranks(source, config, **more).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "log"))
    return out


def test_state_of_a_finished_epoch_goes(spark, tmp_path):
    config = PlanConfig(500, 4, 2, warmup=False)
    row = lambda e, r, q: (0, e, r, q, 1000 * e + 100 * r + q, 50 + q, 0, None)
    end = lambda e, r, q: (0, e, r, q, None, None, None, None)
    every = [row(e, r, q) for e in (0, 1) for r in (0, 1) for q in range(10)] + [end(0, 0, 10), end(0, 1, 10)]
    late = [row(0, 1, 3), end(0, 0, 10)]
    _stream(spark, tmp_path, [every, late], config, "gone", late="side").trigger(availableNow=True).start().awaitTermination()
    found = spark.sql("select * from gone").collect()
    first = [r for r in found if r.epoch == 0]
    assert sorted(i for r in first if r.kind in ("group", "dropped") for i in r.sample_ids) == [100 * r + q for r in (0, 1) for q in range(10)]
    assert sorted((r.rank, r.slot) for r in first if r.kind == "late") == [(0, 10), (1, 3)]
    kept = lambda name: {(r.key.epoch) for r in spark.read.format("statestore").option("path", str(tmp_path / "log")).option("stateVarName", name).load().collect()}
    assert kept("counters") == {1} and kept("order") == {1} and kept("done") == {0}


def test_a_lost_number_is_passed_after_a_while(spark, tmp_path):
    import time

    config = PlanConfig(500, 4, 1, warmup=False, order="index")
    every = [(0, 0, 0, q, q, 50 + q, 0, None) for q in range(10) if q not in (2, 3)] + [(0, 0, 0, 10, None, None, None, None)]
    query = _stream(spark, tmp_path, [every], config, "lost", late="side", gap=1_000).trigger(processingTime="1 second").start()
    try:
        found, end = [], time.time() + 60
        while time.time() < end and sum(len(r.sample_ids) for r in found if r.kind == "group") < 8:
            time.sleep(1)
            found = spark.sql("select * from lost").collect()
    finally:
        query.stop()
    assert [(r.rank, r.slot, r["size"]) for r in found if r.kind == "gap"] == [(0, 2, 2)]
    assert sorted(i for r in found if r.kind == "group" for i in r.sample_ids) == [0, 1, 4, 5, 6, 7, 8, 9]


def test_rounds_past_200_are_flipped(spark, tmp_path):
    from pyspark.sql import functions as F

    from paceline.plans import queries

    n = 210 * queries.WINDOW * 10 // 4
    rows = [(i, "a b c " * (1 + i % 50), "en", "a", 0) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries._Round(spark, str(tmp_path)).flipped.groupBy("round", "rank").agg(F.max("target").alias("target"), F.min(F.struct("aligned_idx", "emit_pos")).alias("first")).collect()
    assert max(r["round"] for r in got) >= 205
    for r in got:
        flip = flips("balanced", queries.SEED, r["round"], r["rank"], queries.WORLD)
        assert r["first"].emit_pos == (r["target"] - 1 if flip else 0), r


def test_a_missing_flip_fails(spark):
    from paceline.functions.flips import flip_table

    groups = spark.createDataFrame([(0, 0, 0, 1, 5, 1), (1, 0, 0, 1, 5, 1)], "round long, rank int, aligned_idx long, size long, tokens long, target long")
    with pytest.raises(Exception, match="no flip for round 1"):
        align.flipped(groups, flip_table(spark, "balanced", 1, 1, 1)).collect()


def test_files_of_the_stream_hold_ranges_of_arrivals(spark, monkeypatch):
    from paceline.streaming import plan as P

    paths, scratch = [], P.scratch
    monkeypatch.setattr(P, "scratch", lambda s: paths.append(scratch(s)) or paths[-1])
    df, rows = _samples(spark, (70, 33, 5, 0), seed=6, zero=2)
    got = P.plan_uneven(spark, "", df, PlanConfig(2048, 16, 4, group_order_flip="balanced"))
    assert got.filter("kind = 'group'").count() > 10
    from pyspark.sql import functions as F

    files = spark.read.parquet(f"{paths[0]}/in").groupBy(F.input_file_name()).agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    ends = sorted((r.a, r.b) for r in files)
    assert sum(r.n for r in files) == len(rows) + 4 and len(files) > 3
    assert all(b < a for (_, b), (a, _) in zip(ends, ends[1:], strict=False))
