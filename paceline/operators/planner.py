"""The multi-round planner: recycling links a job's rounds, but only where something is recycled.

Window boundaries don't depend on content, so every row knows its round beforehand. A round that nothing was recycled into
can be planned alone. Rounds that would recycle something by themselves are found by counts and, where counts can't tell,
by segmentation in the JVM; from each of them rounds are followed until nothing is carried any more. Those stretches, and
blocks of all other rounds, are pieces that tasks plan at once, each streaming its rows by round: what is held is one
round of all ranks and what it recycles, never the job. Numbers of steps and the seeded order of groups need the sizes of
the rounds before alone, and come from a pass over one row a round. Small jobs are planned in one piece. Payload is joined
to the plan afterwards, by sample_id.

arrival_idx counts each rank's rows of a job from 0 without gaps (sources.samples.arrivals); a rank that comes back after
a short round fails the plan.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paceline.config import PlanConfig
from paceline.functions.flips import flips
from paceline.operators import segment
from paceline.operators.windows import ramp, round_of
from paceline.sources.workdir import stored

SCHEMA = "job long, sample_id long, rank int, round long, pos long, slot long, step long, status string, group_size long, group_tokens long, total_size long, total_tokens long"

#: Samples up to which a job isn't cut, rounds of a piece, rounds that what is recycled is followed at first, and windows
#: up to which a round is segmented to see whether it recycles anything.
ALONE, BLOCK_ROUNDS, REACH, SEGMENTED = 1_000_000, 8, 8, 4_096
#: Samples that a task plans, on average.
TASK = 100_000

Sample = tuple[int, int, int]  #: (length, sample_id, patches)


def cut_groups(window: list[Sample], budget: int, max_patches: int = 0) -> list[list[Sample]]:
    """Groups of a window sorted by length, the shortest first: each group ends where the one above it begins, and begins
    `room` samples below, or above the first sample with which its patches would be too many. A group that fills its room
    sets that of the next one, by its shortest sample."""
    upto = list(accumulate((s[2] for s in window), initial=0)) if max_patches > 0 else None
    cuts, room = [len(window)], 1
    while end := cuts[-1]:
        begin = max(end - room, 0)
        fits = min(bisect_left(upto, upto[end] - max_patches), end - 1) if upto else 0
        cuts.append(max(begin, fits))
        if fits <= begin:
            length, _, patches = window[begin]
            room = max(budget // length, 1)
            if upto and patches > 0:
                room = max(min(room, max_patches // patches), 1)
    return [window[a:b] for b, a in zip(cuts, cuts[1:], strict=False)][::-1]


def fit_groups(groups: list[list[Sample]], target: int) -> tuple[list[list[Sample]], list[Sample]]:
    """Exactly target groups, and the samples left over."""
    if len(groups) >= target:
        keep = set(sorted(range(len(groups)), key=lambda j: (-len(groups[j]), j))[:target])
        return [g for j, g in enumerate(groups) if j in keep], [s for j, g in enumerate(groups) if j not in keep for s in g]
    out: list[list[Sample]] = []
    missing = target - len(groups)
    for g in reversed(groups):  # the longest first; each keeps its shortest sample
        peel = min(missing, len(g) - 1)
        missing -= peel
        out += [[s] for s in reversed(g[len(g) - peel :])] + [g[: len(g) - peel]]
    return out[::-1], []


class Rounds:
    """The state of one job between rounds: what each rank recycles, the steps so far, and the order of the next ones."""

    def __init__(self, config: PlanConfig, epoch: int | None = None):
        self.config, self.seed = config, config.seed + (config.epoch if epoch is None else epoch)
        self.sizes = ramp(config.window, config.warmup)
        self.left: list[list[Sample]] = [[] for _ in range(config.world_size)]
        self.shuffle, self.k, self.steps, self.closed = random.Random(self.seed), 0, 0, False

    def width(self) -> int:
        return self.sizes[self.k] if self.k < len(self.sizes) else self.config.window

    def advance(self, arrivals: list[list[Sample]]) -> list[tuple]:
        """Plan one round of arrivals, by rank: (rank, slots, groups as (pos, group), totals by pos) of each rank. A rank
        without arrivals is done."""
        c, world = self.config, len(arrivals)
        slots = [len(a) for a in arrivals]
        done = [not n for n in slots]
        cut = []
        for r, came in enumerate(arrivals):
            buffer = sorted((s for s in self.left[r] + came if s[0] > 0), key=lambda s: s[0])
            cut.append([] if done[r] else cut_groups(buffer, c.token_budget, c.max_patches))
        groups = [g[: c.window] for g in cut]
        active = [r for r in range(world) if groups[r]]
        target = max(1, min(max(len(groups[r]) for r in active), *(min(slots[r], sum(map(len, groups[r]))) for r in active))) if active else 0
        fitted: dict[int, list] = {}
        for r in range(world):
            if r in active:
                fitted[r], over = fit_groups(groups[r], target)
                self.left[r] = over + [s for g in cut[r][c.window :] for s in g]
                if flips(c.group_order_flip, self.seed, self.k, r, world):
                    fitted[r].reverse()
            elif not done[r]:
                self.left[r] = []
        order = list(range(target))
        if c.order == "seeded":
            self.shuffle.shuffle(order)
        totals = [(sum(len(fitted[r][i]) for r in active), sum(s[0] for r in active for s in fitted[r][i])) for i in order]
        self.k, self.steps = self.k + 1, self.steps + target
        self.closed = not c.effective_join and any(done)
        return [(r, slots[r], [(p, fitted[r][i]) for p, i in enumerate(order)] if r in fitted else [], totals) for r in range(world)]


def rounds(arrivals: list[list[Sample]], config: PlanConfig) -> Iterator[tuple]:
    """(rank, round, slots, groups of the rank with (pos, group), totals by pos, left over) as rounds go by."""
    state, at = Rounds(config), 0
    while any(at < len(a) for a in arrivals) and not state.closed:
        k, width = state.k, state.width()
        for r, slots, groups, totals in state.advance([a[at : at + width] for a in arrivals]):
            yield r, k, slots, groups, totals, state.left[r]
        at += width


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _unplaced(job: int, rank: int, sample: Sample) -> tuple:
    return (job, sample[1], rank, None, None, None, None, "filtered" if sample[0] <= 0 else "dropped", None, None, None, None)


class _Job:
    """Plans the rows of one job, which come sorted by round, rank and arrival."""

    def __init__(self, job: int, config: PlanConfig):
        self.job, self.state, self.round = job, Rounds(config), None
        self.arrivals: list[list[Sample]] = [[] for _ in range(config.world_size)]
        self.ended = [False] * config.world_size

    def add(self, round_: int, rank: int, *samples: Sample) -> list[tuple]:
        out = self.settle() if self.round not in (None, round_) else []
        self.round = round_
        if self.ended[rank]:
            raise ValueError(f"job {self.job}: rank {rank} has a gap in arrival_idx before round {round_}")
        self.arrivals[rank] += samples
        return out

    def settle(self) -> list[tuple]:
        came, self.arrivals = self.arrivals, [[] for _ in self.arrivals]
        unplaced = [(r, s) for r, a in enumerate(came) for s in a if s[0] <= 0 or self.state.closed]
        out = [_unplaced(self.job, r, s) for r, s in unplaced]
        if self.state.closed:
            return out
        if self.round != self.state.k:
            raise ValueError(f"job {self.job}: no rows in round {self.state.k}")
        width, first = self.state.width(), self.state.steps
        self.ended = [len(a) < width for a in came]
        for r, _, groups, totals in self.state.advance(came):
            for p, group in groups:
                tokens = sum(s[0] for s in group)
                out += [(self.job, sid, r, self.round, p, p, first + p, "emitted", len(group), tokens, *totals[p]) for _, sid, _ in group]
        return out

    def finish(self) -> list[tuple]:
        out, state = self.settle() if self.round is not None else [], self.state
        rest = [(r, s) for r, left in enumerate(state.left) for s in left]
        if state.config.tail == "flush":
            return out + [(self.job, s[1], r, state.k, i, None, state.steps + i, "flushed", 1, s[0], 1, s[0]) for i, (r, s) in enumerate(rest)]
        return out + [_unplaced(self.job, r, s) for r, s in rest]


class _Piece:
    """Plans the rounds of one piece, which starts with nothing recycled; rows come sorted as those of a job, with the last
    round of their rank. Groups keep their index, as their places need the rounds before."""

    def __init__(self, job: int, config: PlanConfig):
        self.job, self.round, self.state = job, None, Rounds(replace(config, order="index"))
        self.arrivals: list[list[Sample]] = [[] for _ in range(config.world_size)]
        self.last: list[int] = [-1] * config.world_size

    def add(self, round_: int, rank: int, *samples: Sample, last: int) -> list[tuple]:
        out = self.settle() if self.round not in (None, round_) else []
        self.round, self.last[rank] = round_, last
        self.arrivals[rank] += samples
        return out

    def left(self, ranks: list[int]) -> list[tuple]:
        out = [(self.job, s[1], r, None, i, None, None, "left", 1, s[0], 1, s[0]) for r in ranks for i, s in enumerate(self.state.left[r])]
        for r in ranks:
            self.state.left[r] = []
        return out

    def settle(self) -> list[tuple]:
        came, self.arrivals = self.arrivals, [[] for _ in self.arrivals]
        out = [_unplaced(self.job, r, s) for r, a in enumerate(came) for s in a if s[0] <= 0]
        self.state.k = self.round
        for r, _, groups, totals in self.state.advance(came):
            for i, group in groups:
                tokens = sum(s[0] for s in group)
                out += [(self.job, sid, r, self.round, i, None, len(totals), "emitted", len(group), tokens, *totals[i]) for _, sid, _ in group]
        # what a rank has left over after its last round is never planned
        return out + self.left([r for r, a in enumerate(came) if a and self.last[r] == self.round])

    def finish(self) -> list[tuple]:
        out = self.settle() if self.round is not None else []
        return out + [(*x[:7], "open", *x[8:]) for x in self.left(list(range(len(self.arrivals))))]


def _streamed(start: Callable, *keys: str) -> Callable:
    """A function for mapInArrow over rows sorted by the keys, of which the first is the job, and by round, rank and
    arrival: one planner for each run of rows that agree in the keys."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, out = None, None, []
        for batch in batches:
            data = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            places = list(zip(*(data[name] for name in (*keys, "round", "rank")), strict=True))
            samples = list(zip(data["length"], data["sample_id"], data["n_patches"], strict=True))
            begins = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
            for a, b in zip(begins, [*begins[1:], len(places)], strict=True):
                if places[a][: len(keys)] != key:
                    if now:
                        out += now.finish()
                    key, now = places[a][: len(keys)], start(places[a][0])
                more = {"last": data["last"][a]} if "last" in data else {}
                out += now.add(*places[a][len(keys) :], *samples[a:b], **more)
                if len(out) > 10_000:
                    yield _batch(out)
                    out = []
        if now:
            yield _batch(out + now.finish())

    return apply


def _in_pieces(rows: DataFrame, pieces: DataFrame, config: PlanConfig) -> DataFrame:
    """SCHEMA rows of the rounds in pieces (job, round, piece): pos is the index of a group and step the number of groups
    of the round. Status "left" is what a rank has left over after its last round, "open" what a piece would carry on."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK))
    # a fixed number of tasks, as planning costs more than its rows weigh
    d = rows.join(pieces, ["job", "round"]).repartition(tasks, "job", "piece").sortWithinPartitions("job", "piece", "round", "rank", "arrival_idx")
    return d.select("job", "piece", "round", "rank", "length", "sample_id", "n_patches", "last").mapInArrow(_streamed(lambda job: _Piece(job, config), "job", "piece"), SCHEMA)


def restart_pieces(rows: DataFrame, config: PlanConfig, block: int = BLOCK_ROUNDS, reach: int = REACH) -> DataFrame:
    """(job, round, piece): stretches of rounds that can be planned apart, as nothing is recycled into them.

    rows: (job, round, rank, length, sample_id, n_patches, arrival_idx, last). With nothing recycled into it a round
    recycles something only if a rank has more groups than another one has slots or samples.
    """
    per = rows.groupBy("job", "round", "rank").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.when(F.col("length") > 0, 1).otherwise(0)).alias("n"))
    per = stored(per)
    tight = per.filter("n > 0").groupBy("job", "round").agg(F.max("n").alias("most"), F.min(F.least("slots", "n")).alias("room")).filter("most > room")
    if config.window <= SEGMENTED:
        d = rows.join(tight, ["job", "round"])
        groups = segment.greedy_groups(d, config.token_budget, config.max_patches, ("job", "rank", "round", "room"))
        tight = groups.groupBy("job", "round").agg(F.max("n_groups").alias("groups"), F.first("room").alias("room")).filter("groups > room")
    starts = stored(tight.select("job", "round"))
    ends = per.groupBy("job").agg(F.max("round").alias("end"))
    if starts.isEmpty():
        return per.select("job", "round").distinct().withColumn("piece", _block(block))
    by = Window.partitionBy("job").orderBy("round")
    while True:
        # stretches up to `reach` rounds after a start, as one where they meet
        new = F.coalesce(F.col("round") > F.lag("round").over(by) + reach, F.lit(True)).cast("int")
        runs = starts.withColumn("new", new).withColumn("run", F.sum("new").over(by))
        runs = runs.groupBy("job", "run").agg(F.min("round").alias("begin"), (F.max("round") + reach).alias("until")).join(ends, "job")
        followed = stored(runs.select("job", F.explode(F.sequence("begin", F.least("until", "end"))).alias("round"), (2 * F.col("begin") + 1).alias("piece")))
        if _in_pieces(rows, followed, config).filter("status = 'open'").isEmpty():
            break
        reach *= 4
    every = per.select("job", "round").distinct().join(followed, ["job", "round"], "left")
    return every.withColumn("piece", F.coalesce("piece", _block(block)))


def _block(block: int) -> Column:
    """Even numbers for blocks of rounds; stretches that are followed have odd ones."""
    return (2 * F.floor(F.col("round") / block)).cast("long")


def _orders(rounds: DataFrame, config: PlanConfig) -> DataFrame:
    """(job, round, first, place): the number of a round's first step, and the place of each group. rounds: (job, round,
    step), one row for each round that has `step` groups."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, first, rng = None, 0, random.Random()
        for batch in batches:
            begins, places = [], []
            for key, n in zip(batch.column("job").to_pylist(), batch.column("step").to_pylist(), strict=True):
                if key != job:
                    job, first = key, 0
                    rng.seed(config.seed + config.epoch)
                order = list(range(n))
                if config.order == "seeded":
                    rng.shuffle(order)
                begins.append(first)
                places.append(sorted(range(n), key=order.__getitem__))
                first += n
            yield pa.RecordBatch.from_arrays([batch.column("job"), batch.column("round"), pa.array(begins, pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["job", "round", "first", "place"])

    return rounds.repartition("job").sortWithinPartitions("job", "round").mapInArrow(apply, "job long, round long, first long, place array<long>")


def _planned_apart(d: DataFrame, config: PlanConfig, block: int, reach: int) -> DataFrame:
    """The plan of stored rows (job, round, rank, arrival_idx, length, sample_id, n_patches), in pieces."""
    ranks = d.groupBy("job", "rank").agg(F.max("round").alias("last"), F.count(F.lit(1)).alias("n"), F.max("arrival_idx").alias("top"))
    if not ranks.filter("n != top + 1").isEmpty():
        raise ValueError("a rank has a gap in arrival_idx")
    closed = F.when(F.count(F.lit(1)) < config.world_size, 0).otherwise(F.min("last") + 1)
    close = ranks.groupBy("job").agg((F.lit(1 << 62) if config.effective_join else closed).cast("long").alias("close"))
    d = d.join(ranks.join(close, "job").select("job", "rank", F.least("last", "close").alias("last"), "close"), ["job", "rank"])
    rows = d.filter("round <= close").drop("close")
    planned = stored(_in_pieces(rows, restart_pieces(rows, config, block, reach), config))
    if not planned.filter("status = 'open'").isEmpty():
        raise RuntimeError("a piece would have carried samples on")
    rounds = planned.filter("status = 'emitted'").groupBy("job", "round").agg(F.max("step").alias("step"))
    orders = stored(_orders(rounds, config))
    place = F.get("place", F.col("pos").cast("int"))
    emitted = planned.filter("status = 'emitted'").join(orders, ["job", "round"]).withColumns({"pos": place, "slot": place, "step": F.col("first") + place}).select(*_NAMES)
    none = lambda c: F.lit(None).cast("long").alias(c)
    over = d.filter("round > close").select("job", "sample_id", "rank", F.when(F.col("length") <= 0, "filtered").otherwise("dropped").alias("status"))
    over = over.unionByName(planned.filter("status = 'filtered'").select("job", "sample_id", "rank", "status"))
    left = planned.filter("status = 'left'")
    if config.tail == "flush":
        total = rows.groupBy("job").agg((F.max("round") + 1).alias("round"))
        steps = orders.groupBy("job").agg(F.max(F.col("first") + F.size("place")).alias("steps"))
        left = left.withColumn("pos", (F.row_number().over(Window.partitionBy("job").orderBy("rank", "pos")) - 1).cast("long"))
        left = left.drop("round").join(total, "job").join(steps, "job", "left")
        left = left.withColumns({"step": F.coalesce("steps", F.lit(0)) + F.col("pos"), "status": F.lit("flushed")}).select(*_NAMES)
    else:
        over = over.unionByName(left.select("job", "sample_id", "rank", F.lit("dropped").alias("status")))
        left = None
    unplaced = over.select(*(c if c in ("job", "sample_id", "rank", "status") else none(c) for c in _NAMES))
    out = emitted.unionByName(unplaced)
    return out.unionByName(left) if left is not None else out


def plan(samples: DataFrame, config: PlanConfig, job: str | None = None, alone: int = ALONE, block: int = BLOCK_ROUNDS, reach: int = REACH) -> DataFrame:
    """The plan of canonical samples, one row for each: where it is emitted, or filtered (no length), or dropped (left
    over at the end; tail="flush" emits those one by one). step identifies a training step over ranks. Up to `alone`
    samples are planned job by job; beyond, jobs are cut into pieces of `block` rounds, and what is recycled is followed
    for `reach` rounds at first."""
    key = F.col(job).cast("long") if job else F.lit(0).cast("long")
    d = samples.select(key.alias("job"), round_of(F.col("arrival_idx"), config.window, config.warmup).alias("round"), F.col("rank").cast("int").alias("rank"), F.col("arrival_idx").cast("long").alias("arrival_idx"), F.col("length").cast("long").alias("length"), "sample_id", F.col("n_patches").cast("long").alias("n_patches"))
    d = stored(d)
    if d.count() > alone:
        return _planned_apart(d, config, block, reach)
    d = d.repartition("job").sortWithinPartitions("job", "round", "rank", "arrival_idx").drop("arrival_idx")
    return d.select("job", "round", "rank", "length", "sample_id", "n_patches").mapInArrow(_streamed(lambda key: _Job(key, config), "job"), SCHEMA)


def attach(plan: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """The plan with the payload of each sample, joined last."""
    return plan.join(payload, plan["sample_id"] == payload[key])


def against_source(plan: DataFrame, source: DataFrame, key: str = "sample_id") -> DataFrame:
    """(side, sample_id) of what plan and source don't share: samples of the source that the plan doesn't mention
    ("missing"), and samples that are planned but not in the source ("unknown"). Null keys are left out."""
    ids = source.select(F.col(key).cast("long").alias("sample_id")).filter("sample_id is not null").distinct()
    placed = plan.select("sample_id").distinct()
    missing, unknown = ids.join(placed, "sample_id", "left_anti"), placed.join(ids, "sample_id", "left_anti")
    return missing.select(F.lit("missing").alias("side"), "sample_id").unionByName(unknown.select(F.lit("unknown").alias("side"), "sample_id"))


def coverage(plan: DataFrame) -> DataFrame:
    """How many samples were emitted, more than once, filtered and dropped."""
    one = plan.groupBy("job", "sample_id").agg(F.sum(F.when(F.col("status").isin("emitted", "flushed"), 1).otherwise(0)).alias("n"), F.max("status").alias("status"))
    return one.groupBy("job").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("emitted"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"), F.sum(F.when((F.col("n") == 0) & (F.col("status") == "filtered"), 1).otherwise(0)).alias("filtered"), F.sum(F.when((F.col("n") == 0) & (F.col("status") == "dropped"), 1).otherwise(0)).alias("dropped"))
