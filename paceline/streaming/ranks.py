"""Streaming plans over all ranks of a job: the rounds of the batch planner, made as their windows fill up.

Rows (job, epoch, rank, seq, sample_id, length, n_patches, error) may come out of order: state keeps them until those
before have come. A row with error stands for a sample that failed to load: it takes its seq, but joins no window, and
comes out as it is. sample_id null without error marks the end of a rank. A round is planned when every rank has filled
its window or ended; what it recycles is kept in state for the next one. An epoch is a plan of its own, with its number
added to the seed.

Output rows have a kind: "group" (one for each slot that is filled), "idle" (slots without a group), "error", "late" (a
seq that has come before, or of an epoch that is over; late="fail" fails the query instead), "gap" (numbers that didn't
come in time), and at the end "flushed" or "dropped" for what is left. Every slot comes out once. State is the early rows,
one open round and what is recycled, never the job, and goes when the epoch ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from paceline.config import PlanConfig
from paceline.operators.planner import Rounds

OUT = "job long, epoch long, kind string, rank int, round long, slot long, step long, size long, tokens long, total_size long, total_tokens long, sample_ids array<long>, error string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


class Job:
    """One epoch of one job, fed row by row."""

    def __init__(self, job: int, epoch: int, config: PlanConfig):
        self.key, self.state = (job, epoch), Rounds(config, epoch)
        world = config.world_size
        self.due, self.early = [0] * world, [{} for _ in range(world)]
        self.window: list[list] = [[] for _ in range(world)]
        self.ended, self.finished = [False] * world, False

    def row(self, kind: str, rank: int, *, round_=None, slot=None, step=None, size=None, tokens=None, total=(None, None), ids=(), error=None) -> tuple:
        return (*self.key, kind, rank, round_, slot, step, size, tokens, *total, list(ids), error)

    def add(self, rank: int, seq: int, sample: tuple | None, error: str | None, late: str) -> list[tuple]:
        if seq < self.due[rank] or seq in self.early[rank]:
            if late == "fail":
                raise ValueError(f"job {self.key[0]}, rank {rank}: seq {seq} has already come")
            return [self.row("late", rank, slot=seq, ids=[sample[1]] if sample else [], error=error)]
        self.early[rank][seq] = (sample, error)
        return self.drain(rank) + self.settle()

    def skip(self, rank: int) -> list[tuple]:
        """Go on behind the numbers that are missing before the earliest row that waits."""
        first, self.due[rank] = self.due[rank], min(self.early[rank])
        return [self.row("gap", rank, slot=first, size=self.due[rank] - first), *self.drain(rank), *self.settle()]

    def drain(self, rank: int) -> list[tuple]:
        """Take the rows that are next."""
        out = []
        while self.due[rank] in self.early[rank]:
            sample, error = self.early[rank].pop(self.due[rank])
            self.due[rank] += 1
            if error is not None:
                out.append(self.row("error", rank, slot=self.due[rank] - 1, ids=[sample[1]] if sample else [], error=error))
            elif sample is None:
                self.ended[rank] = True
            else:
                self.window[rank].append(sample)
        return out

    def settle(self) -> list[tuple]:
        out, state = [], self.state
        while not self.finished:
            width = state.width()
            if not all(e or len(w) >= width for e, w in zip(self.ended, self.window, strict=True)):
                break
            if state.closed or not any(self.window):
                if all(self.ended):
                    out += self.finish()
                break
            came = [w[:width] for w in self.window]
            self.window = [w[width:] for w in self.window]
            k, first = state.k, state.steps
            for r, slots, groups, totals in state.advance(came):
                for p, g in groups:
                    out.append(self.row("group", r, round_=k, slot=p, step=first + p, size=len(g), tokens=sum(s[0] for s in g), total=totals[p], ids=[s[1] for s in g]))
                out += [self.row("idle", r, round_=k, slot=p) for p in range(len(groups), slots)]
        return out

    def finish(self) -> list[tuple]:
        self.finished, state = True, self.state
        unread = [(r, s) for r, w in enumerate(self.window) for s in w if s[0] > 0]
        rest = [(r, s) for r, left in enumerate(state.left) for s in left]
        if state.config.tail == "flush":
            out = [self.row("flushed", r, round_=state.k, slot=i, step=state.steps + i, size=1, tokens=s[0], total=(1, s[0]), ids=[s[1]]) for i, (r, s) in enumerate(rest)]
        else:
            out = [self.row("dropped", r, ids=[s[1]]) for r, s in rest]
        return out + [self.row("dropped", r, ids=[s[1]]) for r, s in unread]


class RankProcessor(StatefulProcessor):
    """Jobs over Spark's state store. A batch reads the counters and the open round of the jobs that it has rows of, and
    writes what it changes: rows that are early or join the open round one by one, what is recycled and the order only
    when a round is planned. A finished epoch leaves only a mark, by which rows that still come are late, and which goes
    after `keep` milliseconds."""

    def __init__(self, config: PlanConfig, late: str, gap: int | None, keep: int | None):
        self.config, self.late, self.gap, self.keep = config, late, gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = "rank int, length long, sample_id long, n_patches long"
        self.handle = handle
        self.counters = handle.getValueState("counters", "k long, steps long, closed boolean, due array<long>, ended array<boolean>, early array<long>, since array<long>")
        self.order = handle.getValueState("order", "version long, inner array<long>, spare double")
        self.left = handle.getListState("left", sample)
        self.window = handle.getListState("window", sample)
        self.early = handle.getMapState("early", "rank int, seq long", "sample_id long, length long, n_patches long, error string")
        self.done = handle.getValueState("done", "finished boolean", self.keep)

    def load(self, key: tuple) -> tuple[Job, list[int]]:
        """The job as it is kept, and since when each rank has waited."""
        job, since = Job(int(key[0]), int(key[1]), self.config), [0] * self.config.world_size
        if self.counters.exists():
            state = job.state
            state.k, state.steps, state.closed, due, ended, early, since = self.counters.get()
            job.due, job.ended, since = list(due), list(ended), list(since)
            if self.order.exists():
                version, inner, spare = self.order.get()
                state.shuffle.setstate((version, tuple(inner), spare))
            for held, into in ((self.left, state.left), (self.window, job.window)):
                for rank, *s in held.get():
                    into[rank].append(tuple(s))
            if any(early):
                for (rank, seq), (sid, length, patches, error) in self.early.iterator():
                    job.early[rank][seq] = (None if sid is None else (length, sid, patches), error)
        return job, since

    def save(self, job: Job, before: tuple, since: list[int], now: int) -> None:
        if job.finished:
            for held in (self.counters, self.order, self.left, self.window, self.early):
                held.clear()
            for at in list(self.handle.listTimers()) if self.gap is not None else []:
                self.handle.deleteTimer(at)
            self.done.update((True,))
            return
        state, (k, due, sizes, early) = job.state, before
        if self.config.order == "seeded" and state.k != k:
            self.order.update(state.shuffle.getstate())
        flat = lambda ranks: [(r, *s) for r, samples in enumerate(ranks) for s in samples]
        if state.k != k:
            for held, rows in ((self.left, flat(state.left)), (self.window, flat(job.window))):
                held.put(rows) if rows else held.clear()
        elif more := [(r, *s) for r, samples in enumerate(job.window) for s in samples[sizes[r] :]]:
            self.window.appendList(more)
        waiting = {(r, seq) for r, rows in enumerate(job.early) for seq in rows}
        for r, seq in early - waiting:
            self.early.removeKey((r, seq))
        for r, seq in waiting - early:
            sample, error = job.early[r][seq]
            length, sid, patches = sample or (None, None, None)
            self.early.updateValue((r, seq), (sid, length, patches, error))
        # a rank waits from when rows behind the one that is due have come
        since = [(since[r] if since[r] and due[r] == job.due[r] else now) if job.early[r] else 0 for r in range(len(due))]
        if self.gap is not None and any(since):
            self.handle.registerTimer(min(x for x in since if x) + self.gap)
        self.counters.update((state.k, state.steps, state.closed, job.due, job.ended, [len(x) for x in job.early], since))

    def run(self, key: tuple, now: int, work: Callable[[Job, list[int]], list[tuple]]) -> Iterator[pd.DataFrame]:
        job, since = self.load(key)
        before = (job.state.k, list(job.due), [len(w) for w in job.window], {(r, seq) for r, rows in enumerate(job.early) for seq in rows})
        out = work(job, since)
        self.save(job, before, since, now)
        made = pd.DataFrame(out, columns=_NAMES)
        yield made.astype({n.split()[0]: "Int64" for n in OUT.split(", ") if n.split()[1] in ("long", "int")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        over = self.done.exists()

        def work(job: Job, since: list[int]) -> list[tuple]:
            out = []
            for frame in rows:
                frame = frame.sort_values(["rank", "seq"])
                for rank, seq, sid, length, patches, error in frame[["rank", "seq", "sample_id", "length", "n_patches", "error"]].itertuples(index=False):
                    sample = None if pd.isna(sid) else (int(length), int(sid), int(patches))
                    if over:
                        job.due[int(rank)] = int(seq) + 1
                    out += job.add(int(rank), int(seq), sample, None if pd.isna(error) else error, self.late)
            job.finished = job.finished or over
            return out

        return self.run(key, 0 if self.gap is None else timerValues.getCurrentProcessingTimeInMs(), work)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()

        def work(job: Job, since: list[int]) -> list[tuple]:
            return [x for r in range(len(since)) if since[r] and job.early[r] and since[r] + self.gap <= now for x in job.skip(r)]

        return self.run(key, now, work) if self.counters.exists() else iter(())

    def close(self) -> None:
        pass


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plan_ranks(rows: DataFrame, config: PlanConfig, late: str = "fail", gap: int | None = None, keep: int | None = None) -> DataFrame:
    """The plan of a streaming DataFrame, in append mode.

    gap: milliseconds after which a rank goes on behind numbers that haven't come, and says so by a "gap" row (slot: the
    first of them, size: how many); None: it waits for ever. Numbers that come later still are late. keep: milliseconds
    for which a finished epoch is known; None: for good, as one boolean. Both need the clock, by which Spark runs batches
    without end: a query that is to stop when its input does (availableNow) can have neither. The session's state store
    becomes RocksDB, which structured state needs.
    """
    clock = "None" if gap is None and keep is None else "ProcessingTime"
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy("job", "epoch").transformWithStateInPandas(RankProcessor(config, late, gap, keep), OUT, "append", clock)
