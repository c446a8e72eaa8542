"""Reading a plan: batches in order with their payload and step information, ready for a training loop.

Hooks: `transform` changes payload rows before they are joined to the plan, `collate` makes what a step reads of the rows
of one group (a group is bounded by the token budget, so it fits a worker).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paceline.config import scaling_mode
from paceline.functions.columns import step_scale
from paceline.operators import emit

# Columns that carry step information beside a batch; the struct wins over the flat ones.
STRUCT = "step_info"
FLAT = ("total_batch_size", "local_batch_size", "total_tokens", "local_tokens")
#: Environment variable: a folder for the log of emitted ids.
ID_LOG = "PACELINE_ID_LOG"


def first_int(df: DataFrame, name: str, default: Column | int = 0) -> Column:
    """A column as a whole number: of arrays the first element, at any depth; null, empty or missing: the default."""
    default = F.lit(default) if isinstance(default, int) else default
    if name not in df.columns:
        return default.cast("long")
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    while kind.typeName() == "array":
        c, kind = F.get(c, F.lit(0)), kind.elementType
    return F.coalesce(c.cast("long"), default.cast("long"))


def pop_step_info(batches: DataFrame, loss_scaling: bool | str | None = "auto", world: int = 1, rows: str | None = None) -> DataFrame:
    """batches without the columns of step information, but with all_samples and loss_scale.

    A struct STRUCT (all_samples, loss_scale) that is not null decides; else the flat columns do, by mode: none: 1; approx
    and exact: tokens; auto: tokens where both numbers are there, else samples. `rows`: an array column whose size is the
    number of local samples where no column says so.
    """
    mode = "auto" if loss_scaling in (None, "auto") else scaling_mode(loss_scaling)
    own = F.coalesce(F.size(rows), F.lit(0)) if rows else F.lit(0)
    local = first_int(batches, "local_batch_size", own)
    total = first_int(batches, "total_batch_size", local)
    scale = step_scale(mode, local, total, first_int(batches, "local_tokens"), first_int(batches, "total_tokens"), world)
    if STRUCT in batches.columns:
        given = F.col(STRUCT).isNotNull()
        total = F.when(given, F.col(f"{STRUCT}.all_samples")).otherwise(total)
        scale = F.when(given, F.col(f"{STRUCT}.loss_scale")).otherwise(scale)
    return batches.withColumns({"__all": total.cast("long"), "__scale": scale}).drop(STRUCT, *FLAT).withColumnsRenamed({"__all": "all_samples", "__scale": "loss_scale"})


def payload_of(plan: DataFrame, payload: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Emitted samples of a plan with their payload, changed by the transform hook first."""
    rows = transform(payload) if transform else payload
    return plan.filter("status = 'emitted'").join(rows, plan["sample_id"] == rows[key])


def collated(plan: DataFrame, payload: DataFrame, key: str, collate: Callable[[pd.DataFrame], dict], schema: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(job, rank, step, *schema): what `collate` makes of the payload rows of each group, in order of sample_id. Groups
    for which it gives an empty dict are left out."""
    d = payload_of(plan, payload, key, transform)
    names = [x.strip().split()[0] for x in schema.split(",") if " " in x.strip()]

    def of(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        made = collate(frame.sort_values("sample_id").reset_index(drop=True))
        return pd.DataFrame([(*group, *(made.get(n) for n in names))] if made else [], columns=["job", "rank", "step", *names])

    return d.groupBy("job", "rank", "step").applyInPandas(of, f"job long, rank int, step long, {schema}")


def slots(plan: DataFrame, per_round: DataFrame) -> DataFrame:
    """One row for each slot of a plan: its batch (ids, size, tokens and totals), or idle. per_round: (round, rank,
    slots)."""
    batch = plan.filter("status = 'emitted'").groupBy("round", "rank", F.col("slot").alias("pos")).agg(
        F.first("step").alias("step"), F.array_sort(F.collect_list("sample_id")).alias("ids"), F.first("group_size").alias("size"),
        F.first("group_tokens").alias("tokens"), F.first("total_size").alias("total_size"), F.first("total_tokens").alias("total_tokens"))
    return emit.slot_emission(batch, per_round, "pos")


def consumed(batches: DataFrame, tokens: str = "ids") -> DataFrame:
    """What a consumer gets of slots: no idle ones, none without tokens or with an empty array of them."""
    return batches.filter(~F.col("is_idle") & (F.coalesce(F.size(tokens), F.lit(0)) > 0)).drop("is_idle")


def iterate(batches: DataFrame, rank: int, order: tuple[str, ...] = ("round", "slot")) -> Iterator[Row]:
    """The consumed batches of one rank, in order, streamed partition by partition to the caller."""
    log = os.environ.get(ID_LOG)
    sink = open(os.path.join(log, f"rank{rank}.jsonl"), "w") if log else None  # noqa: SIM115
    try:
        for n, row in enumerate(consumed(batches).filter(F.col("rank") == rank).orderBy(*order).toLocalIterator()):
            if sink:
                sink.write(pd.Series({"step": n, "ids": list(row["ids"])}).to_json() + "\n")
            yield row
    finally:
        if sink:
            sink.close()


def collate_table(spark: SparkSession, name: str, start: Callable[[], Any], add: Callable[[Any, Row], Any], finish: Callable[[Any], tuple | None], schema: str) -> None:
    """Register a table function `name(TABLE(...) PARTITION BY ... ORDER BY ...)` for SQL, which makes one row of each group.

    `add` takes what `start` made and the rows of the group one by one, so a group is streamed and never held as a frame;
    `finish` gives the row, or None for none.
    """
    class Collate:
        def __init__(self) -> None:
            self.held, self.some = None, False

        def eval(self, row: Row) -> None:
            if not self.some:
                self.held, self.some = start(), True
            self.held = add(self.held, row)

        def terminate(self) -> Iterator[tuple]:
            made = finish(self.held) if self.some else None
            if made is not None:
                yield made

    spark.udtf.register(name, F.udtf(Collate, returnType=schema))
