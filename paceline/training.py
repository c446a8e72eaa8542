"""The training side of a plan, without any framework: counts samples, scales losses, says when to stop.

An adapter for a framework calls `consume` for each batch (or wraps its step with `scaled_step`), `optimizer_step` after
each update, and looks at `should_stop`. The same arithmetic over a whole plan is in operators.progress.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from paceline.operators.progress import max_steps, sample_budget

# Keys of a batch that carry step information; the record wins over the flat ones.
RECORD, TOTAL_N, LOCAL_N, TOTAL_T, LOCAL_T = "step_info", "total_batch_size", "local_batch_size", "total_tokens", "local_tokens"


@dataclass(frozen=True)
class StepInfo:
    all_samples: int
    loss_scale: float = 1.0


def _whole(value: Any, default: int = 0) -> int:
    while isinstance(value, (list, tuple)):
        value = value[0] if value else None
    return default if value is None else int(value)


def pop_info(batch: dict, loss_scaling: str = "auto", world: int = 1) -> StepInfo:
    """Take the step information out of a batch."""
    record = batch.pop(RECORD, None)
    flat = {k: batch.pop(k, None) for k in (TOTAL_N, LOCAL_N, TOTAL_T, LOCAL_T)}
    if isinstance(record, StepInfo):
        return record
    rows = next((len(v) for v in batch.values() if hasattr(v, "__len__") and not isinstance(v, str)), 0)
    local = _whole(flat[LOCAL_N], rows)
    total = _whole(flat[TOTAL_N], local)
    tokens = (_whole(flat[LOCAL_T]), _whole(flat[TOTAL_T]))
    bases = {"none": [], "approx": [tokens], "exact": [tokens], "auto": [tokens, (local, total)]}[loss_scaling]
    own, every = next((b for b in bases if all(b)), (1, world))
    return StepInfo(total, own / every * world)


@dataclass
class TrainingProgress:
    """Running counts of one run. `sizes` holds total sizes that come without a batch (oldest first), for loops in which
    the batch is out of reach when a step ends."""

    budget: int
    epochs: float = 1.0
    world: int = 1
    loss_scaling: str = "exact"
    accumulation: int = 1
    total: int = 0
    steps: int = 0
    optimizer_steps: int = 0
    scale: float = 1.0
    sizes: deque = field(default_factory=deque)
    _pending: int = 0
    _losses: tuple[float, int] = (0.0, 0)

    @classmethod
    def for_source(cls, n: int | None, epochs: float, explicit: int | None = None, legacy: bool = False, **more) -> TrainingProgress:
        return cls(sample_budget(n, epochs, explicit, legacy), epochs, **more)

    def consume(self, batch: Any) -> StepInfo | None:
        """Take a batch's step information, count it, and keep its scale. What is no dict passes, with one queued size."""
        info = pop_info(batch, self.loss_scaling, self.world) if isinstance(batch, dict) else None
        n = info.all_samples if info else (self.sizes.popleft() if self.sizes else 0)
        self.scale = info.loss_scale if info else 1.0
        self.total, self.steps, self._pending = self.total + n, self.steps + 1, self._pending + n
        return info

    def scaled(self, loss: Any) -> Any:
        """A loss by the scale of its step: a number, the first item of a tuple, or the key loss of a dict."""
        if isinstance(loss, tuple):
            return (self.scaled(loss[0]), *loss[1:])
        if isinstance(loss, dict):
            return {**loss, "loss": self.scaled(loss["loss"])}
        if self.scale == 1.0:
            return loss
        self._losses = (self._losses[0] + float(loss), self._losses[1] + 1)
        return loss * self.scale

    def optimizer_step(self) -> int:
        """Ends an optimizer step: how many scheduler ticks to add to the one that the loop makes itself."""
        extra, self._pending = max(self._pending - 1, 0), 0
        self.optimizer_steps += 1
        return extra

    @property
    def at_update(self) -> bool:
        return self.steps % self.accumulation == 0

    @property
    def epoch(self) -> float:
        return self.total / self.budget * self.epochs

    @property
    def should_stop(self) -> bool:
        return self.total >= self.budget

    def pop_unscaled_mean(self) -> float | None:
        """Mean of the losses before scaling since the last call."""
        (total, n), self._losses = self._losses, (0.0, 0)
        return total / n if n else None


def scaled_step(progress: TrainingProgress, step: Callable) -> Callable:
    """A training step, as step(batch, ...) -> loss, that takes the step information out of its batch first and scales its
    loss after; the loop's own step otherwise."""
    def run(batch: Any, *args, **more):
        progress.consume(batch)
        return progress.scaled(step(batch, *args, **more))

    return run


def uneven_inputs(joiner: Callable | None, *args, **more):
    """The framework's context for ranks of different lengths, or one that does nothing where it has none."""
    return joiner(*args, **more) if joiner else contextlib.nullcontext()


def enable(n: int | None, epochs: float, budget: int | None = None, per_device_batch_size: int | None = 1, workers: int | None = None, existing_max_steps: int | None = None, policy: str = "overwrite", steps: int | None = None, loss_scaling: str = "exact", world: int = 1) -> tuple[TrainingProgress, int | None]:
    """Progress for a trainer, and its maximal number of steps (None: unlimited). One sample for each fetch and workers
    that prefetch are needed, as groups are made later (else ValueError)."""
    if per_device_batch_size not in (None, 1):
        raise ValueError(f"the per-device batch size must be 1, not {per_device_batch_size}")
    if workers is not None and workers <= 0:
        raise ValueError("workers that prefetch are needed: set their number above 0")
    progress = TrainingProgress.for_source(n, epochs, budget, world=world, loss_scaling=loss_scaling)
    return progress, max_steps(steps, existing_max_steps, policy) if steps else existing_max_steps
