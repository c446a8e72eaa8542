"""Planner configuration: defaults, aliases and validation."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Accepted names of the group order modes.
FLIP_ALIASES = {
    "": "none", "0": "none", "false": "none", "none": "none", "a": "none",
    "rank_epoch_random": "rank_epoch_random", "epoch_random": "rank_epoch_random", "b": "rank_epoch_random",
    "rank_window_random": "rank_window_random", "window_random": "rank_window_random", "c": "rank_window_random",
    "rank_window_balanced": "rank_window_balanced", "window_balanced": "rank_window_balanced", "balanced": "rank_window_balanced", "d": "rank_window_balanced",
}
# Accepted names of the loss scaling modes beside "true".
SCALING_ALIASES = {
    "none": "none", "no": "none", "off": "none", "false": "none",
    "approx": "approx", "token": "approx", "token_approx": "approx", "approximate": "approx",
    "exact": "exact", "token_exact": "exact",
}


def flip_mode(name: str | None) -> str:
    key = "none" if name is None else str(name).strip().lower().replace("-", "_")
    if key not in FLIP_ALIASES:
        raise ValueError(f"unknown group order mode {name!r}; known: {sorted(set(FLIP_ALIASES.values()))}")
    return FLIP_ALIASES[key]


def scaling_mode(name: bool | str | None, approx: bool = True) -> str:
    if name is None or name is False:
        return "none"
    key = str(name).lower().replace("-", "_")
    if key == "true":
        return "approx" if approx else "exact"
    if key not in SCALING_ALIASES:
        raise ValueError(f"unknown loss scaling {name!r}; known: none, approx, exact")
    return SCALING_ALIASES[key]


def default_window(prefetch: int | None, workers: int) -> int:
    """Window size where none is given: prefetched samples of all workers."""
    return (2 if prefetch is None else prefetch) * (workers or 4)


@dataclass(frozen=True)
class PlanConfig:
    """token_budget and window are required to be positive; every mode is normalised."""

    token_budget: int
    window: int = 128
    world_size: int = 1
    loss_scaling: bool | str | None = None
    loss_scaling_approx: bool = True
    join: bool = True
    max_patches: int = 0
    group_order_flip: str | None = None
    warmup: bool = True
    seed: int = 67108
    epoch: int = 0
    order: str = "seeded"
    tail: str = "drop"
    #: Ranks plan on their own, without aligning their groups.
    no_sync: bool = False

    def __post_init__(self):
        for name in ("token_budget", "window", "world_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_patches < 0 or self.order not in ("seeded", "index") or self.tail not in ("drop", "flush"):
            raise ValueError("max_patches must not be negative; order is seeded or index; tail is drop or flush")
        object.__setattr__(self, "loss_scaling", scaling_mode(self.loss_scaling, self.loss_scaling_approx))
        object.__setattr__(self, "group_order_flip", flip_mode(self.group_order_flip))

    @property
    def effective_join(self) -> bool:
        return self.join and self.world_size > 1 and not self.no_sync

    @property
    def scales_loss(self) -> bool:
        return self.loss_scaling != "none"


# Older names of the fields; those under "not" say the opposite.
OLD_NAMES = {"max_input_length": "token_budget", "join_mode": "join", "buffer_size": "window"}
OPPOSITES = {"no_warmup": "warmup"}


def resolve(config: PlanConfig | None = None, workers: int = 4, prefetch: int | None = None, **given) -> PlanConfig:
    """A configuration from arguments under current or older names; None counts as not given.

    Two names of one field must agree, and so must arguments and a given configuration (else ValueError). Without a token
    budget there is no configuration (TypeError). The window is that of `default_window` where none is given.
    """
    known = {f.name for f in fields(PlanConfig)}
    out: dict[str, object] = {}
    for name, value in given.items():
        if value is None:
            continue
        field = OLD_NAMES.get(name, OPPOSITES.get(name, name))
        if field not in known:
            raise TypeError(f"unknown argument {name!r}")
        value = not value if name in OPPOSITES else value
        if field in out and out[field] != value:
            raise ValueError(f"conflicting values of {field}: {out[field]!r} and {value!r}")
        out[field] = value
    if config is None:
        if "token_budget" not in out:
            raise TypeError("a token budget is needed: token_budget, or max_input_length")
        return PlanConfig(**{"window": default_window(prefetch, workers), **out})
    wanted = replace(config, **out)
    for field in out:
        if getattr(wanted, field) != getattr(config, field):
            raise ValueError(f"conflicting values of {field}: {getattr(config, field)!r} in the configuration, {out[field]!r} given")
    return config


def from_objects(*sources: object, names: tuple[str, ...] = (), **more) -> PlanConfig:
    """A configuration from argument objects, the first one that has a field (not None) deciding; arguments in `more`
    go before them. `names` are prefixes that the fields may carry there."""
    given = dict(more)
    for field in (*(f.name for f in fields(PlanConfig)), *OLD_NAMES, *OPPOSITES):
        for source in sources:
            found = [getattr(source, x + field, None) for x in (*names, "")]
            value = next((v for v in found if v is not None), None)
            if given.get(field) is None and value is not None:
                given[field] = value
    return resolve(**given)
