"""Column expressions: lengths, patches, batch sizes, loss scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def input_length(name: str, schema: T.StructType) -> Column:
    """Length of a token column: of an array its size, of a [1, n] array n, 0 for null, empty and other types."""
    kind = next((f.dataType for f in schema.fields if f.name == name), None)
    if not isinstance(kind, T.ArrayType):
        return F.lit(0).cast("long")
    if isinstance(kind.elementType, T.ArrayType):
        if isinstance(kind.elementType.elementType, T.ArrayType):
            return F.lit(0).cast("long")
        inner = F.when(F.size(name) > 0, F.size(F.get(F.col(name), F.lit(0))))
        return F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)).cast("long")
    return F.when(F.col(name).isNull(), 0).otherwise(F.size(name)).cast("long")


def n_patches(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def grid_patches(c: Column) -> Column:
    """Sum over rows of [t, h, w] of their products."""
    return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, g: a + F.aggregate(g, F.lit(1).cast("long"), lambda p, x: p * x)), F.lit(0).cast("long"))


def target_batch_size(length: Column, budget: int, patches: Column | None = None, max_patches: int = 0) -> Column:
    """How many samples of this length fit the budget, 1 at least; patches limit it where both are positive."""
    fit = F.greatest(F.floor(F.lit(budget) / F.nullif(length, F.lit(0))), F.lit(1))
    if patches is not None and max_patches > 0:
        fit = F.when(patches > 0, F.least(fit, F.greatest(F.floor(F.lit(max_patches) / F.nullif(patches, F.lit(0))), F.lit(1)))).otherwise(fit)
    return F.when(length == 0, 1).otherwise(fit).cast("long")


def loss_scale(local: Column, total: Column, world: int) -> Column:
    """Share of the step's basis times the ranks; 1 where either is missing."""
    return F.when((F.coalesce(local, F.lit(0)) == 0) | (F.coalesce(total, F.lit(0)) == 0), F.lit(1.0)).otherwise(local.cast("double") / total * world)


def step_scale(mode: str, local_n: Column, total_n: Column, local_tokens: Column, total_tokens: Column, world: int) -> Column:
    """Loss scale of a step by mode: none; approx and exact by tokens; auto by tokens where there are any, else samples."""
    if mode == "none":
        return F.lit(1.0)
    by_tokens = loss_scale(local_tokens, total_tokens, world)
    if mode in ("approx", "exact"):
        return by_tokens
    return F.when((F.coalesce(local_tokens, F.lit(0)) != 0) & (F.coalesce(total_tokens, F.lit(0)) != 0), by_tokens).otherwise(loss_scale(local_n, total_n, world))


def scale_loss(loss: Column, local_n: Column, total_n: Column, local_tokens: Column, total_tokens: Column, world: int) -> Column:
    """Loss by tokens where both keys are there, even if zero, else by samples; unchanged where the total is 0."""
    tokens = local_tokens.isNotNull() & total_tokens.isNotNull()
    local, total = F.when(tokens, local_tokens).otherwise(F.coalesce(local_n, F.lit(0))), F.when(tokens, total_tokens).otherwise(F.coalesce(total_n, F.lit(0)))
    return F.when((total == 0) | F.lit(world == 0), loss).otherwise(loss * (local.cast("double") / total) * world)
