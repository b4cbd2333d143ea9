"""Token-array expressions: labels, masks, trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: label of a position that carries no loss.
IGNORED_LABEL = -100


def mean_finite(values: Column) -> Column:
    """Mean of the finite entries; null when there are none."""
    finite = F.filter(
        values,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    total = F.aggregate(finite, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(finite) > 0, total / F.size(finite))


def is_strict_prefix(prompt: Column, full: Column) -> Column:
    return (F.size(full) > F.size(prompt)) & (
        F.slice(full, F.lit(1), F.size(prompt)) == prompt
    )


def completion_labels(prompt: Column, full: Column) -> Column:
    """Prompt positions masked, completion positions kept."""
    kept = F.slice(full, F.size(prompt) + 1, F.size(full) - F.size(prompt))
    masked = F.array_repeat(F.lit(IGNORED_LABEL).cast("bigint"), F.size(prompt))
    return F.concat(masked, kept)


def supervised_count(labels: Column) -> Column:
    """Labels that carry loss after the shift by one position."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.size(F.filter(shifted, lambda x: x != IGNORED_LABEL))


def first_end_position(tokens: Column, end_ids: Sequence[int]) -> Column:
    """1-based position of the first end token; null when absent."""
    found = [F.nullif(F.array_position(tokens, F.lit(e).cast("bigint")), F.lit(0)) for e in end_ids]
    return F.array_min(F.filter(F.array(*found), lambda p: p.isNotNull()))


def trim_at_end(tokens: Column, end_ids: Sequence[int]) -> Column:
    """Struct(tokens, truncated): everything through the first end token."""
    cut = first_end_position(tokens, end_ids).cast("int")
    return F.struct(
        F.coalesce(F.slice(tokens, F.lit(1), cut), tokens).alias("tokens"),
        cut.isNull().alias("truncated"),
    )


def completion_mask(
    tokens: Column, end_ids: Sequence[int], exclude_truncated: bool = True
) -> Column:
    """1 through the first end token, else 0; cut-off rows are all 0 (or all 1)."""
    cut = first_end_position(tokens, end_ids)
    without_end = F.lit(0 if exclude_truncated else 1)
    return F.transform(
        tokens,
        lambda _, i: F.when(cut.isNull(), without_end).when(i < cut, F.lit(1)).otherwise(F.lit(0)),
    )
