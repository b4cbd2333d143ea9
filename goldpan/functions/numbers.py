"""Small numeric expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(numerator: Column, denominator: Column) -> Column:
    """100 * n / d to two places; 0 when there is nothing to divide by."""
    share = F.round(F.lit(100.0) * numerator / F.nullif(denominator, F.lit(0)), 2)
    return F.coalesce(share, F.lit(0.0))


def set_f1(overlap: Column, predicted: Column, gold: Column) -> Column:
    """F1 of two sets given their sizes and the size of the overlap."""
    precision = overlap / predicted
    recall = overlap / gold
    return (
        F.when((predicted == 0) & (gold == 0), F.lit(1.0))
        .when((predicted == 0) | (gold == 0) | (overlap == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * precision * recall / (precision + recall))
    )


def row_seed(seed: int, index: Column, phase: int = 0, offset: int = 0) -> Column:
    """Deterministic per-row seed in [0, 2^31 - 1)."""
    mixed = (
        F.lit(seed * 1_000_003 + phase * 97_409 + offset).cast("bigint")
        + index.cast("bigint") * F.lit(9_176).cast("bigint")
    )
    return F.pmod(mixed, F.lit(2**31 - 1).cast("bigint"))
