"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 30


def hashed(column: str, seed: int, *more: str) -> Column:
    """A uniform number below 2**30, by the id, the seed and what ``more`` columns hold."""
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(seed), *more), F.lit(_SPAN))


def distinct_rows(*columns: str) -> Column:
    """About how many rows differ in some of these columns, within two per cent."""
    return F.approx_count_distinct(F.xxhash64(*columns), 0.02)


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(folds)


def in_fold(column: str, folds: int, held: int) -> Column:
    """Whether the id is in the fold ``held``; a null id is in none."""
    return F.coalesce(fold(column, folds) == F.lit(held), F.lit(False))


def sample_condition(column: str, most: int, total: int, seed: int, *more: str) -> Column:
    """True for about ``most`` of ``total`` different rows (all, if there are no more), chosen by a hash of the id and of ``more``; equal rows go together."""
    return F.lit(True) if total <= most else hashed(column, seed, *more) < int(_SPAN * most / total)


def sample(rows: DataFrame, column: str, most: int, total: int, seed: int) -> DataFrame:
    """The rows for which ``sample_condition`` holds."""
    return rows.filter(sample_condition(column, most, total, seed))
