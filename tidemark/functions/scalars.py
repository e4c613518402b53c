"""Scalar expressions with missing values as null: never NaN, infinity or an error on zero."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def first_present(columns: Iterable[str], names: Sequence[str]) -> Column | None:
    """Coalesce of those ``names`` that are among ``columns``; None if none is."""
    have = set(columns)
    found = [F.col(n) for n in names if n in have]
    return F.coalesce(*found) if found else None


def sign_test(x: Column, positive: bool = True) -> Column:
    """1.0 if x > 0 (or < 0), else 0.0; null stays null."""
    return F.when(x.isNotNull(), ((x > 0) if positive else (x < 0)).cast("double"))


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum that skips nulls; null if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def finite(x: Column) -> Column:
    """Infinities and NaN become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def inverse_if_positive(x: Column) -> Column:
    return F.when(x > 0, 1 / x)


def month(date: Column) -> Column:
    """The first day of the month."""
    return F.trunc(date, "MM")


def thirds(x: Column) -> Column:
    """low for [0, 1/3], mid for (1/3, 2/3], high for (2/3, 1]; null elsewhere."""
    return F.when((x >= 0) & (x <= 1 / 3), "low").when((x > 1 / 3) & (x <= 2 / 3), "mid").when((x > 2 / 3) & (x <= 1), "high")


def to_number(x: Column, fill: float | None = None) -> Column:
    """Double where the value reads as one, else null or ``fill``."""
    number = finite(x.try_cast("double"))
    return number if fill is None else F.coalesce(number, F.lit(fill))
