"""Row filters shared by the reports. Each returns a boolean Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _year_start(year: int) -> Column:
    # A foldable string takes the type of the column it is compared with, so the
    # same range works on DATE, TIMESTAMP and TIMESTAMP_NTZ and reaches the scan.
    return F.lit(f"{year:04d}-01-01")


def _year_runs(years: Iterable[int]) -> list[tuple[int, int]]:
    """Consecutive years merged to half-open (first, last + 1) runs."""
    runs: list[tuple[int, int]] = []
    for year in sorted({int(y) for y in years}):
        if runs and runs[-1][1] == year:
            runs[-1] = (runs[-1][0], year + 1)
        else:
            runs.append((year, year + 1))
    return runs


def period_filter(
    col: Column,
    years: Iterable[int] | None = None,
    min_year: int | None = None,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    inclusive_end: bool = False,
) -> Column:
    """Rows whose date lies in the given years, from a year on, or between two dates.

    Always a range on the raw column, which parquet statistics can use; ``year(col)``
    cannot be. ``end`` is a closed bound at midnight, so a timestamp later on that day
    is outside; ``inclusive_end=True`` takes the whole day in.
    """
    parts: list[Column] = []
    if years is not None:
        runs = [(col >= _year_start(a)) & (col < _year_start(b)) for a, b in _year_runs(years)]
        parts.append(reduce(lambda x, y: x | y, runs) if runs else F.lit(False))
    if min_year is not None:
        parts.append(col >= _year_start(min_year))
    if start is not None:
        parts.append(col >= F.lit(str(start)))
    if end is not None:
        if inclusive_end:
            day = dt.date.fromisoformat(str(end)) + dt.timedelta(days=1)
            parts.append(col < F.lit(str(day)))
        else:
            parts.append(col <= F.lit(str(end)))
    if not parts:
        raise ValueError("period_filter needs years, min_year, start or end")
    return reduce(lambda x, y: x & y, parts)


def same_period(a: Column, b: Column, grain: str = "month") -> Column:
    """Whether two dates fall in the same calendar period; NULL if either is NULL."""
    return F.trunc(a, grain) == F.trunc(b, grain)


def not_deleted(col: Column) -> Column:
    """Soft-delete test. NULL is dropped, as ``<> 1`` does."""
    return col != 1


def exclude_codes(col: Column, codes: Iterable[int | str]) -> Column:
    """Codes outside a list. NULL is dropped, as ``NOT IN`` does."""
    return ~col.isin(*codes)
