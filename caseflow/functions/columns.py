"""Column expressions for the derived attributes of the reports."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.semantics import BINARY, fold, simple_upper


def decode(
    col: Column,
    mapping: Mapping[Any, Any],
    default: Any = None,
    keep_other: bool = False,
    collation: str = BINARY,
) -> Column:
    """Map codes to labels.

    A value outside ``mapping`` becomes ``default``, or stays as it is with
    ``keep_other``. NULL matches no code, so it takes the default too.
    """
    subject = fold(col, collation)
    pairs = iter(mapping.items())
    code, label = next(pairs)
    chain = F.when(subject == F.lit(code), F.lit(label))
    for code, label in pairs:
        chain = chain.when(subject == F.lit(code), F.lit(label))
    return chain.otherwise(col if keep_other else F.lit(default))


def flag(*conditions: Column, yes: str = "SI", no: str = "NO") -> Column:
    """``yes`` when every condition is true, else ``no`` (unknown counts as ``no``)."""
    return F.when(reduce(lambda a, b: a & b, conditions), F.lit(yes)).otherwise(F.lit(no))


def cleanse_text(col: Column, remove: Sequence[str], upper: bool = True) -> Column:
    """Delete each string of ``remove`` in order, after upper-casing.

    The order counts: deleting one character may join two others into a later
    pattern. Runs of single characters are deleted in one pass, and a pattern holding a
    character that is already gone is skipped, since it cannot occur.
    """
    text = simple_upper(col) if upper else col
    gone: set[str] = set()
    run = ""

    def flush(expr: Column, chars: str) -> Column:
        any_of = "[" + re.escape(chars) + "]"
        return F.regexp_replace(expr, any_of, "") if chars else expr

    for pattern in remove:
        if not pattern or gone.intersection(pattern):
            continue
        if len(pattern) == 1:
            run += pattern
            gone.add(pattern)
        else:
            text = F.replace(flush(text, run), F.lit(pattern), F.lit(""))
            run = ""
    return flush(text, run)


def wait_days(start: Column, end: Column) -> Column:
    """Calendar days from ``start`` to ``end``; the time of day does not count."""
    return F.datediff(end, start)


def as_of_column(as_of: str | dt.date | Column | None) -> Column:
    """The reference day of a report: today unless one is given."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def age_years(
    birth: Column,
    as_of: str | dt.date | Column | None = None,
    year_days: float | str = 365.25,
) -> Column:
    """Whole years between two days, truncated toward zero.

    The division is decimal, so an exact number of years is never rounded down.
    """
    days = F.datediff(as_of_column(as_of), birth).cast("decimal(10,0)")
    return (days / F.lit(Decimal(str(year_days)))).cast("int")


def geo_code(department_prefix: Column, municipality_prefix: Column) -> Column:
    """Administrative code; NULL if either prefix is missing."""
    return F.concat(department_prefix, municipality_prefix)


def coalesce_milestones(cols: Mapping[str, Column], order: Sequence[str]) -> Column:
    """The first non-NULL of the named dates, taken in ``order``."""
    return F.coalesce(*[cols[name] for name in order])


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Rename columns to display labels, which may hold spaces and accents."""
    unknown = set(labels) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.withColumnsRenamed(dict(labels))
