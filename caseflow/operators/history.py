"""Operators over append-only status logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.semantics import BINARY, ci_eq, ci_in


def _top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie_break: Sequence[str],
    where: Column | None,
    cols: Sequence[str] | None,
    ties: str,
    latest: bool,
) -> DataFrame:
    if ties not in ("one", "all"):
        raise ValueError(f"ties must be 'one' or 'all', not {ties!r}")
    keys, tie_break = list(keys), list(tie_break)
    if where is not None:
        df = df.where(where)
    payload = [c for c in (df.columns if cols is None else cols) if c not in keys]

    if ties == "all":
        # rank() = 1 keeps every tied row. Spark cuts each map task's rows to its own
        # rank 1 before the shuffle, so a hot key sends few rows.
        by_time = F.col(order).desc_nulls_last() if latest else F.col(order).asc_nulls_first()
        window = Window.partitionBy(*keys).orderBy(by_time)
        needed = list(dict.fromkeys([*keys, order, *payload]))
        ranked = df.select(*needed).withColumn("_rank", F.rank().over(window))
        return ranked.where(F.col("_rank") == 1).select(*keys, *payload)

    if set(payload) <= {order}:
        # Only the time is wanted: a plain hash aggregate, no ordering of rows at all.
        if latest:
            top = F.max(order)
        else:
            top = F.when(F.count("*") == F.count(order), F.min(order))
        grouped = df.groupBy(*keys).agg(top.alias(order))
        return grouped.select(*keys, *payload)

    if not tie_break:
        raise ValueError("tie_break is required when columns besides the order are kept")
    # Newest first with NULLs last, or oldest first with NULLs first. Spark keeps one row
    # per key of each map task before the shuffle, however hot the key.
    fields = list(dict.fromkeys([order, *tie_break, *payload]))
    if latest:
        by = [F.col(c).desc_nulls_last() for c in fields]
    else:
        by = [F.col(c).asc_nulls_first() for c in fields]
    needed = list(dict.fromkeys([*keys, *fields]))
    numbered = df.select(*needed).withColumn(
        "_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return numbered.where(F.col("_row") == 1).select(*keys, *payload)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie_break: Sequence[str],
    where: Column | None = None,
    cols: Sequence[str] | None = None,
    ties: str = "one",
) -> DataFrame:
    """The newest row per key: ``order`` descending, then ``tie_break`` descending.

    NULL times come last. ``ties='all'`` keeps every row that shares the newest time.
    ``cols`` are the columns kept beside the keys, all by default.
    """
    return _top_per_key(df, keys, order, tie_break, where, cols, ties, latest=True)


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie_break: Sequence[str],
    where: Column | None = None,
    cols: Sequence[str] | None = None,
    ties: str = "one",
) -> DataFrame:
    """The oldest row per key: ``order`` ascending, then ``tie_break`` ascending.

    A NULL time counts as the oldest, as in the source database; ``milestones`` does so
    on request.
    """
    return _top_per_key(df, keys, order, tie_break, where, cols, ties, latest=False)


def milestones(
    df: DataFrame,
    key: str | Sequence[str],
    state: str,
    ts: str,
    states: Mapping[str, str] | Sequence[str],
    agg: str = "min",
    collation: str = BINARY,
    unknown: str = "ignore",
) -> DataFrame:
    """First (or last) time each state was reached, one column per state.

    One scan and one shuffle whatever the number of states, and fixed-size partial
    results per key. ``states`` maps a state to its column name. Keys that never
    reached any of the states are absent. NULL times are ignored, or with
    ``unknown='first'`` come before all others, so that the first time is then NULL.
    """
    if unknown not in ("ignore", "first"):
        raise ValueError(f"unknown must be 'ignore' or 'first', not {unknown!r}")
    if agg not in ("min", "max"):
        raise ValueError(f"agg must be 'min' or 'max', not {agg!r}")
    names = dict(states) if isinstance(states, Mapping) else {s: s for s in states}
    keys = [key] if isinstance(key, str) else list(key)
    pick = F.min if agg == "min" else F.max

    def reached(value: str) -> Column:
        here = ci_eq(F.col(state), value, collation)
        time = pick(F.when(here, F.col(ts)))
        if unknown == "ignore" or agg == "max":
            return time
        return F.when(F.count_if(here & F.col(ts).isNull()) == 0, time)

    columns = [reached(value).alias(name) for value, name in names.items()]
    return df.where(ci_in(F.col(state), list(names), collation)).groupBy(*keys).agg(*columns)
