"""Milestones and newest rows kept as state that a day's log entries are merged into.

A state is a table with one row per key. States of parts of a log merge into the state of
the whole in any order, and a part that comes late or twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.semantics import BINARY, ci_eq, ci_in
from caseflow.operators.history import latest_per_key

_UNKNOWN = "_unknown"


def milestone_state(df: DataFrame, keys: Sequence[str], state: str, ts: str,
                    states: Mapping[str, str], collation: str = BINARY) -> DataFrame:
    """Per key and state the earliest known time, and whether an entry has no time."""
    columns = []
    for value, name in states.items():
        here = ci_eq(F.col(state), value, collation)
        columns += [F.min(F.when(here, F.col(ts))).alias(name),
                    F.coalesce(F.bool_or(here & F.col(ts).isNull()), F.lit(False))
                    .alias(name + _UNKNOWN)]
    return df.where(ci_in(F.col(state), list(states), collation)).groupBy(*keys).agg(*columns)


def merge_milestones(states: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The state of all parts together: one shuffle of a row per key and part at most."""
    both = reduce(DataFrame.unionByName, states)

    def merged(name: str) -> Column:
        pick = F.bool_or if name.endswith(_UNKNOWN) else F.min
        return pick(name).alias(name)

    return both.groupBy(*keys).agg(*[merged(c) for c in both.columns if c not in keys])


def milestones_of(state: DataFrame, keys: Sequence[str], unknown: str = "ignore") -> DataFrame:
    """What ``milestones`` gives for all entries that went into the state."""
    if unknown not in ("ignore", "first"):
        raise ValueError(f"unknown must be 'ignore' or 'first', not {unknown!r}")
    names = [c for c in state.columns if c not in keys and not c.endswith(_UNKNOWN)]
    if unknown == "ignore":
        return state.select(*keys, *names)
    return state.select(*keys, *[F.when(~F.col(n + _UNKNOWN), F.col(n)).alias(n) for n in names])


def merge_latest(states: Sequence[DataFrame], keys: Sequence[str], order: str,
                 tie_break: Sequence[str]) -> DataFrame:
    """Newest rows of all parts from the newest rows of each; a row that comes twice stays one.

    The states are results of ``latest_per_key`` that keep ``order`` and ``tie_break``.
    """
    return latest_per_key(reduce(DataFrame.unionByName, states), keys, order, tie_break)


class StateTable:
    """A state in a folder: a merged base, and the state of each batch since.

    ``add`` writes a batch under its name, which is replaced if it is added again, so that a
    job may be repeated. Names must sort in the order of the batches, as dates do.
    ``compact`` merges what is there into a new base; a batch up to it can then no longer be
    added under its old name. Nothing that is read is ever overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str,
                 merge: Callable[[Sequence[DataFrame]], DataFrame]):
        self.spark, self.folder, self.merge = spark, folder.rstrip("/"), merge

    def _parts(self, kind: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def _base_batch(self) -> str:
        base = self._parts("base")
        return "" if base is None else base.agg(F.max("_batch")).first()[0] or ""

    def add(self, batch: str, state: DataFrame) -> None:
        # The letter in front keeps Spark from reading a name such as 01 as a number.
        batch = f"b{batch}"
        if batch <= self._base_batch():
            raise ValueError(f"batch {batch[1:]!r} is not after the last one merged")
        state.write.mode("overwrite").parquet(f"{self.folder}/batches/_batch={batch}")

    def _live(self) -> list[DataFrame]:
        upto, base, batches = self._base_batch(), self._parts("base"), self._parts("batches")
        parts = [] if base is None else [base.where(F.col("_batch") == upto)]
        parts += [] if batches is None else [batches.where(F.col("_batch") > upto)]
        return [p.drop("_batch") for p in parts]

    def read(self) -> DataFrame:
        """The state of all batches."""
        parts = self._live()
        if not parts:
            raise ValueError(f"no batch was added to {self.folder}")
        return self.merge(parts)

    def compact(self) -> None:
        batches = self._parts("batches")
        newest = None if batches is None else batches.agg(F.max("_batch")).first()[0]
        if newest and newest > self._base_batch():
            self.read().write.parquet(f"{self.folder}/base/_batch={newest}")
