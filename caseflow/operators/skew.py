"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with this many rows is cut into parts of about this many rows.
HOT_ROWS = 1_000_000
# Keys are first counted by hash in so many buckets, and at most so many of these and of the
# keys in them are looked at closer. A key with more than one in MAX_HOT of all rows is
# among them, for no more than MAX_HOT buckets can hold as much.
BUCKETS, MAX_HOT = 1 << 16, 1 << 12
# Rows with a NULL key match nothing; they are spread over this many parts.
NULL_PARTS = 1024
# A dimension estimated below this size is broadcast.
BROADCAST_LIMIT = 10 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate, from file and column sizes. None if there is none."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(stats.sizeInBytes())
    except (AttributeError, Py4JError):
        return None


def is_below(inputs: Sequence[DataFrame], limit: int) -> bool:
    """Whether the inputs together are known to be smaller than ``limit`` bytes."""
    sizes = [estimated_bytes(df) for df in inputs]
    return all(size is not None for size in sizes) and sum(sizes) < limit


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """The heaviest keys with at least ``min_rows`` rows and the parts to cut each into.

    The list is part of the plan of the join that uses it: nothing runs before that join
    does. A first pass over the keys adds up rows in ``BUCKETS`` buckets, a table of a fixed
    size that every map task sends its share of; a second one counts the keys of the
    heaviest buckets exactly, as they are compared, so that spellings that a collation holds
    equal are one key. With no heavy bucket, which adaptive execution finds out, the second
    pass and the join with the list fall away. The list has ``MAX_HOT`` keys at most, whatever
    the data, among them every key with more than one in ``MAX_HOT`` of the rows; it is sent
    to every task. NULL keys match nothing and are not listed.
    """
    min_rows = HOT_ROWS if min_rows is None else min_rows
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    bucket = F.pmod(F.xxhash64(*[_alike(df, k) for k in keys]), F.lit(BUCKETS)).cast("int")
    rows = df.where(known).select(*keys, bucket.alias("_bucket"))
    sketch = rows.groupBy("_bucket").agg(F.count("*").alias("_load"))
    heavy = _heaviest(sketch, "_load", min_rows).select("_bucket")
    counted = rows.join(F.broadcast(heavy), ["_bucket"], "left_semi")
    counted = counted.groupBy(*keys).agg(F.count("*").alias("_rows"))
    parts = F.ceil(F.col("_rows") / min_rows).cast("int").alias("_parts")
    return _heaviest(counted, "_rows", min_rows).select(*keys, parts)


def _heaviest(counts: DataFrame, count: str, least: int) -> DataFrame:
    others = [c for c in counts.columns if c != count]
    return counts.where(F.col(count) >= least).orderBy(F.desc(count), *others).limit(MAX_HOT)


def _alike(df: DataFrame, key: str) -> Column:
    """What is hashed of a key: all of it, or under a collation what spellings share.

    Digits and consonants are nearly always that. Spellings that differ in them are
    counted apart, which can cost balance but no rows.
    """
    kind = df.schema[key].dataType
    if not isinstance(kind, T.StringType) or kind.isUTF8BinaryCollation():
        return F.col(key)
    plain = F.lower(F.collate(key, "UTF8_BINARY"))
    return F.regexp_replace(plain, "[^0-9bdfghjklmpqrstvwxz]", "")


def _part(columns: Sequence[str | Column], keys: Sequence[str], parts: str, spread_nulls: bool) -> Column:
    """Part number of a row, from a hash of its values so that a retry repeats it."""
    row_hash = F.xxhash64(*columns)
    part = F.when(F.col(parts) > 1, F.pmod(row_hash, F.col(parts)))
    if spread_nulls:
        some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        part = part.when(some_null, F.pmod(row_hash, F.lit(NULL_PARTS)))
    return F.coalesce(part, F.lit(0).cast("long"))


def _copies(parts: str) -> Column:
    """One copy of the row per part of the other side."""
    first = F.lit(0).cast("long")
    every = F.sequence(first, (F.col(parts) - 1).cast("long"))
    return F.explode(F.when(F.col(parts) > 1, every).otherwise(F.array(first)))


def with_parts(right: DataFrame, keys: Sequence[str], hot: DataFrame,
               spread: Sequence[str | Column] | None = None) -> DataFrame:
    """The rows with ``_right_part``, the part of its key that a row is in, 0 if that is not
    hot. Parts are made from ``spread``, or else from the whole row."""
    part = _part(spread or right.columns, list(keys), "_right_parts", spread_nulls=False)
    hot = F.broadcast(hot.withColumnRenamed("_parts", "_right_parts"))
    return right.join(hot, list(keys), "left").select(*right.columns, part.alias("_right_part"))


def with_copies(left: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """The rows with a copy for each part of their key and its number, ``_right_part``.
    ``_right_parts`` has the number of copies, NULL if the key is not hot."""
    hot = F.broadcast(hot.withColumnRenamed("_parts", "_right_parts"))
    copied = left.join(hot, list(keys), "left").withColumn("_right_part", _copies("_right_parts"))
    return copied.select(*left.columns, "_right_parts", "_right_part")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_left: DataFrame | None = None,
    hot_right: DataFrame | None = None,
    spread_left: Sequence[str | Column] | None = None,
    spread_right: Sequence[str | Column] | None = None,
    keep_part: bool = False,
) -> DataFrame:
    """Equi-join on same-named ``keys`` (inner or left) that splits hot keys.

    ``hot_left`` and ``hot_right`` come from ``hot_keys``. The rows of a key that is hot
    on one side are cut into parts and each part meets a copy of the other side's rows
    for that key, so the pairs of one key are shared by parts_left x parts_right tasks.
    The result is that of the plain join. ``hot_right`` must be counted on rows that are
    all present in ``right``: a left join drops the null-padded copies of a key on the
    strength of its being there. ``hot_left`` affects balance only.

    ``spread_right`` names what the parts of a hot key of ``right`` are made from, and
    ``keep_part`` leaves the number in the result as ``_right_part``. The rows then lie by
    key and part, so that they can be grouped by these and more without a shuffle.

    Without either, the join is left to adaptive execution, which cuts what is hot on a
    side that the kind of join lets it cut: both of an inner, the left of a left join.
    """
    keys = list(keys)
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    if keep_part and hot_right is None:
        raise ValueError("there are no parts to keep without hot_right")
    if keep_part:
        columns.append("_right_part")
    if hot_left is None and hot_right is None:
        return left.join(right, keys, how).select(*columns)

    on = [*keys]
    if hot_left is not None:
        hot = F.broadcast(hot_left.withColumnRenamed("_parts", "_left_parts"))
        part = _part(spread_left or left.columns, keys, "_left_parts", spread_nulls=True)
        left = left.join(hot, keys, "left").withColumn("_left_part", part).drop("_left_parts")
        right = right.join(hot, keys, "left").withColumn("_left_part", _copies("_left_parts"))
        right = right.drop("_left_parts")
        on.append("_left_part")
    if hot_right is not None:
        right = with_parts(right, keys, hot_right, spread_right)
        left = with_copies(left, keys, hot_right)
        return join_parts(left, right, on, how).select(*columns)
    return left.join(right, on, how).select(*columns)


def join_parts(left: DataFrame, right: DataFrame, keys: Sequence[str],
               how: str = "left") -> DataFrame:
    """Join of ``with_copies`` to ``with_parts`` on ``keys`` and the part.

    A left join drops the copies that meet nothing in their part: their key is hot, and so
    has rows in some other part.
    """
    right = right.withColumn("_hit", F.lit(True))
    joined = left.join(right, [*keys, "_right_part"], how)
    if how == "left":
        joined = joined.where("_right_parts IS NULL OR _hit IS NOT NULL")
    return joined.drop("_right_parts", "_hit")
