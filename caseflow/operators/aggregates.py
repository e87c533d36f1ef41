"""Grouped counts and tagged unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.semantics import (
    BINARY,
    DEFAULT_COLLATION,
    fold,
    has_no_plain,
    joined_texts,
    plain_of,
)

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4}


def count_by(
    df: DataFrame,
    dims: Sequence[str | Column],
    non_null: str | None = None,
    name: str = "n",
    weight: str | None = None,
    collation: str = BINARY,
    spelt_first: bool = True,
) -> DataFrame:
    """Rows per group, or rows with a value in ``non_null``.

    Under a ``collation`` other than binary, spellings of a text dimension that it holds
    equal are one group, shown as the smallest of them in binary order. Spellings are
    counted first, by each map task, so that few rows are folded; ``spelt_first=False``
    saves that where groups have a few rows only.

    ``weight`` sums a column of counts made earlier, so that a hot group can be
    counted before a join and finished after it.
    """
    if weight is not None:
        measure = F.sum(weight)
    else:
        measure = F.count("*" if non_null is None else non_null)
    if collation == BINARY:
        return df.groupBy(*dims).agg(measure.alias(name))
    keys = df.select(*dims).columns
    if spelt_first:
        df = df.groupBy(*dims).agg(measure.alias(name))
        measure = F.sum(name)
    else:
        measured = F.lit(1) if non_null is None else F.col(non_null)
        df = df.select(*dims, (measured if weight is None else F.col(weight)).alias("_measured"))
        measure = (F.count if weight is None else F.sum)("_measured")
    texts = [f.name for f in df.schema.fields
             if f.name in keys and isinstance(f.dataType, T.StringType)]
    rest = [c for c in keys if c not in texts]
    folded, alike = _with_alike(df, texts, collation)
    grouped = folded.groupBy(*rest, *alike).agg(
        measure.alias(name), *[F.min(c).alias(c) for c in texts])
    return grouped.select(*keys, name)


def distinct_rows(df: DataFrame, collation: str = BINARY, spelt_first: bool = True,
                  alike: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Distinct rows; under a ``collation`` other than binary, rows whose texts it holds
    equal are one, each of its texts shown in the smallest spelling in binary order.

    Rows are sorted by their other columns before any text. Where they already lie by some
    of these, they are not shuffled. Equal spellings go first, in each map task, so that few
    rows are folded; ``spelt_first=False`` saves that, and a shuffle, where few are equal.

    ``alike`` names columns that ``plain_key`` made of some of the texts where there were
    fewer rows, and these texts; the columns are not in the result.
    """
    alike = alike or {}
    columns = [c for c in df.columns if c not in alike]
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if collation == BINARY or not texts:
        return df.select(*columns).distinct()
    rest = [c for c in columns if c not in texts]
    keyed = {c for made in alike.values() for c in made}
    folded, keys = _with_alike(df.distinct() if spelt_first else df,
                               [c for c in texts if c not in keyed], collation)
    for key, made in alike.items():
        folded = folded.withColumn(f"{key}_others", _others(key, made, collation))
        keys = [*keys, key, f"{key}_others"]
    # Of the text itself, min_by is min, at twice the price; beside min alone, Spark would leave
    # out the first step.
    smallest = [(F.min_by(c, c) if spelt_first and c == texts[0] else F.min(c)).alias(c)
                for c in texts]
    return folded.groupBy(*rest, *keys).agg(*smallest).select(*columns)


def plain_key(df: DataFrame, texts: Sequence[str], name: str) -> DataFrame:
    """The rows with a column of the plain spellings of all ``texts``, the same where the
    default collation holds all of them equal; NULL if a character has no plain spelling."""
    spelt = df.withColumn("_joined", joined_texts(texts)).withColumn(
        "_spelt", plain_of(F.col("_joined")))
    return spelt.select(*df.columns, F.when(~has_no_plain(F.col("_spelt")), F.col("_spelt"))
                        .alias(name))


def _others(key: str, texts: Sequence[str], collation: str) -> Column:
    return F.when(F.col(key).isNull(), F.array(*[fold(F.col(c), collation) for c in texts]))


def _with_alike(df: DataFrame, texts: Sequence[str],
                collation: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns that agree where the collation holds all of ``texts`` equal,
    and the names of these columns.

    Rows are sorted by them, and comparing under a collation costs much more than comparing
    bytes. Under the default collation a row therefore gets one binary key of the plain
    spellings of its texts. Only a row with a character that has no plain spelling, which
    equals no row without such, keeps its texts to be compared under the collation.
    """
    if not texts:
        return df, []
    if collation.upper() != DEFAULT_COLLATION:
        folded = {f"_{c}": fold(F.col(c), collation) for c in texts}
        return df.withColumns(folded), list(folded)
    keyed = plain_key(df, texts, "_key")
    return keyed.withColumn("_others", _others("_key", texts, collation)), ["_key", "_others"]


def tagged_union(branches: Mapping[str, DataFrame], tag_col: str) -> DataFrame:
    """UNION ALL of the branches with a constant tag per branch.

    Columns are matched by name and the first branch sets their order and types. A
    branch with other columns, or with a type that would not fit, is refused when the
    plan is built rather than when it runs.
    """
    first = next(iter(branches.values()))
    fields = {f.name: f.dataType for f in first.schema.fields}
    tagged = []
    for tag, df in branches.items():
        if set(df.columns) != set(fields):
            odd = sorted(set(df.columns) ^ set(fields))
            raise ValueError(f"branch {tag!r} differs in columns {odd}")
        columns = []
        for name, wanted in fields.items():
            found = df.schema[name].dataType
            if found == wanted or isinstance(found, T.NullType) or _fits(found, wanted):
                columns.append(F.col(name).cast(wanted))
            else:
                raise TypeError(
                    f"branch {tag!r}: {name} is {found.simpleString()}, "
                    f"the first branch has {wanted.simpleString()}"
                )
        tagged.append(df.select(*[c.alias(n) for c, n in zip(columns, fields)],
                                F.lit(tag).alias(tag_col)))
    return reduce(DataFrame.unionByName, tagged)


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    a, b = _WIDTH.get(type(found)), _WIDTH.get(type(wanted))
    return a is not None and b is not None and a <= b
