"""Many texts of a row as one, for the way through a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Between two texts, and in place of a NULL. Rows with either in a text are not packed.
_AFTER, _NULL = "\x01", "\x02"


def pack_texts(df: DataFrame, texts: Sequence[str], name: str) -> DataFrame:
    """The rows with ``texts`` as one text ``name``.

    Spark's rows have a word for each column and round each text up to words, and a shuffle's
    compression is a quick one: packed, wide rows take about half as much of a shuffle. A row
    whose texts hold a mark keeps them as they are, in an array that is NULL otherwise.
    """
    bare = F.concat_ws("", *texts)
    marked = bare.contains(_AFTER) | bare.contains(_NULL)
    rest = [c for c in df.columns if c not in texts]
    return df.select(
        *rest, F.when(~marked, F.array_join(F.array(*texts), _AFTER, _NULL)).alias(name),
        F.when(marked, F.array(*texts)).alias(f"{name}_as_is"))


def unpack_texts(df: DataFrame, texts: Sequence[str], name: str) -> DataFrame:
    """The texts that ``pack_texts`` has made one, in the same order; all are NULL where the
    packed text is NULL, as after a left join."""
    rest = [c for c in df.columns if c not in (name, f"{name}_as_is")]
    as_is = F.col(f"{name}_as_is")
    split = df.select(*rest, as_is, F.split(name, _AFTER).alias(name))

    def text(place: int) -> Column:
        return F.when(as_is.isNotNull(), as_is[place]).otherwise(
            F.nullif(F.col(name)[place], F.lit(_NULL)))

    return split.select(*rest, *[text(i).alias(c) for i, c in enumerate(texts)])
