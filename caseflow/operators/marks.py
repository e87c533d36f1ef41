"""Bit sets of keys, to leave out rows before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of a set: 19 MB, whatever the number of keys, in maps of 4 KB.
BITS = 1 << 27
# Seven to a byte, which is then a character of its own.
_OF_MAP = 7 * 4096


def _bit(df: DataFrame, key: str, bits: int) -> Column:
    """Whole numbers have one bit in every width, as they are equal in a join."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    return F.pmod(F.xxhash64(F.col(key).cast("bigint") if whole else key), F.lit(bits))


def key_marks(df: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The set of a key's values as rows of ``_OF_MAP`` bits: ``place`` and ``marks``.

    An aggregate of a fixed size: no task sends more than ``bits`` / ``_OF_MAP`` rows, and the
    result has no more. NULL is in no set.
    """
    marked = df.where(F.col(key).isNotNull()).select(_bit(df, key, bits).alias("_bit"))
    bit = F.expr(f"(_bit % {_OF_MAP} div 7) * 8 + _bit % 7")
    return marked.groupBy(F.expr(f"_bit div {_OF_MAP}").alias("place")).agg(
        F.bitmap_construct_agg(bit).alias("marks"))


def keep_marked(df: DataFrame, key: str, marks: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose key may be in the set; those left out are surely not.

    The set goes to every task, so rows are tested where they are read, before any shuffle.
    Where it holds many more keys than it has bits it lets everything through.
    """
    tested = df.withColumn("_bit", _bit(df, key, bits)).withColumn(
        "place", F.expr(f"_bit div {_OF_MAP}"))
    found = tested.join(F.broadcast(marks), ["place"])
    # Spark has no function for a bit of a binary: its byte as a character's number.
    byte = f"substring(marks, CAST(_bit % {_OF_MAP} div 7 AS INT) + 1, 1)"
    hit = F.expr(f"getbit(ascii(CAST({byte} AS STRING)), CAST(_bit % 7 AS INT)) = 1")
    return found.where(hit).select(*df.columns)
