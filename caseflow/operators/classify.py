"""Classification of a label through a mapping table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import semantics
from caseflow.functions.semantics import DEFAULT_COLLATION
from caseflow.operators import skew


def mapping_table(spark: SparkSession, classes: Mapping[str, Sequence[str]]) -> DataFrame:
    """A (name, class) table from lists of names per class."""
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(label).alias("class"))
        for label, names in classes.items()
        for name in names
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def classify(
    df: DataFrame,
    col: str,
    mapping_df: DataFrame,
    default: str,
    name: str = "class",
    fold: bool = False,
) -> DataFrame:
    """Add the class of the upper-cased ``col``, or ``default`` if it is in no list.

    The mapping is data, joined in place of a long CASE. Its names must be unique
    (``fold=True`` also ignores accents, so unique under that rule). It is broadcast
    when its size estimate is small.
    """
    collation = DEFAULT_COLLATION if fold else semantics.BINARY
    names = mapping_df.select(
        semantics.fold(F.col("name"), collation).alias("_name"), F.col("class").alias("_class")
    )
    if skew.is_below([mapping_df], skew.BROADCAST_LIMIT):
        names = F.broadcast(names)
    wanted = semantics.fold(semantics.simple_upper(F.col(col)), collation)
    joined = df.withColumn("_name", wanted).join(names, ["_name"], "left")
    return joined.select(*df.columns, F.coalesce("_class", F.lit(default)).alias(name))
