"""How the labels of the tables at hand are spelt."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.semantics import DEFAULT_COLLATION, Spellings

# Columns that reports compare with fixed labels.
LABEL_COLUMNS = ("mae_estado_valor", "mae_estado_afiliacion_valor", "mae_solicitud_estado_valor",
                 "ma_tecnologia_codigo")
# A column with more spellings than this is no controlled vocabulary and is left out.
MOST_SPELLINGS = 10_000


def label_spellings(tables: Mapping[str, DataFrame], columns: Sequence[str] = LABEL_COLUMNS,
                    collation: str = DEFAULT_COLLATION) -> Spellings:
    """The collation with the spellings of label columns, read from these tables.

    One job over the columns alone; each map task sends its distinct labels, and at most
    ``MOST_SPELLINGS`` of a column come back. A column goes by its name: all tables that have
    it are read, so that the result serves each of them. It holds for these tables as they
    are now, and must be read again when rows are added.
    """
    found = [df.select(F.lit(c).alias("name"), F.col(c).alias("label")).distinct()
             for df in tables.values() for c in columns
             if dict(df.dtypes).get(c) == "string"]
    if not found:
        raise ValueError(f"no table has a text column of {list(columns)}")
    labels = reduce(DataFrame.unionAll, found).where("label IS NOT NULL").distinct()
    session = labels.sparkSession
    held: dict[str, list[str]] = {}
    for name in {row for df in tables.values() for row in df.columns} & set(columns):
        some = labels.where(F.col("name") == name).limit(MOST_SPELLINGS + 1).collect()
        if len(some) <= MOST_SPELLINGS:
            held[name] = sorted(r.label for r in some)
    return Spellings(collation, held, session)
