"""Tables written so that a report reads little of them.

Histories are filed by a hash of the person, requests and what hangs on them by the month
of the request. The reports see the filing columns and test them beside their own filters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that persons are dealt out to. The number is part of the column's name, so that
# a reader knows it.
PERSON_FOLDERS = 256
_PERSON = "_person_of_"
MONTH = "_request_month"


def land_history(tables: Mapping[str, DataFrame], folder: str, person: str = "documento_afiliado",
                 folders: int = PERSON_FOLDERS) -> None:
    """Writes feeds by the person's folder and, within it, in the order of persons.

    Files are cut by ranges of folder, person and a hash of the row, so that neither a
    folder nor a person with very many rows is one task. Bloom filters on the person let a
    reader pass over row groups that hold only others. Rows without a person go to folder -1.
    """
    column = f"{_PERSON}{folders}"
    for name, df in tables.items():
        place = F.pmod(F.crc32(F.col(person).cast("binary")), F.lit(folders)).cast("int")
        filed = df.withColumn(column, F.coalesce(place, F.lit(-1)))
        filed = filed.withColumn("_row", F.xxhash64(*df.columns))
        filed = filed.repartitionByRange(column, person, "_row").sortWithinPartitions(
            column, person).drop("_row")
        filed.write.partitionBy(column).option(
            f"parquet.bloom.filter.enabled#{person}", "true").parquet(f"{folder}/{name}")


def of_person(df: DataFrame, person: str) -> Column:
    """The test on the filing column of a landed history, true for any other table."""
    for column in df.columns:
        found = re.fullmatch(f"{_PERSON}([0-9]+)", column)
        if found:
            return F.col(column) == zlib.crc32(person.encode()) % int(found[1])
    return F.lit(True)


def land_requests(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Writes requests, their authorisations and the items of these by the request's month.

    An authorisation without a request, or an item without an authorisation, goes to the
    month of NULL, as a request without a date does. A month is cut by a hash of the row.
    """
    month = F.year("fecha_solicitud") * 100 + F.month("fecha_solicitud")
    requests = tables["au_anexos3"].withColumn(MONTH, month)
    of_request = requests.select(F.col("id").alias("au_anexos3_id"), MONTH)
    granted = tables["au_anexos4"].join(of_request, ["au_anexos3_id"], "left")
    of_granted = granted.select(F.col("id").alias("au_anexos4_id"), MONTH)
    items = tables["au_anexo4_items"].join(of_granted, ["au_anexos4_id"], "left")
    for name, df in (("au_anexos3", requests), ("au_anexos4", granted),
                     ("au_anexo4_items", items)):
        spread = F.xxhash64(*tables[name].columns)
        filed = df.select(*tables[name].columns, MONTH).withColumn("_row", spread)
        filed.repartitionByRange(MONTH, "_row").drop("_row").write.partitionBy(MONTH).parquet(
            f"{folder}/{name}")


def in_months(df: DataFrame, start: str, end: str) -> Column:
    """The test on the filing column of landed requests, true for any other table."""
    if MONTH not in df.columns:
        return F.lit(True)
    first, last = (int(day[:4]) * 100 + int(day[5:7]) for day in (start, end))
    return F.col(MONTH).between(first, last)


def landed(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Landed tables, with their filing columns."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
