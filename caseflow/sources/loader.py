"""Loading of the source tables with checked schemas."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    FractionalType,
    IntegralType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from caseflow.sources.schemas import COLUMN_ALIASES, registry, table_names


def conform(df: DataFrame, schema: StructType, aliases: Mapping[str, str] | None = None,
            name: str = "table") -> DataFrame:
    """The schema's columns, in its order and types; other columns are dropped.

    Casts happen here once, so that no report compares a string with a number. A value
    that cannot be cast fails the job under ANSI mode instead of turning into NULL, and so
    does one that would lose by it: a time of day made a date, a fraction made an integer.
    """
    for found, canonical in (aliases or {}).items():
        if found in df.columns and canonical not in df.columns:
            df = df.withColumnRenamed(found, canonical)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
    found = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_cast(f, found[f.name], name) for f in schema.fields])


def _cast(field: StructField, found: DataType, table: str) -> Column:
    """The column in its type; values that the type cannot hold whole fail the job."""
    column = F.col(f"`{field.name}`")
    if found == field.dataType:
        return column
    cast = column.cast(field.dataType)
    whole = isinstance(field.dataType, IntegralType) and isinstance(found, FractionalType)
    day = isinstance(field.dataType, DateType) and isinstance(
        found, (TimestampType, TimestampNTZType))
    if whole or day:
        message = F.concat(F.lit(f"{table}.{field.name} would lose by a cast: "),
                           column.cast("string"))
        cast = F.when(cast.cast(found) != column, F.raise_error(message).cast(
            field.dataType)).otherwise(cast)
    return cast.alias(field.name)


def load_tables(
    spark: SparkSession,
    source: str | Mapping[str, Any] | None = None,
    names: Iterable[str] | None = None,
    namespace: str | None = None,
    schemas: Mapping[str, StructType] | None = None,
    fmt: str = "parquet",
    partitions: Mapping[str, Mapping[str, Any]] | None = None,
    single_task: Collection[str] = (),
) -> dict[str, DataFrame]:
    """Tables by name, from a folder, the catalog or a JDBC database.

    ``source`` is a folder holding one sub-folder or ``<name>.<fmt>`` file per table, a
    mapping of JDBC options (``url``, ``driver``, ...), or None for catalog tables.
    ``namespace`` qualifies the name in the catalog or the database. For JDBC,
    ``partitions`` gives per table the ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` of the parallel read. Without it a whole table
    would come through one task, which is refused unless ``single_task`` names the table.
    """
    schemas = registry() if schemas is None else schemas
    tables = {}
    for name in table_names() if names is None else names:
        qualified = f"{namespace}.{name}" if namespace else name
        if source is None:
            df = spark.table(qualified)
        elif isinstance(source, str):
            df = _read_folder(spark, source, name, fmt)
        else:
            if name not in (partitions or {}) and name not in single_task:
                raise ValueError(f"give partitions for {name}, or name it in single_task")
            options = {**source, **(partitions or {}).get(name, {})}
            df = spark.read.format("jdbc").options(dbtable=qualified, **options).load()
        tables[name] = conform(df, schemas[name], COLUMN_ALIASES.get(name), name)
    return tables


def _read_folder(spark: SparkSession, folder: str, name: str, fmt: str) -> DataFrame:
    """The sub-folder or file of a table; having both is refused, as one repeats the other."""
    path = f"{folder.rstrip('/')}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [p for p in (path, f"{path}.{fmt}")
             if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if len(found) != 1:
        raise ValueError(f"{name} is there {len(found)} times in {folder}, not once")
    return spark.read.format(fmt).load(found[0])
