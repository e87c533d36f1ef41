"""Written tables: read back whole, settings put back, folders deleted."""

import os

from pyspark.sql import functions as F

from caseflow.llm import tables


def test_written_rows_come_back_and_folders_go(spark):
    before = spark.conf.get(tables.SHUFFLE_CLEANUP)
    source = spark.range(1000).groupBy((F.col("id") % 7).alias("key")).count()
    rows, folder = tables.written(source)
    assert spark.conf.get(tables.SHUFFLE_CLEANUP) == before
    assert sorted(rows.collect()) == sorted(source.collect())
    again, other = tables.written(rows.groupBy("count").agg(F.sum("key").alias("keys")))
    tables.removed(rows, [folder])
    assert not os.path.exists(folder.removeprefix("file:"))
    assert again.agg(F.sum("keys")).first()[0] == sum(range(7)) and folder != other


def test_tables_without_rows_are_written(spark):
    rows, folder = tables.written(spark.range(0).select("id"))
    assert rows.count() == 0
    tables.removed(rows, [folder])
