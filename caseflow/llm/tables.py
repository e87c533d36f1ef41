"""Reading tables, cutting lineage, and splitting documents into folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of this session, set up if it is not yet.

    The folder is the one in ``spark.checkpoint.dir``, so that lost executors cost only
    their running tasks. Where that is unset and the session runs inside one process, a
    new temporary folder serves; elsewhere it must be set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read back from there."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def handed_on(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet into a new folder under the shared one and read back."""
    folder = f"{shared_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``handed_on``, and the folder. The shuffle files that the writing made go with its
    end, as nothing reads them again."""
    folder = f"{shared_folder(df)}/{uuid.uuid4().hex}.parquet"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.parquet(folder), folder


def removed(df: DataFrame, folders: list[str]) -> None:
    """Deletes folders that ``written`` made and that no table still reads."""
    context = df.sparkSession.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id of null counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose working columns begin with an underscore: columns of the first
    table that do so too are given other names while the operator runs."""

    @wraps(operator)
    def run(df: DataFrame, *args, **named):
        away = {c: f"kept{i}{c}" for i, c in enumerate(df.columns) if c.startswith("_")}
        if not away:
            return operator(df, *args, **named)
        out = operator(df.withColumnsRenamed(away), *[_renamed(a, away) for a in args],
                       **{k: _renamed(a, away) for k, a in named.items()})
        if isinstance(out, DataFrame):
            out = out.withColumnsRenamed({new: old for old, new in away.items()})
        return out

    return run


def _renamed(value, names: dict[str, str]):
    if isinstance(value, list):
        return [_renamed(v, names) for v in value]
    return names.get(value, value) if isinstance(value, str) else value


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns not called like one of ``names``, in upper or lower case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
