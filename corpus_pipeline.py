"""From raw documents to a training mixture, stage by stage.

Each stage takes the session, the documents its predecessor kept and the folder of the
other tables, and returns the documents it keeps, with the same columns; the last adds how
often each is to be taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import decontaminate, line_chunks, mixing, queries, simhash, toxicity
from caseflow.llm.tables import fold, handed_on, read, saved  # noqa: F401 (saved: for tests)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# The columns of ``documents``; a stage hands on any others untouched.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def with_other_columns(stage: Stage) -> Stage:
    """Columns beyond those of ``documents`` are out of a stage's way under other names."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENTS}
        kept = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return kept.withColumnsRenamed({new: old for old, new in away.items()})

    return run_stage


@with_other_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, learnt from the labelled ones.

    A null text scores as an empty one does. Rows that repeat, and rows of one id, are scored
    one by one, so equal texts stay or go together. Whole texts are scored, however long.
    Where nothing could be learnt, for want of labelled documents, all stay.
    """
    labels = read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    weights, bias = toxicity.fit(docs, labels)
    if not weights.any() and not bias:
        return docs
    scored = toxicity.score(docs, weights, bias, name="_score")
    return scored.where("_score < 0.5").select(*docs.columns)


@with_other_columns
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks that stand in an earlier place already.

    No row goes: a text all of whose lines go becomes empty, null and empty texts stay as they
    are. The smallest id keeps a chunk, rows that share it keep it alike, and a null id only
    if all ids that have the chunk are null. ``n_chars`` is counted anew where lines went.
    """
    edited = line_chunks.remove_repeated(docs, removed="_removed", lines="_lines")
    length = F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return edited.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(
        *docs.columns)


@with_other_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose SimHash fingerprints are linked.

    Null and empty texts have the fingerprint zero and make one group with all that are linked
    to it. One row stays of each group, also where ids repeat or are null. Whole texts count.
    """
    return simhash.drop_near_duplicates(docs)


@with_other_columns
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty are in benchmark passages.

    Null and empty texts have no words and stay, as do all where the benchmark is empty. Rows
    are judged one by one, so repeats stay or go together. Whole texts are judged.
    """
    found = decontaminate.matches(docs, read(spark, sf_dir, "benchmark"), words="n_words",
                                  found="matches")
    return decontaminate.with_contamination(found).where("NOT contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with domain, ``n_tokens`` and ``copies``, which replace
    columns of those names.

    A null language or source is a leaf of its own. Texts without words take none of a budget.
    Where ids tie in the seeded order, which rows that repeat do, they are taken or left
    together. An empty table gives an empty mixture.
    """
    return mixing.mix(docs, queries.MIX_LEVELS, queries.MIX_WEIGHTS,
                      queries.MIX_PERCENT, seed=queries.MIX_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# SQL has neither the learnt weights nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is written as Parquet before the
    next begins, and stays in the checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, handed_on(docs) if number else docs, sf_dir)
    return docs
