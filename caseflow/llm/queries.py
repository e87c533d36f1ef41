"""Each operator over the whole table it is meant for, as a registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import (
    chat,
    decontaminate,
    license_scan,
    line_chunks,
    max_sketch,
    mixing,
    quality,
    simhash,
    suffix_tree,
    topk,
    toxicity,
    url_rules,
    vector_codes,
)
from caseflow.llm.tables import fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows.where(F.pmod("vec_id", F.lit(50)) == 0), rows, 5)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").where(fold("doc_id", 5) != 0)
    weights, bias = toxicity.fit(docs, labels)
    held_out = (fold("doc_id", 5) == 0).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, weights, bias).select("doc_id", held_out, "score", predicted)


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, read(spark, folder, "benchmark"), keep=["doc_id"])
    found = decontaminate.with_contamination(found)
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias(
        "n_items"), listed, "contaminated")


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.perspectives(read(spark, folder, "conversations"))
    spans = F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"]))
    return views.withColumn("mask", F.array_join(spans, ","))


# The tree of the mixture. Sources are grouped into domains by their number.
MIX_LEVELS = {
    "domain": "'domain' || try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS bigint) % 3",
    "lang": "lang",
    "source": "source",
}
MIX_WEIGHTS = {
    "domain": {"domain0": 2, "domain1": 5, "domain2": 3},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}
# The mixture's size, in hundredths of all tokens, and the seed of its orders.
MIX_PERCENT, MIX_SEED = 80, 13


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, MIX_PERCENT, seed=MIX_SEED)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


# Host, path and verdict of each rule.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, folder, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return line_chunks.remove_repeated(docs).select("doc_id", "text", "n_lines", "n_removed")


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    scores = suffix_tree.score(docs, fold("doc_id", 5) != 1)
    held_out = (fold("doc_id", 5) == 1).alias("held_out")
    return scores.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "labels").where(fold("doc_id", 3) != 1)
    scores = quality.quality_scores(read(spark, folder, "documents"), labels)
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scores.select("doc_id", held_out, "score", predicted)


def op11_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.licenses(read(spark, folder, "documents").select("doc_id", "text"))
    named = len(license_scan.PHRASES)
    base = F.filter("spans", lambda s: s["template"] < named)
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        _listed("base.label").alias("base_labels"), _listed("spans.label").alias("labels"),
        F.coalesce(F.array_max("spans.share"), F.lit(0.0)).alias("score"))


def _listed(labels: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    index = max_sketch.build(read(spark, folder, "documents").select("doc_id", "text"))
    return max_sketch.search(index, read(spark, folder, "benchmark"), 50)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.coded(read(spark, folder, "embeddings"), parts=8, entries=16, rounds=6,
                              scale=4096)


QUERIES: dict[str, Query] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_source_mixing": op6_source_mixing,
    "op7_url_filters": op7_url_filters,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_model": op9_language_model,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_license_scans": op11_license_scans,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}
