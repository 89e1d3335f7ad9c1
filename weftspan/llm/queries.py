"""The queries of this folder, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grid_order, hmm_lm, langid, licenses, line_rules, mixing, ngram_join, packing, pii, quality_model
from ._shared import prepare, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(prepare(spark), sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(prepare(spark), sf_dir, "documents"))


def op4_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order.near_duplicates(table(prepare(spark), sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), ~langid.held_out(3, 1))
    return quality_model.score(docs, model).select("doc_id", langid.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(prepare(spark), sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out(4, 2))
    return langid.predict(docs, model).select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return line_rules.apply_rules(docs, line_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model, counts = hmm_lm.fit(docs, ~langid.held_out(5, 1))
    return hmm_lm.score(docs, model, counts).select("doc_id", langid.held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_ngram_jaccard, op4_grid_order, op5_quality_classifier, op6_source_mixing, op7_personal_data, op8_language_id, op9_quality_rules, op10_hidden_markov_lm)
}
ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op3_ngram_jaccard": ngram_join.oracle(), "op4_grid_order": grid_order.oracle(), "op6_source_mixing": mixing.oracle()}
