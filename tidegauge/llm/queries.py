"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import (
    decontamination, html_wrappers, language, line_dedup, lm_scoring, near_dedup, packing, periodic_runs, quality, ranked_search,
    secrets, topk, url_trust)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_url_trust(spark, sf_dir):
    return url_trust.judge(table(spark, sf_dir, "pages"), url_trust.RULES)


@query
def op2_topk_pivots(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op4_secret_battery(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op6_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op7_dart_minhash(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query
def op8_cross_entropy(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality_labels(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_decontaminate(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_html_wrappers(spark, sf_dir):
    return html_wrappers.report(table(spark, sf_dir, "pages"))


@query
def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.report(periodic_runs.find_runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op1_url_trust"] = url_trust.ORACLE
ORACLES["op2_topk_pivots"] = topk.ORACLE
ORACLES["op10_decontaminate"] = decontamination.ORACLE
ORACLES["op11_ranked_search"] = ranked_search.ORACLE
