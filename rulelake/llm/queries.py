"""The registered queries of this subpackage: thin callers of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, instances, language, lengths, packing, repeats, resample, secrets, signature, throttle, toolcalls, urlfilter
from .storage import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target token proportions of the query, by source; sources that are not listed have the least of them.
TARGETS = {f"src{i}": 1.0 + i % 4 for i in range(20)}


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), targets=TARGETS)


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(documents(spark, sf_dir)))


def op2_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return toolcalls.link(toolcalls.calls_of(turns), toolcalls.results_of(turns), toolcalls.SCHEMAS)


def op6_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge(urlfilter.captures_of(pages), urlfilter.events_of(pages)).drop("url")


def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature.similar_groups(documents(spark, sf_dir), words=3, percent=90)


def op4_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs.where(~language.held_out())))


def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.rules(documents(spark, sf_dir))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return instances.scores(docs, instances.train(docs, _table(spark, sf_dir, "labels")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op13_click_throttling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.settle(_table(spark, sf_dir, "clicks"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_linking": toolcalls.SQL, "op6_temporal_lists": urlfilter.SQL, "op12_importance_resampling": resample.SQL}
