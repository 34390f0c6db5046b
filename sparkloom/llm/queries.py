"""One query for each operator, over its whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import oracles
from sparkloom.llm.common import table
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.language import identify
from sparkloom.llm.linededup import dedup_runs
from sparkloom.llm.media import media_digests
from sparkloom.llm.mixing import mix
from sparkloom.llm.neardup import near_classes
from sparkloom.llm.pii import pii_report
from sparkloom.llm.quality import score_quality
from sparkloom.llm.sharding import assign_shards
from sparkloom.llm.urls import judge

Query = Callable[[SparkSession, str], DataFrame]


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document: equal and near copies share the least doc_id among them."""
    return near_classes(table(spark, sf_dir, "documents")).drop("tid")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the runs of two or more lines that stand earlier in the corpus."""
    return dedup_runs(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards, and in one of nine."""
    return assign_shards(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that are not held out."""
    return identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken for three fifths of all tokens, shared equally down the tree, in up to two epochs."""
    return mix(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's bytes as samples of a media file, carved by signature and read back."""
    return media_digests(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url, by rules and then by trees learned from the urls the rules label."""
    return judge(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of ten words of the benchmark."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from its own evidence and that of its source and language there."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    return pii_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op") and callable(query)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
