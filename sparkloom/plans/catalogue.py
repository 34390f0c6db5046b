"""Every query of the library outside the llm subpackage, by name."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import url
from sparkloom.operators import html, trust
from sparkloom.plans.registry import QUERIES, SQL, Query
from sparkloom.session import table

for _name in ("documents", "web", "talk", "events", "graphs", "code", "typed", "intake", "reports", "gates"):
    import_module(f"sparkloom.plans.{_name}")


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language, words, links, trust score and verdict of each page."""
    page = html.pages(table(spark, sf_dir, "pages"), fields=("title", "lang", "word_count", "links", "json_ld", "hidden", "text")).withColumn("page_text", F.col("page.text"))
    score = trust.trust_score(F.col("page_text"), F.size("page.hidden"), url.scheme(F.col("url")) == "https", structured=F.size("page.json_ld") > 0)
    shown = page.select("page_id", "url", F.col("page.title").alias("title"), F.col("page.lang").alias("lang"), F.col("page.word_count").alias("word_count"), F.size("page.links").alias("n_links"), score.alias("score"))
    return shown.withColumn("verdict", trust.verdict(F.col("score")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, least trusted first."""
    return page_facts(spark, sf_dir).orderBy("score", "page_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
