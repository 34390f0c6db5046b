"""From raw documents to sharded training text, in five stages.

Each stage takes (spark, docs, sf_dir), where docs are what its predecessor returned, and works on all of them. All but
the last return the columns of documents. A row is known by its id and its text together, so repeated ids do no harm.

Defined results, in every stage: null ids and null columns take part; a null text and one without letters go in the first
stage, as no language can be told; equal rows stand or fall together, and of equal texts the near-copy stage keeps the one
of least id, once; ties are settled as the operators say; an empty table stays empty; very long texts are worked on whole;
extra columns, whatever their names, are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, cut, free_name, table
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.language import UNKNOWN, learn, predict
from sparkloom.llm.mixing import mix
from sparkloom.llm.neardup import near_classes, text_key
from sparkloom.llm.sharding import assign_shards

#: Part of the tokens that mixing takes, each document once at most.
MIX_SHARE = 0.8


def _key(doc_id: Column, tid: Column) -> Column:
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.hex(tid), F.lit("null")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    name = free_name(docs, "row_key")
    return docs.withColumn(name, _key(F.col("doc_id"), text_key(F.col("text").cast("string")))), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; a missing language is filled in."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    known = predict(docs, learn(docs), "text", pred, score).filter(F.col(pred) != UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id in each class of near copies, and every null text.

    Documents without ids stay only if their class has no id at all, once for each text.
    """
    classes = cut(near_classes(docs))
    stays = F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()) | F.col("tid").isNull()
    classes = classes.select(_key(F.col("doc_id"), F.col("tid")).alias("k"), "tid", stays.alias("stays"))
    keyed, key = _keyed(docs)
    gone = broadcast_if_small(classes.filter(~F.col("stays")).select(F.col("k").alias(key)).distinct())
    kept = keyed.join(gone, key, "left_anti")
    again = cut(classes.filter("stays and tid is not null").groupBy("k").count().filter("count > 1").select(F.col("k").alias(key)))
    if not again.isEmpty():
        again = broadcast_if_small(again)
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    keyed, key = _keyed(docs)
    found = decontaminate(keyed, table(spark, sf_dir, "benchmark"), doc_id=key)
    leaks = broadcast_if_small(cut(found.filter("contaminated").select(key).distinct()))
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for ``MIX_SHARE`` of all tokens, shared equally down the tree of domain, language and source."""
    keyed, key = _keyed(docs)
    taken = broadcast_if_small(cut(mix(keyed, doc_id=key, share=MIX_SHARE, epochs=1).select(key).distinct()))
    return keyed.join(taken, key, "left_semi").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return assign_shards(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: Order MinHash and the language profiles are beyond SQL; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
