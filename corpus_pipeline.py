"""A corpus pipeline of five operators: quality, near-duplicates, exact repeats, benchmark contamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import quality
from tarnwell.llm.common import small_side, text_key, written
from tarnwell.llm.decontam import decontaminate
from tarnwell.llm.near_dups import near_duplicates
from tarnwell.llm.packing import pack
from tarnwell.llm.repeats import without_repeats


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; null and empty texts are scored as empty texts, null ids stay rows."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of repeated rows one stays.

    A decision holds for an id with its text, so an id that stands on several texts loses only those that are near copies;
    of linked texts that share their group's smallest id one stays.  Documents without words and with a null id stay.
    """
    found = written(near_duplicates(docs), "found")
    gone = written(found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct(), "gone")
    key = text_key(F.col("text"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__h1": key["h1"], "__h2": key["h2"]})
    left = keyed.join(small_side(gone), ["__id", "__h1", "__h2"], "left_anti")
    linked = found.where("kept and doc_id is not null and group_class is not null")
    twice = linked.groupBy("doc_id", "group_class").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("one")).where("n > 1")
    again = linked.join(twice, ["doc_id", "group_class"]).select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), ((F.col("h1") == F.col("one.h1")) & (F.col("h2") == F.col("one.h2"))).alias("__one")).distinct()
    again = written(again, "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    ones = left.join(small_side(again.where("__one")), ["__id", "__h1", "__h2"], "left_semi").dropDuplicates(["__id", "__h1", "__h2"])
    return left.join(small_side(again), ["__id", "__h1", "__h2"], "left_anti").union(ones).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that occur more than once go; every document stays, with n_chars of what is left (null: null)."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go; texts without words stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = written(found.where("contaminated").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct(), "contaminated")
    key = text_key(F.col("text"))
    return docs.withColumns({"__h1": key["h1"], "__h2": key["h2"]}).join(small_side(gone), ["__h1", "__h2"], "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; a null text is packed as an empty one."""
    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good_quality), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack_documents)]
#: SQL cannot express the classifier, the signatures, the suffix arrays and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written before the next; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
