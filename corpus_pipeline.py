"""From raw documents to token files: quality, near-duplicates, benchmark passages, mixing, token IDs.

Each stage works on all that the one before it kept, takes (spark, docs, sf_dir) and returns a DataFrame; run()
writes each as Parquet into the shared folder and reads it again. All stages but the last return the columns of
documents. A table without rows passes through every stage; nulls, empty texts and repeated rows follow the
operators' own rules; extra columns of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivana.llm import decontaminate, mixing, neardup, quality, tokens
from scrivana.llm.common import Scratch, free_name
from scrivana.llm.queries import WEIGHTS, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade."""
    model = quality.train(spark, docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.score(spark, docs, model, at_least=2).where(free_name(docs, "selected")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, once.

    Rows of one id with unlike texts are documents of their own. Rows without an id can't be grouped and stay.
    """
    scratch = Scratch(spark, "one-of-each-group")
    groups = scratch.put("groups", neardup.near_duplicates(spark, docs))
    id_, its_text = free_name(docs, "kept_id"), free_name(docs, "its_text")
    least = groups.where("kept").groupBy("component_id", "component").agg(F.min("its_text").alias(its_text))
    kept = scratch.put("kept", least.select(F.col("component_id").alias(id_), its_text).distinct())
    again = scratch.put("again", groups.groupBy(F.col("doc_id").alias(id_), F.col("its_text").alias(its_text)).count().where("count > 1").drop("count"))
    same = (F.col("doc_id") == F.col(id_)) & F.xxhash64("text").eqNullSafe(F.col(its_text))
    first = docs.join(kept, same, "left_semi")
    if not again.isEmpty():
        one = first.join(again, same, "left_semi").withColumn(its_text, F.xxhash64("text")).dropDuplicates(["doc_id", its_text]).drop(its_text)
        first = first.join(again, same, "left_anti").unionByName(one)
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    clean, _ = decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))
    return clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share asks, shuffled."""
    return mixing.poisson_mix(docs, WEIGHTS).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, as read back. Copies are numbered row by row of one id and text; rows without
    an id, of which very many may be alike, by their place in the table instead, so they stand anywhere in the order."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("its_text"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "its_text").orderBy("its_text")) - 1
    named = rows.where(F.col("doc_id").isNotNull()).withColumn("mix_copy", copy.cast("long"))
    unnamed = rows.where(F.col("doc_id").isNull()).withColumn("mix_copy", F.monotonically_increasing_id())
    return tokens.token_rows(spark, named.unionByName(unnamed), order=mixing.unit_hash(f"{mixing.SEED}/order", "doc_id", "mix_copy"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", token_files),
]

#: Fitting a classifier and encoding texts are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return docs
