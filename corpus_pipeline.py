"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark passages go, sources are mixed, the rest is sharded.

Each stage takes (spark, docs, sf_dir) with ``docs`` of the columns of documents, and any others, and returns such rows again; the last one
returns the shard of each row. Every stage gives no rows for an empty table. Rows that share an id share its fate but where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm import decontamination, mixing, near_dedup, sharding, toxicity
from lectern.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. A null or empty text scores lowest and stays."""
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, directly or through others, the one with the smallest id stays. Rows without an id stay."""
    found = near_dedup.near_duplicates(docs, 0.8)
    ids = written(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    # What is kept grows with the corpus: it is never broadcast.
    kept = docs.join(ids.select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    if not ids.filter("rows > 1").isEmpty():  # one row of each id: the least by hash
        least = W.Window.partitionBy("key").orderBy(F.xxhash64("row"), F.col("row.text"))
        kept = kept.select("doc_id", F.struct(*[kept[c] for c in kept.columns]).alias("row")).withColumnRenamed("doc_id", "key").withColumn("place", F.row_number().over(least)).filter("place = 1").select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go. Null and empty texts stay; rows without an id are told apart by their text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = lambda rows: written(decontamination.contamination(rows, benchmark).filter("n_hit > 0").select("doc_id").distinct(), "hit")
    left = docs.filter("doc_id is not null")
    left = left.join(hit(left.select("doc_id", "text")), "doc_id", "left_anti").select(docs.columns)
    nameless = docs.filter("doc_id is null")
    if not nameless.isEmpty():
        by_text = F.xxhash64(nameless["text"])
        found = hit(nameless.select(by_text.alias("doc_id"), "text").distinct()).withColumnRenamed("doc_id", "hit")
        left = left.unionByName(nameless.join(found, by_text == found["hit"], "left_anti"))
    return left


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as its source's target asks for. Null sources are a source; null and empty texts count no words and are taken like others; rows of one id share a coin."""
    return mixing.emitted(mixing.mixture(docs))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; copies of a text, nulls being copies of the empty one, share a shard while its quota lasts. Repeated rows have slots of their own."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: No SQL for the trained tagger.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
