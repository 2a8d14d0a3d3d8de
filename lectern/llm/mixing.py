"""Mixing sources to target weights.

Tokens are summed per source, a water-filling step turns weights into targets, and each
document is taken floor(rate) times plus one Bernoulli copy of the fraction's probability, seeded by its id's hash: coins are
independent, so what a source takes has its target as its mean, and comes the nearer to it the more documents there are.
Only the per-source table (one row per source) is ever sorted or windowed; documents see
one aggregation with partial sums and one broadcast join with it; beyond the session's broadcast threshold, sources are joined by sort.

Null sources are a source, last in order; null or empty texts have size 0 and are taken
floor(rate) times or once more like any other; equal doc_ids share one coin, and so do equal texts without one; an empty
table gives no rows. Columns other than doc_id, text and source pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import written

#: Weights by order of the source, repeated; share of all tokens to take; most repeats of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also target: weight x level, but at most cap x size, the level such that all targets make share x the total.

    Sources reach their cap in the order of cap x size / weight. If those before one are full, the
    rest share what is left by weight; the first source whose share stays within its cap ends the search.
    """
    by_name = W.Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = W.Window.orderBy(F.col("_full"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(W.Window.unboundedPreceding, -1), fill.rowsBetween(0, W.Window.unboundedFollowing)
    ranked = sizes.withColumn("_w", weight).withColumn("_full", cap * F.col("source_size") / F.col("_w"))
    level = (share * F.sum("source_size").over(W.Window.partitionBy()) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after)
    found = ranked.withColumn("_level", level)
    return found.withColumn("_ok", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(W.Window.partitionBy())).select(
        "source", "source_size", F.least(cap * F.col("source_size"), F.col("_w") * F.coalesce(F.col("_ok._level"), F.lit(float("inf")))).alias("target")
    )


def coin(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A uniform number in [0, 1) made of the id, or of the text where there is none: reruns agree."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc (a struct of all columns of ``docs``), size, source_size, target (of its source) and copies of each row."""
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), n_tokens(F.col("text")).alias("size"), F.col("source").alias("from"))
    sizes = written(sized.groupBy(F.col("from").alias("source")).agg(F.sum("size").alias("source_size")), "source-sizes")
    plan = targets(sizes, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    copies = F.floor("rate") + F.when(coin(F.col("doc.doc_id"), F.col("doc.text")) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    joined = sized.join(plan, sized["from"].eqNullSafe(plan["source"]), "left")
    return joined.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of the documents, each as many times as its copies say."""
    return mixed.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op7(spark, sf_dir: str) -> DataFrame:
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256('mix:' || coalesce(doc_id::VARCHAR, 'text:' || text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / wt AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(wt) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, wt * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, level LIMIT 1)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, ('0x' || substr(d.h, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (coin < rate - floor(rate))::INT))::BIGINT AS taken FROM r
"""
