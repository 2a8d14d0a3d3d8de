"""Ranking: quotas by bucket, selection bands, format mixes, largest remainders, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import js_round
from lectern.sources.shared import kept


def seeded_order(seed: str, *columns: str) -> Column:
    """A reproducible shuffle: order by a SHA-256 of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)


def weight_of(column: str, weights: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for value, w in weights.items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out


def quota_top_k(df: DataFrame, group: str, bucket: str, order: list[Column], k: int, shares: dict[str, float]) -> DataFrame:
    """Up to ``k`` rows a group: the best of each bucket, then each bucket to its quota max(1, round(k * share)), then the best of the rest.

    ``picked``: best, quota or backfill. Beyond k, rows go from the bucket that most exceeds its quota, the weakest of equals first, and
    no bucket loses its best: a row's excess is its place less the quota, so that order is the order of rows.
    """
    quota = F.greatest(F.lit(1), js_round(weight_of(bucket, shares) * k).cast("int"))
    ranked = df.withColumn("_place", F.row_number().over(W.Window.partitionBy(group, bucket).orderBy(*order)))
    tier = F.when(F.col("_place") == 1, 0).when(F.col("_place") <= quota, 1).otherwise(2)
    ranked = ranked.withColumn("_tier", tier)
    within = F.when(F.col("_tier") == 1, F.col("_place") - quota).otherwise(0)
    out = ranked.withColumn("position", F.row_number().over(W.Window.partitionBy(group).orderBy("_tier", within, *order))).filter((F.col("position") <= k) | (F.col("_tier") == 0))
    return out.withColumn("picked", F.element_at(F.array(F.lit("best"), F.lit("quota"), F.lit("backfill")), F.col("_tier") + 1)).drop("_place", "_tier")


def leverage(n_units: Column, in_headline: Column) -> Column:
    """0, 40, 62, 76, 85 by number of units; 15 more for a headline; 100 at most."""
    base = F.when(n_units <= 0, 0).when(n_units == 1, 40).when(n_units == 2, 62).when(n_units == 3, 76).otherwise(85)
    return F.least(F.lit(100), base + F.when(in_headline, 15).otherwise(0))


def selection_band(df: DataFrame, group: str, bucket: str, score: str, lever: str, key: str, floors: dict[str, int], least: int = 12, most: int = 35) -> DataFrame:
    """Rows by rank = round(.55 leverage + .45 score): those of score >= 32 and rank >= 45, at least ``least`` and at most ``most`` a group, and the floor of each bucket on top."""
    df = df.withColumn("rank", js_round(0.55 * F.col(lever) + 0.45 * F.col(score)).cast("long"))
    order = [F.col("rank").desc(), F.col(score).desc(), F.col(key)]
    df = df.withColumn("place", F.row_number().over(W.Window.partitionBy(group).orderBy(*order)))
    df = df.withColumn("_in", F.row_number().over(W.Window.partitionBy(group, bucket).orderBy(*order)))
    passes = (F.col(score) >= 32) & (F.col("rank") >= 45)
    why = F.when(passes & (F.col("place") <= most), "band").when(F.col("place") <= least, "floor").when(F.col("_in") <= weight_of(bucket, floors, 0), "bucket")
    return df.withColumn("why", why).filter("why is not null").drop("_in")


def format_mix(df: DataFrame, group: list[str], kind: str, key: str, n: int, weights: dict[str, float], seed: str = "quiz") -> DataFrame:
    """``n`` rows a group: each kind to its quota round(n * weight) in seeded order, then the rest in that order."""
    h = seeded_order(seed, key)
    placed = df.withColumn("_h", h).withColumn("_place", F.row_number().over(W.Window.partitionBy(*group, kind).orderBy("_h")))
    over = F.col("_place") > js_round(n * weight_of(kind, weights))
    return placed.withColumn("position", F.row_number().over(W.Window.partitionBy(*group).orderBy(over, "_h"))).filter(F.col("position") <= n).drop("_h", "_place")


def largest_remainder(counts: DataFrame, group: str, kind: str, n: str, seats: int, least: int = 4) -> DataFrame:
    """``seats`` shared by observed counts, in groups of at least ``least``: whole shares, then one more in order of remainder, count, kind."""
    total = F.sum(n).over(W.Window.partitionBy(group))
    c = counts.withColumn("_total", total).filter(F.col("_total") >= least)
    # Whole numbers all the way: no remainder is decided by a rounding error.
    c = c.withColumn("_floor", F.floor(F.col(n) * seats / F.col("_total")).cast("long")).withColumn("_rest", F.col(n) * seats - F.col("_floor") * F.col("_total"))
    left = seats - F.sum("_floor").over(W.Window.partitionBy(group))
    place = F.row_number().over(W.Window.partitionBy(group).orderBy(F.col("_rest").desc(), F.col(n).desc(), F.col(kind)))
    return c.withColumn("_left", left).withColumn("_p", place).select(group, kind, n, (F.col("_floor") + F.when(F.col("_p") <= F.col("_left"), 1).otherwise(0)).alias("seats"))


def vote(df: DataFrame, key: str, choice: str, weight: str, order: str, default: str) -> DataFrame:
    """The choice of most weight for each key; ties go to the smaller ``order``; keys whose choices are all null get the default."""
    sums = df.groupBy(key, choice, order).agg(F.sum(F.when(F.col(choice).isNotNull(), F.col(weight))).alias("w"))
    best = sums.groupBy(key).agg(F.max(F.when(F.col(choice).isNotNull(), F.struct("w", (-F.col(order)).alias("o"), choice))).alias("b"))
    return best.select(key, F.coalesce(f"b.{choice}", F.lit(default)).alias(choice), F.coalesce("b.w", F.lit(0)).alias("weight"))


def positions(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """``df`` with each row's place from 1 in the ``order`` of all rows, for tables of any size.

    Rows are dealt by ranges of the order, each range is numbered by itself, and the rows of the ranges before it (a number a range, which is all that meets in one place) are added.
    """
    ranges = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_k", inside).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_k") + F.col("_before")).drop("_range", "_k", "_before")
