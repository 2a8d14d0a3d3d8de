"""Seeding a linked vocabulary again: topics, their aliases and the links between them, as one set of changes.

A change set has one row a change and none for what stays as it is: what, topic, key, change (insert, update or delete), and the new values. ``applied`` makes
the tables of it. What the seed dropped goes, but only for topics that it has, and never what was made by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import norm


def seed_aliases(topics: DataFrame, aliases: DataFrame) -> DataFrame:
    """topic, norm, alias, lang, strict of ``topics`` (topic, name) and ``aliases`` (topic, ord, alias, strict): a topic's name is its first alias; of aliases that are the same but for case and blanks the last one stays."""
    names = topics.select("topic", F.lit(-1).cast("long").alias("ord"), F.col("name").alias("alias"), F.lit(False).alias("strict"))
    both = names.unionByName(aliases.select("topic", F.col("ord").cast("long").alias("ord"), "alias", "strict")).withColumn("norm", norm(F.col("alias"))).filter("norm <> ''")
    last = F.row_number().over(W.Window.partitionBy("topic", "norm").orderBy(F.col("ord").desc(), F.col("alias").desc()))
    lang = F.when(F.col("alias").rlike(r"[^\x00-\x7F]"), "te").otherwise("en")
    return both.withColumn("_k", last).filter("_k = 1").select("topic", "norm", "alias", lang.alias("lang"), "strict")


def _changes(what: str, old: DataFrame, new: DataFrame, keys: list[str], values: list[str], spared) -> DataFrame:
    """Rows to insert, to update and, but for those that are ``spared`` (a condition on the old row), to delete."""
    was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], spared.alias("_spared"), F.lit(True).alias("_old"))
    both = was.join(new.select(*keys, *values, F.lit(True).alias("_new")), keys, "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), F.when(~F.col("_spared"), "delete")).when(~same, "update")
    out = both.withColumn("change", change).filter("change is not null")
    told = [F.when(F.col("change") != "delete", F.col(c)).cast("string").alias(c) for c in values]
    return out.select(F.lit(what).alias("what"), *keys, "change", *told)


def reseeded(seed: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """The changes that bring ``stored`` into line with ``seed``: what, topic, key, change, name, lang, strict.

    ``topics``: topic, name (stored topics that the seed lacks stay); ``aliases``: as the seed's of ``seed_aliases``, stored ones with manual; ``links``: a, b
    (known topics alone; none is deleted, as links may be made by hand).
    """
    none = F.lit(None).cast("string")
    topics = _changes("topic", stored["topics"], seed["topics"], ["topic"], ["name"], F.lit(True))
    wanted = seed_aliases(seed["topics"], seed["aliases"])
    known = stored["aliases"].join(seed["topics"].select("topic", F.lit(True).alias("_seeded")), "topic", "left")
    aliases = _changes("alias", known, wanted, ["topic", "norm"], ["alias", "lang", "strict"], F.col("manual") | F.col("_seeded").isNull())
    ids = stored["topics"].select("topic").union(seed["topics"].select("topic")).distinct()
    fit = seed["links"].select("a", "b").distinct().join(ids.withColumnRenamed("topic", "a"), "a", "left_semi").join(ids.withColumnRenamed("topic", "b"), "b", "left_semi")
    links = fit.join(stored["links"], ["a", "b"], "left_anti")
    return (
        topics.select("what", "topic", none.alias("key"), "change", "name", none.alias("lang"), none.alias("strict"))
        .unionByName(aliases.select("what", "topic", F.col("norm").alias("key"), "change", F.col("alias").alias("name"), "lang", "strict"))
        .unionByName(links.select(F.lit("link").alias("what"), F.col("a").alias("topic"), F.col("b").cast("string").alias("key"), F.lit("insert").alias("change"), none.alias("name"), none.alias("lang"), none.alias("strict")))
    )


def applied_aliases(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored aliases after ``changes``; what a change touches is the seed's from then on."""
    c = changes.filter("what = 'alias'").select("topic", F.col("key").alias("norm"), "change", "name", F.col("lang").alias("_lang"), F.col("strict").cast("boolean").alias("_strict"))
    left = stored.join(c.select("topic", "norm"), ["topic", "norm"], "left_anti")
    return left.select("topic", "norm", "alias", "lang", "strict", "manual").union(c.filter("change <> 'delete'").select("topic", "norm", F.col("name"), F.col("_lang"), F.col("_strict"), F.lit(False)))
