"""Sharding by balanced label propagation, in DataFrame operations only.

Rows are numbered once, in a written table; a row starts in a shard by the hash of its number, so that rows of any ids spread evenly (files that are
laid out in another way give other numbers, and other shards of the same law). Documents are linked if their texts
are equal (any grouping column serves); each round, a group counts its members by shard,
which is what each member hears from its neighbours through the group's hub, and
members ask to move to the shard that holds most of them. A shard takes in movers only up to
the room that its quota leaves. Unlinked documents then fill all quotas exactly. The law
is `rows`: shard sizes differ by one row at most.

A group larger than a shard's quota fills that shard and goes on to the next one. Null texts
form one group of size 0 + 1; repeated rows are rows of their own; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, join_hot, ranked, written

SHARDS = 8
ROUNDS = 3


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def _counts(df: DataFrame, column: str, shards: int) -> list[int]:
    """Rows per shard: one number each comes to the driver."""
    n = dict(df.groupBy(column).count().filter(F.col(column).isNotNull()).collect())
    return [n.get(k, 0) for k in range(shards)]


def balanced_labels(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (row: unique long, group: equal for linked rows) -> row, group, shard."""
    total = nodes.count()
    quota = _quota(total, shards)
    sizes = cut(nodes.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1"))
    marked = join_hot(nodes, sizes.withColumn("linked", F.lit(True)), ["group"], total, "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    state = cut(marked.withColumn("shard", F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int")))
    linked = state.filter("linked")
    open_shards = list(range(shards))
    for _ in range(rounds):
        # Shares of each group by shard: at most `shards` rows a group, whatever its size.
        held = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
        open_ = F.col("shard").isin(open_shards)
        wish = held.groupBy("group").agg(F.sum("n").alias("n"), F.max(F.when(open_, F.struct("n", F.xxhash64("group", "shard").alias("h"), "shard"))).alias("best")).select("group", "n", F.col("best.shard").alias("wish"))
        asked = cut(join_hot(linked, cut(wish), ["group"], total, "left").withColumn("wish", F.coalesce("wish", "shard")))
        staying = _counts(asked.filter("wish = shard"), "shard", shards)
        room = [max(0, q - s) for q, s in zip(quota, staying, strict=True)]
        if sum(_counts(asked.filter("wish <> shard"), "wish", shards)) == 0:
            linked = asked.drop("wish")
            break
        moving = ranked(asked.filter("wish <> shard"), "wish", [F.col("group"), F.col("row")], "place")
        moved = moving.withColumn("shard", F.when(F.col("place") < _pick(room, F.col("wish")), F.col("wish")).otherwise(F.col("shard"))).drop("wish", "place")
        linked = cut(asked.filter("wish = shard").drop("wish").unionByName(moved))
        full = _counts(linked, "shard", shards)
        open_shards = [k for k in range(shards) if full[k] < quota[k]] or open_shards
    # Linked rows beyond a quota, and the unlinked ones, take the places that are left.
    seated = ranked(linked, "shard", [F.col("group"), F.col("row")], "place")
    over = F.col("place") >= _pick(quota, F.col("shard"))
    kept = cut(seated.withColumn("over", over).drop("place"))
    left = [q - n for q, n in zip(quota, _counts(kept.filter("not over"), "shard", shards), strict=True)]
    loose = kept.filter("over").drop("over").unionByName(state.filter("not linked"))
    queue = ranked(loose, "shard", [F.col("row")], "place")
    stays = F.col("place") < _pick(left, F.col("shard"))
    queue = cut(queue.withColumn("stays", stays).drop("place"))
    gaps = [n - s for n, s in zip(left, _counts(queue.filter("stays"), "shard", shards), strict=True)]
    ends, at = [], 0
    for n in gaps:
        at += n
        ends.append(at)
    surplus = ranked(queue.filter("not stays").withColumn("_all", F.lit(0)), "_all", [F.col("row")], "place")
    seat = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place"))).cast("int")
    surplus = surplus.withColumn("shard", seat)
    columns = ["row", "group", "shard"]
    return kept.filter("not over").select(columns).union(queue.filter("stays").select(columns)).union(surplus.select(columns))


def cut_groups(labels: DataFrame) -> DataFrame:
    """One row: linked groups, and those that lie in more than one shard."""
    return labels.groupBy("group").agg(F.count("*").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b")).filter("n > 1").agg(F.count("*").alias("groups"), F.count_if(F.col("a") < F.col("b")).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    # Written once, so that the row numbers stand; copies of a row get numbers of their own.
    facts = written(facts.withColumn("row", F.monotonically_increasing_id()), "shard-facts")
    labels = balanced_labels(facts.select("row", "group"), shards, rounds)
    seats = ranked(labels.select("row", "shard"), "shard", [F.col("row")], "slot")
    return facts.join(seats, "row").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
