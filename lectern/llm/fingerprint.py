"""Document fingerprints by a homomorphic multiset hash, in native column expressions.

A text is the multiset of its paragraphs: its lines, cut further at sentence ends. Each
paragraph is hashed to a wide vector, and the fingerprint is the sum of those vectors, lane by lane, modulo a power
of two. Order does not matter; inserting or deleting a paragraph adds or subtracts
its vector. Two kinds of lanes:

* 8 lanes modulo 2**32 of uniform values, so that unequal multisets differ;
* 240 lanes modulo 2**16 that add one hash bit each, and the count of paragraphs. Twice a lane less the
  count is a sum of random signs, so the cosine of two such vectors estimates
  the cosine of the multisets, within about 0.065.

Lanes are packed three to a long with zero bits between, and masked after each addition. Everything
happens inside a row: no shuffle, no group. Null and empty texts have no paragraphs and the all-zero
fingerprint, alike to one another (1.0) and to nothing else (0.0). Equal texts have equal fingerprints;
repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import written

#: Hashes of a paragraph for the likeness lanes; each gives 60 lanes, 3 in each of 20 longs.
HASHES = 4
SHIFTS = 20
LANE, ONES = (1 << 16) - 1, 1 | 1 << 20 | 1 << 40
MASK = LANE | LANE << 20 | LANE << 40
MOD32 = (1 << 32) - 1


def paragraphs(text: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda p: p != "")


def _hashes(paragraph: Column) -> Column:
    # The salt comes first: it seeds the hash of the paragraph, so that each is another function of it.
    return F.array(*[F.xxhash64(F.lit(k), paragraph) for k in range(HASHES + 4)])


def vector(h: Column) -> list[Column]:
    """The lanes of a paragraph's hashes, packed: HASHES * SHIFTS longs of bits, then 8 uniform ones, then 1."""
    bits = [F.shiftrightunsigned(F.get(h, F.lit(k)), s).bitwiseAND(F.lit(ONES)) for k in range(HASHES) for s in range(SHIFTS)]
    wide = [y for k in range(HASHES, HASHES + 4) for x in [F.get(h, F.lit(k))] for y in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(MOD32)))]
    return [*bits, *wide, F.lit(1).cast("long")]


_MASKS = [MASK] * (HASHES * SHIFTS) + [MOD32] * 8 + [LANE]


def fingerprint(text: Column) -> Column:
    """array<long> of packed lanes."""
    zero = F.array(*[F.lit(0).cast("long")] * len(_MASKS))

    def add(total: Column, h: Column) -> Column:
        return F.array(*[(F.get(total, F.lit(k)) + v).bitwiseAND(F.lit(_MASKS[k])) for k, v in enumerate(vector(h))])

    return F.aggregate(F.transform(paragraphs(text), _hashes), zero, add)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or of ``a`` after those of ``b`` are deleted (sign -1)."""
    masks = F.array(*[F.lit(m) for m in _MASKS])
    # One modulus added to each lane keeps a difference from borrowing from the next.
    lifts = F.array(*[F.lit(ONES << 16 if m == MASK else m + 1) for m in _MASKS])
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.zip_with(masks, lifts, lambda m, u: F.struct(m.alias("m"), u.alias("u"))), lambda p, q: ((p["x"] + p["y"]) if sign > 0 else (p["x"] + q["u"] - p["y"])).bitwiseAND(q["m"]))
    return parts


def text_form(f: Column) -> Column:
    """The fingerprint as hexadecimal text of fixed width."""
    return F.array_join(F.transform(f, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _signs(f: Column) -> Column:
    """240 doubles: twice each lane less the count, as a signed residue modulo 2**16."""
    n = F.get(f, F.lit(len(_MASKS) - 1))
    lanes = F.flatten(F.transform(F.slice(f, 1, HASHES * SHIFTS), lambda x: F.array(*[F.shiftrightunsigned(x, 20 * k).bitwiseAND(F.lit(LANE)) for k in range(3)])))
    residue = lambda v: F.pmod(v + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15)
    return F.transform(lanes, lambda x: residue(x * 2 - n).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of two multisets, from vectors of signs."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(dot(a, a) * dot(b, b))
    same = (dot(a, a) == 0) & (dot(b, b) == 0)
    return F.when(same, 1.0).when(scale == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / scale)))


def following(keys: DataFrame, bits: int = 10, most: int = 1 << 16) -> DataFrame:
    """``keys`` (part: distinct longs) -> (part, next): the next larger one, after the largest the smallest.

    Up to ``most`` keys are put in order at once. More are dealt into ranges of 2**bits, each ordered by itself, and the
    ranges in use, far fewer, are followed in the same way.
    """
    if keys.count() <= most:
        along = W.Window.orderBy("part")
        return keys.withColumn("next", F.coalesce(F.lead("part").over(along), F.first("part").over(along)))
    dealt = keys.withColumn("range", F.shiftright("part", bits))
    led = dealt.withColumn("next", F.lead("part").over(W.Window.partitionBy("range").orderBy("part")))
    least = written(dealt.groupBy("range").agg(F.min("part").alias("least")), "ranges")
    after = following(least.select(F.col("range").alias("part")), bits + 4, most).select(F.col("part").alias("range"), F.col("next").alias("to"))
    after = after.join(least.select(F.col("range").alias("to"), "least"), "to").select("range", "least")
    return led.filter("next is not null").select("part", "next").union(led.filter("next is null").join(after, "range").select("part", F.col("least").alias("next")))


def with_next(docs: DataFrame, bits: int = 10) -> DataFrame:
    """``docs`` (doc_id, text) with next_text: of the row after it by doc_id (equal ids: by text), after the last that of the first.

    Ids are dealt into ranges of 2**bits, and rows without one, which come first, into as many by their text's hash; a window serves each range,
    and the last row of a range takes the first of the next range in use from a table of one row a range. Texts are dealt once and not written.
    """
    nameless = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    dealt = docs.withColumn("_part", F.coalesce(F.shiftright("doc_id", bits), nameless))
    heads = written(dealt.groupBy("_part").agg(F.min(F.struct("doc_id", "text"))["text"].alias("_head")), "heads")
    links = following(heads.select(F.col("_part").alias("part"))).select(F.col("part").alias("_part"), F.col("next").alias("_next"))
    after = links.join(heads.withColumnRenamed("_part", "_next"), "_next").select("_part", "_head")
    inside = W.Window.partitionBy("_part").orderBy(F.col("doc_id").asc_nulls_first(), F.col("text"))
    led = dealt.withColumn("_lead", F.lead("text").over(inside))
    return led.join(after, "_part").select("doc_id", "text", F.coalesce("_lead", "_head").alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by as many of the start of ``next_text``, or all of it."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract of op8 for ``docs`` (doc_id, text)."""
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    prints = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("f"), fingerprint(F.col("_edited")).alias("e"), fingerprint(F.col("next_text")).alias("n"))
    signs = prints.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("f")).alias("fingerprint"), text_form(F.col("e")).alias("edited_fingerprint"), _signs(F.col("f")).alias("sf"), _signs(F.col("e")).alias("se"), _signs(F.col("n")).alias("sn"))
    return signs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("sf"), F.col("se")).alias("near_edited"), likeness(F.col("sf"), F.col("sn")).alias("near_next"))


def op8(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
