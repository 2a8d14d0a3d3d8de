"""Page geometry over blocks (doc, page, block, x0, y0, x1, y1, size, text): body size, column width, owners, reading order, jumps.

All windows are over one page or one document's page, which is bounded by what paper holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def body_size(blocks: DataFrame) -> DataFrame:
    """Per document: the font size, in steps of 0.5, that most characters have."""
    binned = blocks.groupBy("doc", (F.floor(F.col("size") * 2 + 0.5) / 2).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return binned.groupBy("doc").agg(F.max(F.struct("chars", (-F.col("size")).alias("s"))).alias("m")).select("doc", (-F.col("m.s")).alias("body_size"))


def column_width(blocks: DataFrame, step: int = 5) -> DataFrame:
    """Per document: the commonest block width, in steps."""
    w = blocks.groupBy("doc", (F.floor((F.col("x1") - F.col("x0")) / step + 0.5) * step).alias("width")).agg(F.count("*").alias("n"))
    return w.groupBy("doc").agg(F.max(F.struct("n", "width"))["width"].alias("column_width"))


def roles(blocks: DataFrame, noise: tuple[str, ...] = (), running: tuple[str, ...] = (), classified: tuple[str, ...] = (), strips: tuple[float, float] | None = None) -> DataFrame:
    """role of each block: by patterns of its text, by where it starts (``strips``: the least and the greatest y of what is printed between head and foot), by its size against the body's and by its length."""
    # The body's size as body_size has it, over a document's blocks where they are: they are made and dealt once.
    b = blocks.filter("doc is not null").repartition("doc").withColumn("_s", F.floor(F.col("size") * 2 + 0.5) / 2)
    b = b.withColumn("_chars", F.sum(F.length("text")).over(W.Window.partitionBy("doc", "_s")))
    b = b.withColumn("body_size", -F.max(F.struct("_chars", (-F.col("_s")).alias("s"))).over(W.Window.partitionBy("doc"))["s"]).drop("_s", "_chars")
    ratio, text = F.col("size") / F.col("body_size"), F.col("text")
    any_ = lambda ps: F.lit(False) if not ps else text.rlike("|".join(f"(?:{p})" for p in ps))
    edge = F.lit(False) if strips is None else (F.col("y0") <= strips[0]) | (F.col("y0") >= strips[1])
    role = F.when((F.length(F.trim("text")) == 0) | any_(noise), "noise").when(any_(running), "furniture").when(any_(classified), "classified").when(edge, "furniture").when((F.length("text") <= 2) & (ratio >= 1.8), "dropcap")
    role = role.when((ratio >= 1.35) & ~text.rlike(r"[.!?]$"), "headline").when(ratio >= 1.35, "secondary").when(text.rlike("^(?i:by )"), "byline").when(ratio < 0.85, "caption").otherwise("body")
    return b.withColumn("role", role).drop("body_size")


def owners(blocks: DataFrame) -> DataFrame:
    """doc, page, block, owner: the nearest headline above whose span covers the block's centre (an as-of join within the page)."""
    h = blocks.filter("role = 'headline'").select("doc", "page", F.col("block").alias("owner"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y1").alias("hy"))
    b = blocks.filter("role <> 'headline'").withColumn("cx", (F.col("x0") + F.col("x1")) / 2)
    above = b.join(h, ["doc", "page"]).filter("hy <= y0 and cx between hx0 and hx1")
    best = above.groupBy("doc", "page", "block").agg(F.max(F.struct("hy", F.col("owner")))["owner"].alias("owner"))
    return b.select("doc", "page", "block").join(best, ["doc", "page", "block"], "left")


def adopted(blocks: DataFrame, owned: DataFrame, most: float = 140.0) -> DataFrame:
    """Orphans go to the owner of the nearest owned block of their page, if it is at most ``most`` points away."""
    at = blocks.select("doc", "page", "block", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")).join(owned, ["doc", "page", "block"])
    other = at.filter("owner is not null").select("doc", "page", F.col("owner").alias("near"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    far = at.filter("owner is null").join(other, ["doc", "page"]).withColumn("d", square("cx", "ox") + square("cy", "oy")).filter(F.col("d") <= most * most)
    found = far.groupBy("doc", "page", "block").agg(F.min(F.struct("d", "near"))["near"].alias("near"))
    return owned.join(found, ["doc", "page", "block"], "left").select("doc", "page", "block", F.coalesce("owner", "near").alias("owner"))


def articles(blocks: DataFrame, owned: DataFrame, width: float = 240.0, least: int = 140) -> DataFrame:
    """doc, page, owner, text of each article: its blocks column by column, top to bottom; those under ``least`` characters go."""
    b = blocks.join(owned.filter("owner is not null"), ["doc", "page", "block"])
    order = F.struct(F.floor(F.col("x0") / width).alias("c"), F.col("y0").alias("y"), F.col("block").alias("b"), F.col("text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "\n")
    return b.groupBy("doc", "page", "owner").agg(text.alias("text")).filter(F.length("text") >= least)


def page_articles(blocks: DataFrame, width: float = 240.0, most: float = 140.0, least: int = 140) -> DataFrame:
    """doc, page, owner, text of each article of ``blocks`` with roles: its blocks column by column, top to bottom; those under ``least`` characters go.

    A block's owner is as in ``owners``, an orphan's as in ``adopted``; both are told over the page's blocks where they are.
    """
    page = W.Window.partitionBy("doc", "page")
    gathered = lambda which, *columns: F.collect_list(F.when(which, F.struct(*columns))).over(page)
    b = blocks.filter("page is not null").withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    b = b.withColumn("heads", gathered(F.col("role") == "headline", "block", "x0", "x1", "y1"))
    above = F.filter("heads", lambda h: (h["y1"] <= F.col("y0")) & F.col("cx").between(h["x0"], h["x1"]))
    best = F.array_max(F.transform(above, lambda h: F.struct(h["y1"].alias("y"), h["block"].alias("owner"))))
    b = b.withColumn("owner", F.when(F.col("role") != "headline", best["owner"])).withColumn("held", gathered(F.col("owner").isNotNull(), "owner", "cx", "cy"))
    apart = lambda o: (F.col("cx") - o["cx"]) * (F.col("cx") - o["cx"]) + (F.col("cy") - o["cy"]) * (F.col("cy") - o["cy"])
    near = F.array_min(F.transform(F.filter("held", lambda o: apart(o) <= most * most), lambda o: F.struct(apart(o).alias("d"), o["owner"].alias("owner"))))
    b = b.filter("role <> 'headline'").withColumn("owner", F.coalesce("owner", near["owner"])).filter("owner is not null")
    order = F.struct(F.floor(F.col("x0") / width).alias("c"), F.col("y0").alias("y"), F.col("block").alias("b"), F.col("text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "\n")
    return b.groupBy("doc", "page", "owner").agg(text.alias("text")).filter(F.length("text") >= least)


def jumps(heads: DataFrame, least: int = 2) -> DataFrame:
    """``heads`` (doc, page, id, words, to_page) -> id, next: the article of the named page that shares most words of the headline, ``least`` at least."""
    a = heads.filter("to_page is not null").select("doc", F.col("to_page").alias("page"), "id", "words")
    b = heads.select("doc", "page", F.col("id").alias("next"), F.col("words").alias("w"))
    s = a.join(b, ["doc", "page"]).filter("id <> next").withColumn("n", F.size(F.array_intersect("words", "w"))).filter(F.col("n") >= least)
    return s.withColumn("p", F.row_number().over(W.Window.partitionBy("id").orderBy(F.col("n").desc(), "next"))).filter("p = 1").select("id", "next")
