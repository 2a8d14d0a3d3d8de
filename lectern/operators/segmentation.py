"""Articles of printed pages: roles of blocks, headlines found by their drop caps, owners, adopted orphans, and each article's parts.

``blocks``: doc, page, block, x0, y0, x1, y1, size, text. Everything is by page, and a page holds what paper holds: windows, folds and lists over one page are bounded by that.
The two steps in which one block's fate depends on those before it (drop caps that share the lines above them, orphans that widen the article they join)
are folds over the page's few such blocks, as expressions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import dateline, dehyphenated, js_round, without_dateline

PAGE = ["doc", "page"]
#: Pointers to where an article goes on.
POINTER = r"(?i)(?:CONTINUED\s+ON|[A-Z][A-Z\s'’.]{3,40})\s*»\s*PAGE\s*(\d{1,3})"
CONTINUATION = r"(?i)CONTINUED\s+ON\s*»\s*PAGE\s*(\d{1,3})"
JUMP_ONLY = r"(?i)^\s*(?:(?:CONTINUED\s+ON|[A-Z][A-Z\s'’.]{3,40})\s*»\s*PAGE\s*\d{1,3}\s*)+$"
#: How far a block may overhang its headline, and begin above its foot; how far above a drop cap a headline may be; how far an orphan
#: may be from its article; how far a standfirst from its headline; the widest body block, in columns; the shortest article.
COVER, ABOVE, DROP, ORPHAN, STANDFIRST, COLUMNS, LEAST = 14.0, 4.0, 90.0, 140.0, 60.0, 3, 140


class Profile(NamedTuple):
    """How a publication is set: sizes in points, lengths in characters, patterns of lines that are no part of a story."""

    min_size: float = 13.0
    min_chars: int = 12
    max_chars: int = 220
    no_period: bool = True
    top: float = 70.0
    bottom: float = 1500.0
    noise: tuple[str, ...] = ()
    running: tuple[str, ...] = ()
    classified: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    bylines: tuple[str, ...] = ("^(?i:by )",)


def cleaned(text: Column) -> Column:
    """No soft hyphens, straight quotes, broken words joined, single blanks."""
    return dehyphenated(F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("­"), F.lit("")), "‘’“”", "''\"\""))


def fragment(text: Column) -> Column:
    """Begins in lower case, and not as a name may ("eBay India")."""
    return text.rlike("^[a-z]") & ~text.rlike(r"^[a-z]{2,}\s+[A-Z]")


def _of_page() -> W.WindowSpec:
    """All steps are over the rows of one page, which are dealt once."""
    return W.Window.partitionBy(*PAGE)


def _gathered(which: Column, *columns: str) -> Column:
    """The ``columns`` of the rows of a block's page for which ``which`` holds, in no order."""
    return F.collect_list(F.when(which, F.struct(*columns))).over(_of_page())


def _commonest(rows: DataFrame, which: Column, value: Column, weight: Column, name: str) -> DataFrame:
    """``rows`` with the value of most weight on their page, of equal ones the first printed, among rows for which ``which`` holds; null if none does."""
    each = W.Window.partitionBy(*PAGE, "_v")
    n = rows.withColumn("_v", F.when(which, value)).withColumn("_n", F.sum(weight).over(each)).withColumn("_first", F.min("block").over(each))
    best = F.when(F.col("_v").isNotNull(), F.struct("_n", (-F.col("_first")).alias("f"), "_v"))
    return n.withColumn(name, F.max(best).over(_of_page())["_v"]).drop("_v", "_n", "_first")


def classified(blocks: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """``blocks`` with their cleaned text (empty ones go), the page's body size (9 where it has none) and a role.

    A page's titles, drop caps (one or two letters set large) and lines of headline size that are not shaped like one (secondary) are told from headlines.
    """
    # Dealt by page before texts are cleaned: all that follows happens where a page is.
    b = blocks.filter("doc is not null and page is not null").repartition(*PAGE).withColumn("text", cleaned(F.col("text"))).filter("text <> ''")
    b = _commonest(b, F.lit(True), js_round(F.coalesce("size", F.lit(0.0)) * 2) / 2, F.length("text"), "body_size").withColumn("body_size", F.when(F.col("body_size") > 0, F.col("body_size")).otherwise(9.0))
    text, ratio, n = F.col("text"), F.coalesce("size", F.lit(0.0)) / F.col("body_size"), F.length("text")
    any_ = lambda ps: F.lit(False) if not ps else text.rlike("|".join(f"(?:{p})" for p in ps))
    ends = text.rlike(r"[.!?]$")
    shaped = (F.col("size") >= profile.min_size) & n.between(profile.min_chars, profile.max_chars) & ~fragment(text) & (~ends if profile.no_period else F.lit(True))
    role = F.when(any_(profile.noise), "noise").when(any_(profile.running), "furniture").when(any_(profile.classified), "classified").when((F.col("y0") <= profile.top) | (F.col("y0") >= profile.bottom), "furniture")
    large = F.when((F.length(F.regexp_replace(text, "[^A-Za-z0-9_]", "")) <= 2) & (ratio >= 1.8), "dropcap").when(any_(profile.titles), "pagetitle").when(shaped, "headline").otherwise("secondary")
    role = role.when(ratio >= 1.35, large).when(any_(profile.bylines), "byline").when(ratio < 0.85, "caption").otherwise("body")
    return b.withColumn("role", F.when((role != "headline") & text.rlike(JUMP_ONLY), "jumpline").otherwise(role))


def _owned(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``heads``, the headlines of their page, and ``owner``: for blocks that are no headline, the nearest headline above that covers their centre; null if there is none."""
    b = blocks.withColumn("heads", _gathered(F.col("role") == "headline", "block", "x0", "y0", "x1", "y1"))
    centre = (F.col("x0") + F.col("x1")) / 2
    over = lambda h: (h["y1"] <= F.col("y0") + ABOVE) & centre.between(h["x0"] - COVER, h["x1"] + COVER)
    near = F.array_max(F.transform(F.filter("heads", over), lambda h: F.struct(h["y1"].alias("y1"), (-h["y0"]).alias("y"), (-h["block"]).alias("o"), h["block"].alias("owner"))))
    return b.withColumn("owner", F.when(F.col("role") != "headline", near["owner"]))


def owners(blocks: DataFrame) -> DataFrame:
    """doc, page, block, owner of the blocks that are no headline."""
    return _owned(blocks).filter("role <> 'headline'").select(*PAGE, "block", "owner")


def promoted(blocks: DataFrame) -> DataFrame:
    """``blocks`` of which secondary lines above a drop cap that no headline owns have become headlines.

    Of the secondary lines at most DROP above the cap and beside it, the lowest that is no fragment is the headline; fragments below it
    go on its text and are noise. Caps are taken in their order, and a line that one of them took is not there for the next.
    """
    at = ("block", "x0", "y0", "x1", "text")
    b = _owned(blocks).withColumn("caps", F.array_sort(_gathered((F.col("role") == "dropcap") & F.col("owner").isNull(), *at))).withColumn("lines", _gathered(F.col("role") == "secondary", *at))

    def take(state: Column, cap: Column) -> Column:
        beside = lambda s: ~F.array_contains(state["taken"], s["block"]) & (s["y0"] < cap["y0"]) & (cap["y0"] - s["y0"] <= DROP) & (s["x0"] < cap["x1"] + COVER) & (s["x1"] > cap["x0"] - COVER)
        up = F.array_sort(F.transform(F.filter("lines", beside), lambda s: F.struct((-s["y0"]).alias("y"), s["block"].alias("block"), s["text"].alias("text"))))

        def step(above: Column) -> Column:
            first = F.array_position(F.transform(above, lambda s: fragment(s["text"])), F.lit(False)).cast("int")
            head, rest = F.get(above, first - 1), F.reverse(F.slice(above, 1, F.greatest(first - 1, F.lit(0))))
            text = cleaned(F.array_join(F.concat(F.array(head["text"]), F.transform(rest, lambda s: s["text"])), " "))
            new = F.struct(F.concat(state["taken"], F.array(head["block"]), F.transform(rest, lambda s: s["block"])).alias("taken"), F.concat(state["heads"], F.array(F.struct(head["block"].alias("block"), text.alias("told")))).alias("heads"))
            return F.when(first > 0, new).otherwise(state)

        return F.transform(F.array(up), step)[0]

    kind = blocks.schema["block"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast(f"array<struct<block: {kind}, told: string>>").alias("heads"))
    done = b.withColumn("s", F.when((F.col("role") == "secondary") & (F.size("caps") > 0), F.aggregate("caps", start, take)))
    told = F.get(F.filter("s.heads", lambda h: h["block"] == F.col("block")), F.lit(0))["told"]
    done = done.withColumn("told", told).withColumn("role", F.when(F.col("told").isNotNull(), "headline").when(F.array_contains("s.taken", F.col("block")), "noise").otherwise(F.col("role")))
    return done.withColumn("text", F.coalesce("told", "text")).select(blocks.columns)


def guarded(blocks: DataFrame) -> DataFrame:
    """Body blocks wider than COLUMNS of the page's commonest body columns become "merged": they hold several stories' lines."""
    width = F.col("x1") - F.col("x0")
    step = js_round(width / 5) * 5
    b = _commonest(blocks, (F.col("role") == "body") & (step > 0), step, F.lit(1), "column")
    wide = (F.col("role") == "body") & (width > F.col("column") * COLUMNS)
    return b.withColumn("role", F.when(F.coalesce(wide, F.lit(False)), "merged").otherwise(F.col("role"))).drop("column")


_NO_STORY = ("noise", "furniture", "pagetitle", "classified", "merged")


def _adopted(blocks: DataFrame) -> DataFrame:
    """``blocks`` of stories with heads, owner and late: the headline that owns them, of orphans the nearest article's, at most ORPHAN away (late). Others have a null owner.

    An article's region is its headline and its body; a body orphan that joins widens it for the orphans after it.
    """
    b = _owned(blocks.filter(~F.col("role").isin(*_NO_STORY)))
    box = ("x0", "y0", "x1", "y1")
    b = b.withColumn("bodies", _gathered((F.col("role") == "body") & F.col("owner").isNotNull(), "owner", *box)).withColumn("orphans", F.array_sort(_gathered((F.col("role") != "headline") & F.col("owner").isNull(), "block", "role", *box)))

    def region(h: Column) -> Column:
        own = F.filter("bodies", lambda p: p["owner"] == h["block"])
        edge = lambda side, of, pick: of(h[side], pick(F.transform(own, lambda p: p[side]))).alias(side)
        return F.struct(h["y0"].alias("at"), h["block"].alias("owner"), edge("x0", F.least, F.array_min), edge("y0", F.least, F.array_min), edge("x1", F.greatest, F.array_max), edge("y1", F.greatest, F.array_max))

    b = b.withColumn("regions", F.when((F.col("role") != "headline") & F.col("owner").isNull() & (F.size("heads") > 0), F.array_sort(F.transform("heads", region))))

    def take(state: Column, b: Column) -> Column:
        apart = lambda low, high, a, z: F.greatest(F.lit(0.0), low - z, a - high)
        gap = lambda r: F.hypot(apart(r["x0"], r["x1"], b["x0"], b["x1"]), apart(r["y0"], r["y1"], b["y0"], b["y1"]))
        near = F.array_min(F.transform(state["regions"], lambda r, i: F.struct(gap(r).alias("gap"), i.alias("i"))))

        def join(n: Column) -> Column:
            fits = n["gap"] <= ORPHAN
            wider = lambda r: F.struct(r["at"].alias("at"), r["owner"].alias("owner"), F.least(r["x0"], b["x0"]).alias("x0"), F.least(r["y0"], b["y0"]).alias("y0"), F.greatest(r["x1"], b["x1"]).alias("x1"), F.greatest(r["y1"], b["y1"]).alias("y1"))
            grown = F.transform(state["regions"], lambda r, i: F.when(fits & (b["role"] == "body") & (i == n["i"]), wider(r)).otherwise(r))
            found = F.struct(b["block"].alias("block"), F.when(fits, F.get(state["regions"], n["i"])["owner"]).alias("near"))
            return F.struct(grown.alias("regions"), F.concat(state["found"], F.array(found)).alias("found"))

        return F.transform(F.array(near), join)[0]

    kind = blocks.schema["block"].dataType.simpleString()
    start = F.struct(F.col("regions"), F.array().cast(f"array<struct<block: {kind}, near: {kind}>>").alias("found"))
    found = F.filter(F.aggregate("orphans", start, take)["found"], lambda f: f["block"] == F.col("block"))
    near = b.withColumn("near", F.when(F.col("regions").isNotNull(), F.get(found, F.lit(0))["near"]))
    near = near.withColumn("late", F.col("owner").isNull() & F.col("near").isNotNull()).withColumn("owner", F.coalesce("owner", "near"))
    return near.drop("bodies", "orphans", "regions", "near")


def adopted(blocks: DataFrame) -> DataFrame:
    """doc, page, block, owner, late of the blocks of stories that are no headline, as _adopted tells them."""
    return _adopted(blocks).filter("role <> 'headline'").select(*PAGE, "block", "owner", "late")


def _byline(text: Column) -> Column:
    """No longer than 60 characters, not a question, a label or a sentence, and not a single word in capitals."""
    initial = text.rlike(r"(?:^|[^A-Za-z0-9_])[A-Z]\.$")
    return (text != "") & (F.length(text) <= 60) & ~text.rlike("[?:!]$") & (~text.endswith(".") | initial) & (text.rlike(r"\s") | (text != F.upper(text)))


def segmented(blocks: DataFrame, profile: Profile = Profile(), least: int = LEAST) -> DataFrame:
    """Articles of each page: doc, page, id (the headline's block), x0, y0, x1, y1, headline, standfirst, byline, dateline, captions, body, chars, continues_on, prominence, n_blocks.

    The body goes column by column; pointers to other pages leave it and tell where it goes on; a drop cap is put back before a word that lacks it. Articles of fewer than ``least`` characters go.
    """
    of = _adopted(guarded(promoted(classified(blocks, profile)))).withColumn("id", F.when(F.col("role") == "headline", F.col("block")).otherwise(F.col("owner"))).filter("id is not null")
    of = of.withColumn("foot", F.get(F.filter("heads", lambda h: h["block"] == F.col("id")), F.lit(0))["y1"])
    column = js_round(F.col("x0") / 24) * 24
    parts = lambda role, *order: F.transform(F.array_sort(F.collect_list(F.when(role, F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order)], F.col("text").alias("text"))))), lambda x: x["text"])
    turn = (F.col("late"), F.col("block"))
    role = F.col("role")
    below = F.col("y0") - F.col("foot")
    head = F.struct("x0", "y0", "x1", "y1", F.col("text").alias("headline"), "size", "body_size")
    a = of.groupBy(*PAGE, "id").agg(
        F.max(F.when(role == "headline", head)).alias("h"), F.count_if(role != "headline").alias("n"),
        parts(role == "body", column, F.col("y0"), *turn).alias("bodies"), parts(role == "dropcap", *turn).alias("caps"), parts(role == "jumpline", *turn).alias("jumps"), parts(role == "caption", *turn).alias("captions"),
        parts(role == "byline", F.col("y0"), *turn).alias("bylines"), parts((role == "secondary") & below.between(0, STANDFIRST), *turn).alias("under"),
    )
    body = F.array_join("bodies", " ")
    pages = F.concat(F.flatten(F.transform("jumps", lambda t: F.regexp_extract_all(t, F.lit(CONTINUATION), F.lit(1)))), F.regexp_extract_all(body, F.lit(CONTINUATION), F.lit(1)))
    capped = F.aggregate("caps", F.regexp_replace(body, POINTER, " "), lambda text, cap: F.when(text.rlike("^[a-z]"), F.concat(F.regexp_replace(cap, "[^A-Za-z0-9_]", ""), text)).otherwise(text))
    byline = F.coalesce(F.get(F.filter("bylines", _byline), F.lit(0)), F.lit(""))
    a = a.filter("n > 0").select(*PAGE, "id", "h.*", "bodies", "caps", "jumps", "captions", "bylines", "under").select(
        *PAGE, "id", "x0", "y0", "x1", "y1", "headline", F.coalesce(F.get("under", F.lit(0)), F.lit("")).alias("standfirst"), without_dateline(byline).alias("byline"), dateline(byline).alias("dateline"), "captions",
        cleaned(capped).alias("body"), F.get(pages, F.lit(0)).cast("int").alias("continues_on"), (js_round(F.col("size") / F.col("body_size") * 100) / 100).alias("prominence"), F.size("bodies").cast("long").alias("n_blocks"),
    )
    return a.withColumn("chars", F.length("body").cast("long")).filter(F.col("chars") >= least)


def page_offset(blocks: DataFrame, quorum: int = 3) -> DataFrame:
    """doc, page_offset: by how much the file's page numbers exceed the printed ones, by the vote of the running heads; 0 without ``quorum`` votes for one."""
    head = r"^(?:THE\s+HINDU\s+)?(\d{1,3})\s+[A-Z][a-z]+day,"
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    printed = blocks.filter(text.rlike(head)).groupBy("doc", "page").agg(F.min(F.struct("block", F.regexp_extract(text, head, 1).cast("int").alias("n")))["n"].alias("n"))
    votes = printed.withColumn("by", (F.col("page") - F.col("n")).cast("int")).filter("by >= 0").groupBy("doc", "by").agg(F.count("*").alias("votes"), F.min("page").alias("first"))
    best = votes.groupBy("doc").agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), "by")).alias("m"))
    return blocks.select("doc").distinct().join(best, "doc", "left").select("doc", F.when(F.col("m.votes") >= quorum, F.col("m.by")).otherwise(0).cast("int").alias("page_offset"))


def numbered(articles: DataFrame, offsets: DataFrame) -> DataFrame:
    """``articles`` with the page that is printed on theirs, and the page of the file that they go on at."""
    a = articles.join(offsets, "doc")
    return a.withColumn("printed_page", (F.col("page") - F.col("page_offset")).cast("long")).withColumn("continues_on_file", (F.col("continues_on") + F.col("page_offset")).cast("int")).drop("page_offset")
