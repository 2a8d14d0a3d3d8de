"""What kind of piece a printed article is, and why: by the label over it, by its text, by its page's section and by its byline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.lists import DISCLAIMER, EDITION_CITY, HEAD_PREFIX, MARKERS, OPINION_GENRES, OPINION_SECTION, PERSONAL_VIEWS, SECTION_NAME, TURN, edged

#: A running head ends by this y and has at most so many characters, its section at most so many.
HEAD_Y, HEAD_CHARS, SECTION_CHARS, MARKER_CHARS = 130, 90, 28, 70
#: How far a label may overlap the headline below it, stand above it, and reach beyond its sides.
OVERLAP, GAP, REACH = 4, 40, 12
_CELL = GAP + OVERLAP


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def sections(blocks: DataFrame) -> DataFrame:
    """doc, page, section of the pages of ``blocks`` whose running head names one: the shortest such name, then that of the first block."""
    text = _collapsed(F.col("text"))
    city = edged(EDITION_CITY)
    bare = F.regexp_replace(text, HEAD_PREFIX, "")
    heads = blocks.filter((F.length(text) <= HEAD_CHARS) & ~(F.coalesce(F.col("y0"), F.lit(0)) > HEAD_Y) & bare.rlike(city))
    named = heads.withColumn("section", F.trim(F.regexp_replace(bare, city, ""))).filter((F.length("section") <= SECTION_CHARS) & F.col("section").rlike(SECTION_NAME))
    return named.groupBy("doc", "page").agg(F.min(F.struct(F.length("section").alias("n"), "block", "section"))["section"].alias("section"))


def _first_marker(text: Column, markers: tuple, what: int) -> Column:
    out = F.lit(None).cast("string")
    for marker in reversed(markers):
        out = F.when(text.rlike(edged(marker[2])), marker[what]).otherwise(out)
    return out


def labelled(articles: DataFrame, blocks: DataFrame, markers: tuple = MARKERS) -> DataFrame:
    """``articles`` (doc, page, id, x0, y0, x1 of the headline) with marker and label: those of the nearest label just above the headline, within its width.

    Labels and headlines meet by the cell of the page that they lie in: a label stands in each of the two cells that headlines in its reach start in.
    """
    text = _collapsed(F.col("text"))
    found = blocks.filter((F.length(text) <= MARKER_CHARS) & (text != "")).select("doc", "page", "block", F.col("x0").alias("mx0"), F.col("x1").alias("mx1"), F.col("y1").alias("my1"), _first_marker(text, markers, 0).alias("marker"), _first_marker(text, markers, 1).alias("label")).filter("marker is not null")
    cell = lambda y: F.floor(y / _CELL)
    dealt = found.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("my1") - OVERLAP), cell(F.col("my1") + GAP)))))
    gap = F.col("y0") - F.col("my1")
    near = articles.withColumn("cell", cell(F.col("y0"))).join(dealt, ["doc", "page", "cell"]).withColumn("gap", gap).filter(F.col("gap").between(-OVERLAP, GAP) & ~(F.col("mx0") > F.col("x1") + REACH) & ~(F.col("mx1") < F.col("x0") - REACH))
    best = near.groupBy("doc", "page", "id").agg(F.min(F.struct("gap", "block", "marker", "label")).alias("m")).select("doc", "page", "id", "m.marker", "m.label")
    return articles.join(best, ["doc", "page", "id"], "left")


def genre_of(body: Column, told: Column, byline: Column, section: Column, marker: Column, label: Column, markers: tuple = MARKERS) -> Column:
    """genre and why, by six steps: the label over the piece, a label within it (``told``: all of its text), turns of a conversation with a question, the
    disclaimer, the page's section with or without a byline, and a report where nothing says otherwise."""
    body, told, section = (F.coalesce(c, F.lit("")) for c in (body, told, section))
    of = lambda genre, why: F.struct(genre.alias("genre"), why.alias("why"))
    named = lambda c: F.concat(F.lit("page label "), c)
    within, opinion = _first_marker(told, markers, 0), section.rlike(edged(OPINION_SECTION))
    signed, on = F.coalesce(F.trim(byline), F.lit("")) != "", lambda kind: F.concat(F.lit(f"{kind} piece on the "), section, F.lit(" page"))
    return (
        F.when(marker.isNotNull(), of(marker, named(label)))
        .when(within.isNotNull(), of(within, named(_first_marker(told, markers, 1))))
        .when((F.regexp_count(body, F.lit(TURN)) >= 3) & body.contains("?"), of(F.lit("interview"), F.lit("question-and-answer transcript")))
        .when(body.rlike(edged(PERSONAL_VIEWS)), of(F.lit("oped"), F.lit("carries the paper’s \"views expressed are personal\" line")))
        .when(opinion & signed, of(F.lit("oped"), on("signed")))
        .when(opinion, of(F.lit("editorial"), on("unsigned")))
        .otherwise(of(F.lit("report"), F.when(section != "", F.concat(section, F.lit(" page"))).otherwise(F.lit("no contrary signal"))))
    )


def is_opinion(genre: Column) -> Column:
    """Argument and not reported fact."""
    return genre.isin(*OPINION_GENRES)


def without_disclaimer(body: Column) -> Column:
    """The prose without what the paper says about it."""
    return F.regexp_replace(body, edged(DISCLAIMER), "")
