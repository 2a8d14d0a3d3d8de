"""Feeds, press indexes, question banks, resume logs and uploads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.lists import BANK_FORMATS
from lectern.functions.text import entities, html_text, page_headline, url_host
from lectern.sources.shared import dealt, kept

_IN = lambda tag: rf"(?is)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>"


def feed_items(feeds: DataFrame) -> DataFrame:
    """RSS items and Atom entries of ``feeds`` (feed, xml): feed, title, link, day, summary (600 characters at most), category. Items without a title, link or date go."""
    e = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)).alias("x"))
    x = F.col("x")
    link = F.coalesce(F.nullif(F.trim(F.regexp_extract(x, _IN("link"), 1)), F.lit("")), F.nullif(F.regexp_extract(x, r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    when = F.coalesce(F.nullif(F.regexp_extract(x, _IN("pubDate"), 1), F.lit("")), F.nullif(F.regexp_extract(x, _IN("dc:date"), 1), F.lit("")), F.nullif(F.regexp_extract(x, _IN("updated"), 1), F.lit("")), F.nullif(F.regexp_extract(x, _IN("published"), 1), F.lit("")))
    day = F.coalesce(F.to_date(F.nullif(F.regexp_extract(when, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.try_to_date(F.nullif(F.regexp_extract(when, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("")), "d MMM yyyy"))
    body = F.coalesce(F.nullif(F.regexp_extract(x, _IN("description"), 1), F.lit("")), F.regexp_extract(x, _IN("summary"), 1))
    out = e.select("feed", F.trim(entities(F.regexp_extract(x, _IN("title"), 1))).alias("title"), link.alias("link"), day.alias("day"), F.substring(F.trim(entities(F.regexp_replace(body, "<[^>]*>", " "))), 1, 600).alias("summary"), F.trim(entities(F.regexp_extract(x, _IN("category"), 1))).alias("category"))
    return out.filter("title <> '' and link is not null and day is not null")


#: What is read of an RSS item and of an Atom entry by Spark's XML source; _corrupt holds what could not be.
RSS = "title string, link string, pubDate string, `dc:date` string, description string, category string, _corrupt string"
ATOM = "title string, link array<struct<_href: string, _rel: string>>, updated string, published string, summary string, _corrupt string"


def feed_files(spark: SparkSession, path: str, row: str = "item") -> tuple[DataFrame, DataFrame]:
    """The stories of feed files of any size (``row``: item for RSS, entry for Atom) as ``feed_items`` gives them, and the records that are no whole XML.

    The XML source splits files at their rows, so no file is read whole by one task.
    """
    # Parsed once: a corrupt record is known only with all of its columns.
    read = kept(spark.read.format("xml").option("rowTag", row).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(RSS if row == "item" else ATOM).load(path), "feeds")
    known = read.filter("_corrupt is null")
    if row == "item":
        link, when, body, category = F.trim("link"), F.coalesce("pubDate", "`dc:date`"), F.col("description"), F.coalesce("category", F.lit(""))
    else:
        own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link, when, body, category = F.get(own, F.lit(0))["_href"], F.coalesce("updated", "published"), F.col("summary"), F.lit("")
    day = F.coalesce(F.to_date(F.nullif(F.regexp_extract(when, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))), F.try_to_date(F.nullif(F.regexp_extract(when, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("")), "d MMM yyyy"))
    text = F.trim(entities(F.regexp_replace(F.coalesce(body, F.lit("")), "<[^>]*>", " ")))
    items = known.select(F.trim(entities(F.coalesce("title", F.lit("")))).alias("title"), F.nullif(link, F.lit("")).alias("link"), day.alias("day"), F.substring(text, 1, 600).alias("summary"), F.trim(entities(category)).alias("category"))
    return items.filter("title <> '' and link is not null and day is not null"), read.filter("_corrupt is not null").select(F.col("_corrupt").alias("record"))


def press_index(pages: DataFrame) -> DataFrame:
    """Links of index ``pages`` (page_id, html) under their ministries: the last <h3> before a link is carried forward."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)(<h3\b[^>]*>.*?</h3>|<a\b[^>]*>.*?</a>)"), 1)
    p = pages.select("page_id", F.posexplode(parts).alias("pos", "x"))
    p = p.withColumn("h", F.when(F.col("x").rlike("(?i)^<h3"), F.trim(F.regexp_replace("x", "<[^>]*>", ""))))
    p = p.withColumn("ministry", F.last("h", ignorenulls=True).over(W.Window.partitionBy("page_id").orderBy("pos")))
    return p.filter("h is null").select("page_id", "pos", "ministry", F.regexp_extract("x", r"""(?i)href=["']([^"']*)""", 1).alias("link"), F.trim(F.regexp_replace("x", "<[^>]*>", "")).alias("title"))


def pages_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", url_host(F.col("url")).alias("host"), page_headline(F.col("html")).alias("headline"), html_text(F.col("html")).alias("text"))


def publishers(pages: DataFrame, known: list[tuple[str, str, bool]]) -> DataFrame:
    """``pages`` with publisher and is_primary by host, exact or as a dotted suffix; the longest known host (host, publisher, primary) wins."""
    host = url_host(F.col("url"))
    name, primary = host, F.lit(False)
    for suffix, publisher, first in sorted(known, key=lambda k: len(k[0])):
        hit = (host == suffix) | host.endswith(f".{suffix}")
        name, primary = F.when(hit, publisher).otherwise(name), F.when(hit, F.lit(first)).otherwise(primary)
    return pages.withColumn("publisher", name).withColumn("is_primary", primary)


#: How a bank's Markdown marks papers, sections to ignore, sources and questions.
BANK_PAPER, BANK_TITLE, BANK_IGNORED, BANK_SOURCE = r"^##\s+Section:\s*(.+)$", r"^#\s+([^#].*)$", r"(?i)^##\s+Duplicate", r"^\s*\*Source:\s*`([^`]+)`"
BANK_SECTION, BANK_PART, BANK_ROW = r"^##\s+([^#].*)$", r"^###\s+(.+)$", r"^\|\s*(\d+)\s*\|(.+?)\|(.+?)\|(.+?)\|\s*$"


def paper_identity(title: Column) -> dict[str, Column]:
    """slug, year, stage and paper that the heading of a paper names: headings of one paper may differ in all else."""
    year = F.nullif(F.regexp_extract(title, r"(20\d{2})", 1), F.lit(""))
    mains, number = title.rlike("(?i)mains"), F.lower(F.regexp_extract(title, r"(?i)paper\s*[-–]?\s*([IVX]+|\d+)", 1))
    roman = F.lit(None).cast("int")
    for k, name in enumerate(("i", "ii", "iii", "iv", "v"), 1):
        roman = F.when(number == name, k).otherwise(roman)
    n = F.coalesce(roman, F.when(number.rlike(r"^\d+$"), number).cast("int"))
    stage = F.when(mains, "mains").otherwise("prelims")
    paper = F.when(mains, F.concat(F.lit("paper-"), F.coalesce(F.when(n > 0, n), F.lit(1)).cast("string"))).otherwise("screening")
    return {"slug": F.concat_ws("-", F.lit("g2"), F.coalesce(year, F.lit("null")), stage, paper, F.lit("bank")), "year": year.cast("int"), "stage": stage, "paper": paper}


def bank_format(label: Column) -> Column:
    """The format that a label names, with or without a remark in brackets after it; null for an unknown one."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))
    named = F.create_map(*[F.lit(x) for pair in BANK_FORMATS.items() for x in pair])
    return F.coalesce(named[key], named[F.regexp_replace(key, r"\s*\([^)]*\)\s*$", "")])


def question_bank(lines: DataFrame) -> DataFrame:
    """Questions of Markdown banks, ``lines`` (file, line_no, value): file, line_no, slug, year, stage, paper, title, section, source, q_no, gloss, keywords, format_label, format.

    What a line belongs to is carried forward over its file: a paper's heading ends the section and what was ignored before; a heading of
    duplicates ignores all until the next heading of its rank; sections and parts name what follows; a paper's source is its first one.
    Questions before the first paper, and ignored ones, are none.
    """
    v = F.col("value")
    head = F.when(v.rlike(BANK_PAPER), F.trim(F.regexp_extract(v, BANK_PAPER, 1))).when(v.rlike(BANK_TITLE), F.trim(F.regexp_extract(v, BANK_TITLE, 1)))
    section = F.when(~v.rlike(BANK_IGNORED) & v.rlike(BANK_SECTION), F.trim(F.regexp_extract(v, BANK_SECTION, 1))).when(v.rlike(BANK_PART), F.trim(F.regexp_extract(v, BANK_PART, 1)))
    w = W.Window.partitionBy("file").orderBy("line_no")
    carried = lambda c: F.last(c, ignorenulls=True).over(w)
    # A file's lines are sorted three times in one task.
    m = dealt(lines, "file").withColumn("head", head)
    m = m.withColumn("section", F.when(F.col("head").isNotNull(), "").otherwise(section)).withColumn("ignored", F.when(F.col("head").isNotNull(), False).when(v.rlike(BANK_SECTION), v.rlike(BANK_IGNORED)))
    m = m.withColumn("block", F.count("head").over(w)).withColumn("title", carried("head")).withColumn("section", carried("section")).withColumn("ignored", carried("ignored"))
    m = m.withColumn("source", F.first(F.nullif(F.regexp_extract(v, BANK_SOURCE, 1), F.lit("")), ignorenulls=True).over(W.Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
    rows = m.filter("block > 0 and not ignored").filter(v.rlike(BANK_ROW))
    cell = lambda k: F.trim(F.regexp_extract(v, BANK_ROW, k))
    words = F.transform(F.split(cell(3), ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\*\(.*?\)\*", ""), "[*_]", "")))
    who = [c.alias(name) for name, c in paper_identity(F.col("title")).items()]
    return rows.select("file", "line_no", *who, "title", "section", "source", cell(1).cast("int").alias("q_no"), cell(2).alias("gloss"), F.filter(words, lambda x: x != "").alias("keywords"), cell(4).alias("format_label"), bank_format(cell(4)).alias("format"))


def bank_questions(bank: DataFrame) -> DataFrame:
    """The first row of each paper and question number of ``question_bank``, in the order of files and lines."""
    first = F.row_number().over(W.Window.partitionBy("slug", "q_no").orderBy("file", "line_no"))
    return bank.withColumn("_k", first).filter("_k = 1").drop("_k")


def bank_papers(bank: DataFrame) -> DataFrame:
    """Each paper once, whatever its headings: slug, n, first_q, last_q, titles, sources, twice (question numbers that occur again, of which one row stays)."""
    numbers = bank.groupBy("slug", "q_no").agg(F.count("*").alias("n"), F.collect_set("title").alias("t"), F.collect_set("source").alias("s"))
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return numbers.groupBy("slug").agg(F.sum("n").alias("n"), F.min("q_no").alias("first_q"), F.max("q_no").alias("last_q"), sets("t").alias("titles"), sets("s").alias("sources"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("q_no")))).alias("twice"))


def resumed(log: DataFrame) -> DataFrame:
    """The last row of each key of a JSON-lines log (line_no, key, state)."""
    return log.groupBy("key").agg(F.max(F.struct("line_no", "state"))["state"].alias("state"))


def resume_state(lines: DataFrame) -> DataFrame:
    """key and state (the whole row) of the last row of each key of a log of JSON lines (line_no, value); a line that was cut off is none."""
    key = F.get_json_object("value", "$.key")
    whole = lines.filter(F.from_json("value", "map<string, string>", {"mode": "PERMISSIVE"}).isNotNull() & key.isNotNull())
    return resumed(whole.select(key.alias("key"), "line_no", F.col("value").alias("state")))


def candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of files that hold a JSON array each; a file that is none fails."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)


def new_uploads(files: DataFrame, known: DataFrame) -> DataFrame:
    """PDF ``files`` (publication, day, content) not yet in ``known`` (publication, day, file_hash), once each."""
    f = files.filter(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("publication", "day", F.sha2("content", 256).alias("file_hash")).distinct()
    return f.join(known, ["publication", "day", "file_hash"], "left_anti")
