"""Documents written out: Markdown digests and nested JSON compendia."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.markdown import facts_list, hard_breaks, hook, recap, reheaded, sections, tidy


def markdown_digest(items: DataFrame) -> DataFrame:
    """``items`` (day, bucket, item_id, headline, body) -> day, markdown: front matter, then the buckets with their items in order. A day is one row."""
    entry = F.concat(F.lit("### "), "headline", F.lit("\n\n"), "body", F.lit("\n"))
    by_bucket = items.groupBy("day", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("t"), F.count("*").alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "t"))), lambda x: F.concat(F.lit("## "), x["bucket"], F.lit("\n\n"), x["t"])), "\n")
    return by_bucket.groupBy("day").agg(parts.alias("s"), F.sum("n").alias("n")).select("day", F.concat(F.lit("---\ndate: "), F.col("day").cast("string"), F.lit("\nitems: "), F.col("n").cast("string"), F.lit("\n---\n\n"), "s").alias("markdown"))


#: How formats are named beside a question.
FORMAT_LABELS = {"direct_recall": "Direct recall", "negative_statement": "Incorrect statement", "assertion_reason": "Assertion–Reason", "statement_based": "Two statements", "multi_statement": "Multi-statement", "chronological": "Chronological", "list_matching": "List matching", "count_based": "How many"}


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _texts(rows: DataFrame, keys: list[str], order: list[str], text: Column, name: str, between: str = "\n") -> DataFrame:
    """``text`` of the rows of each key, in order, as one."""
    each = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda x: x["_t"])
    return rows.groupBy(*keys).agg(F.array_join(each, between).alias(name), F.count("*").alias(f"{name}_n"))


def full_digest(items: DataFrame, questions: DataFrame, buckets: list[tuple[str, str]], source: str = "", draft: bool = False) -> DataFrame:
    """day, markdown: a day's items under their buckets (name, heading; in that order), with notes, facts and questions, and the answer key at the end.

    ``items``: day, bucket, item_id, headline, salvaged, verify_note (null: nothing to verify), notes, facts; ``questions``: item_id, q, format, question, option_a to
    option_d, correct, explanation. Salvaged items stand last, under "Miscellaneous". Items and questions are numbered through the day. A day is one row of text: as long as what is read in a day.
    """
    place = F.lit(None).cast("int")
    heading = F.lit(None).cast("string")
    for k, (name, title) in enumerate(buckets):
        place, heading = F.when(F.col("bucket") == name, k).otherwise(place), F.when(F.col("bucket") == name, title).otherwise(heading)
    i = items.withColumn("place", F.when(F.col("salvaged"), len(buckets)).otherwise(place)).withColumn("heading", F.when(F.col("salvaged"), "Miscellaneous").otherwise(heading)).filter("place is not null")
    i = i.withColumn("n", F.row_number().over(W.Window.partitionBy("day").orderBy("place", "item_id")))
    labels = F.create_map(*[F.lit(x) for kv in FORMAT_LABELS.items() for x in kv])
    q = questions.join(i.select("day", "item_id", "n"), "item_id").withColumn("number", F.row_number().over(W.Window.partitionBy("day").orderBy("n", "q")))
    options = [F.concat(F.lit(f"\n- ({x}) "), tidy(F.col(f"option_{x}"))) for x in "abcd"]
    asked = F.concat(F.lit("**Q"), F.col("number").cast("string"), F.lit(".** _("), F.coalesce(labels[F.col("format")], F.lit("Direct recall")), F.lit(")_\n\n"), hard_breaks(F.col("question")), F.lit("\n"), *options, F.lit("\n"))
    solved = F.concat(F.lit("**Q"), F.col("number").cast("string"), F.lit("** — **("), F.col("correct"), F.lit(")**  _(item "), F.col("n").cast("string"), F.lit(")_\n"), F.when(tidy(F.col("explanation")) != "", F.concat(F.lit("\n"), tidy(F.col("explanation")), F.lit("\n"))).otherwise(""))
    i = i.join(_texts(q, ["item_id"], ["number"], asked, "asked"), "item_id", "left")
    part = lambda c, before, text: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), text, F.lit("\n\n"))).otherwise("")
    note = F.when(F.col("verify_note").isNotNull(), F.concat(F.lit("> ⚠ **Verify:** "), F.coalesce(F.nullif(tidy(F.col("verify_note")), F.lit("")), F.lit("A figure or name in this item is unconfirmed.")), F.lit("\n\n"))).otherwise("")
    body = F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), tidy(F.col("headline")), F.lit("\n\n"), note, part(F.col("notes"), "", reheaded(F.col("notes"), 4)), part(F.col("facts"), "#### Facts\n\n", facts_list(F.col("facts"))), part(F.col("asked"), "#### Questions\n\n", F.col("asked")))
    under = _texts(i, ["day", "place", "heading"], ["n"], body, "under", "")
    day = _texts(under, ["day"], ["place"], F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("under")), "all", "")
    day = day.drop("all_n").join(i.groupBy("day").agg(F.count("*").alias("items")), "day").join(_texts(q, ["day"], ["number"], solved, "key"), "day", "left").withColumn("key_n", F.coalesce("key_n", F.lit(0)))
    long_date = F.date_format(F.to_date("day"), "EEEE, d MMMM yyyy")
    counts = F.concat(F.lit(f"{source} · " if source else ""), _plural(F.col("items"), "item"), F.lit(" · "), _plural(F.col("key_n"), "question"), F.lit("\n\n"))
    front = F.concat(F.lit('---\ntitle: "Current Affairs — '), long_date, F.lit('"\ndate: '), F.col("day"), F.lit(f'\nsource: "{source}"' if source else ""), F.lit("\nitems: "), F.col("items").cast("string"), F.lit("\nquestions: "), F.col("key_n").cast("string"), F.lit("\nstatus: draft" if draft else ""), F.lit("\n---\n\n"))
    warning = F.lit("> **DRAFT — not published.** These items have not been reviewed.\n> Facts and question keys may be wrong. Do not circulate.\n\n" if draft else "")
    key = F.when(F.col("key_n") > 0, F.concat(F.lit("---\n\n## Answer key\n\n"), F.col("key"), F.lit("\n"))).otherwise("")
    return day.select("day", F.concat(front, F.lit("# Current Affairs — "), long_date, F.lit("\n\n"), counts, warning, F.col("all"), key).alias("markdown"))


def compendium(items: DataFrame, questions: DataFrame) -> DataFrame:
    """One JSON document a day: sections of topics, numbered through the day, each with its questions (item_id, q, stem, answer)."""
    numbered = items.withColumn("n", F.row_number().over(W.Window.partitionBy("day").orderBy("section", "item_id")))
    asked = questions.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("q", "stem", "answer"))).alias("questions"))
    topics = numbered.join(asked, "item_id", "left").select("day", "section", F.struct("n", "title", F.coalesce("questions", F.array().cast("array<struct<q:int,stem:string,answer:string>>")).alias("questions")).alias("topic"))
    by_section = topics.groupBy("day", "section").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    return by_section.groupBy("day").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("section", "topics"))).alias("sections"))).alias("document"))


def compendium_topics(items: DataFrame) -> DataFrame:
    """``items`` (with note, facts: one a line, link) as topics: their sections, facts as a list, a hook and a recap of three lines."""
    facts = F.filter(F.transform(F.split(F.coalesce("facts", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    t = items.withColumn("_facts", facts).withColumn("sections", sections(F.col("note")))
    paragraphs = F.flatten(F.transform(F.filter("sections", lambda s: s["type"] == "p"), lambda s: s["items"]))
    return t.withColumn("hook", hook(F.col("_facts"))).withColumn("recap", recap(paragraphs, F.col("_facts"), F.col("link"))).withColumn("facts", F.col("_facts")).drop("_facts", "note", "link")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
