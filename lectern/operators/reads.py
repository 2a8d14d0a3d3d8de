"""Building blocks of composite reads: time windows, explicit lists, cards, due queues, coverage, plans and dossiers."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import dateline, like_literal, n_words
from lectern.operators.relational import first_k, listed
from lectern.operators.schedule import required_seconds


def in_window(day: Column, scope: str = "range", start: str | None = None, end: str | None = None, month: str | None = None, date: str | None = None) -> tuple[Column, str]:
    """A condition on a day and a label: one day, one month, between two days, since one, up to one, or all. Conditions are ranges, which prune."""
    d = lambda x: F.lit(x).cast("date")
    if scope == "day" and date:
        return day == d(date), date
    if scope == "month" and month:
        return in_month(day, month), month
    if start and end:
        return day.between(d(start), d(end)), f"{start} → {end}"
    if start:
        return day >= d(start), f"since {start}"
    if end:
        return day <= d(end), f"up to {end}"
    return F.lit(True), "all published"


def in_month(day: Column, month: str) -> Column:
    """A range from the first of ``month`` (YYYY-MM) to the first of the next one; ``day`` may be a date or a timestamp."""
    first = datetime.date.fromisoformat(f"{month}-01")
    after = (first + datetime.timedelta(days=32)).replace(day=1)
    return (day >= F.lit(first)) & (day < F.lit(after))


def item_ids(value: str | None) -> list[int] | None:
    """``41,52,63`` as ids; what is no positive whole number goes. None where nothing is asked, which is not the same as an empty list."""
    if value is None or value == "":
        return None
    return sorted({int(x) for x in value.split(",") if x.strip().isdecimal() and int(x) > 0})


def cap_of(value: str | None, default: int, most: int) -> int:
    """A limit: 0 and "all" mean none (0), what is no number means the default, and numbers end at ``most``."""
    text = (value or "").strip().lower()
    if text in ("0", "all"):
        return 0
    return min(int(text), most) if text.isdecimal() else default


def chosen(pool: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """``pool`` with chosen: whether the row is in an explicit list (of one request, so it is sent to the rows)."""
    wanted = pool.sparkSession.createDataFrame([(i,) for i in ids], f"{key} long").withColumn("_in", F.lit(True))
    return pool.join(F.broadcast(wanted), key, "left").withColumn("chosen", F.coalesce("_in", F.lit(False))).drop("_in")


def cards(df: DataFrame, heavy: list[str]) -> DataFrame:
    """``df`` without its ``heavy`` text columns, and with the number of their words."""
    words = sum((n_words(F.col(c)) for c in heavy), F.lit(0).cast("long"))
    return df.withColumn("words", words).drop(*heavy)


def window_counts(df: DataFrame, windows: list[tuple[Column, str]]) -> DataFrame:
    """label, items: rows inside each window, counted in one pass."""
    counted = df.agg(*[F.count_if(cond).alias(f"_{k}") for k, (cond, _) in enumerate(windows)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"_{k}").alias("items")) for k, (_, label) in enumerate(windows)])).alias("w")).select("w.*")


def due_queue(cards: DataFrame, items: DataFrame, questions: DataFrame, today: Column, k: int = 40) -> DataFrame:
    """``cards`` (user_id, kind, ref, box, due) due by ``today``: items and questions (kind says which table ``ref`` is of; orphans vanish), the ``k`` oldest of each reader and kind."""
    due = cards.filter(F.col("due") <= today)
    i = due.filter("kind = 'item'").join(items.select(F.col("item_id").alias("ref")), "ref").withColumn("item_id", F.col("ref"))
    q = due.filter("kind = 'mcq'").join(questions.select(F.col("mcq").alias("ref"), "item_id"), "ref")
    return first_k(i.unionByName(q), ["user_id", "kind"], [F.col("due"), F.col("ref")], k)


def answered(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``answers`` (attempt_id, user_id, mcq, selected, ts) to known ``questions`` (mcq, item_id, correct), marked here; options that are none of the four are refused."""
    valid = answers.filter(F.col("selected").isin("a", "b", "c", "d"))
    return valid.join(questions.select("mcq", "item_id", "correct"), "mcq").withColumn("is_correct", F.col("selected") == F.col("correct"))


def questions_attempted(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """user_id, item_id, mcq_count, attempted: of each item that a reader has answered questions of."""
    per_item = questions.groupBy("item_id").agg(F.count("*").alias("mcq_count"))
    done = answers.select("user_id", "mcq").distinct().join(questions.select("mcq", "item_id"), "mcq").groupBy("user_id", "item_id").agg(F.count("*").alias("attempted"))
    return done.join(per_item, "item_id").select("user_id", "item_id", "mcq_count", "attempted")


def placed(items: DataFrame, day: str, order: list[Column]) -> DataFrame:
    """``items`` with their position in the day, the day's total, and the items before and after."""
    one = W.Window.partitionBy(day)
    along = one.orderBy(*order)
    return items.withColumn("position", F.row_number().over(along)).withColumn("total", F.count("*").over(one)).withColumn("prev", F.lag("item_id").over(along)).withColumn("next", F.lead("item_id").over(along))


def clock(opened: DataFrame, words: DataFrame, now: DataFrame, wpm: int = 200) -> DataFrame:
    """Reading clocks of ``opened`` (user_id, item_id, ts): started (once, at the first opening), required seconds of the item's ``words``, remaining at the reader's ``now``, unlocked."""
    start = opened.groupBy("user_id", "item_id").agg(F.min("ts").alias("started"))
    c = start.join(words.select("item_id", required_seconds(F.col("words"), wpm).alias("required")), "item_id").join(now, "user_id")
    elapsed = F.unix_timestamp("now") - F.unix_timestamp("started")
    c = c.withColumn("remaining", F.greatest(F.lit(0), F.col("required") - elapsed).cast("long"))
    return c.select("user_id", "item_id", "started", "required", "remaining", (F.col("remaining") == 0).alias("unlocked"))


def coverage(chosen: DataFrame, pool: DataFrame, group: str, dimension: str, values: list[str]) -> DataFrame:
    """group, value, in_digest, in_day: rows of each of ``values``, those without any too."""
    count = lambda df, name: df.groupBy(group, F.col(dimension).alias("value")).agg(F.count("*").alias(name))
    grid = pool.select(group).distinct().withColumn("value", F.explode(F.array(*[F.lit(v) for v in values])))
    out = grid.join(count(chosen, "in_digest"), [group, "value"], "left").join(count(pool, "in_day"), [group, "value"], "left")
    return out.select(group, "value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_digest", "in_day")])


def papers_of(tags: DataFrame, broad: tuple[str, ...]) -> DataFrame:
    """``tags`` (item_id, ord, paper, on_topic) -> item_id, papers: each once, those of an on-topic unit first, ``broad`` ones last, else as first seen."""
    per = tags.groupBy("item_id", "paper").agg(F.min("ord").alias("ord"), F.max("on_topic").alias("on_topic"))
    per = per.select("item_id", "paper", (~F.col("on_topic")).alias("off"), F.col("paper").isin(*broad).alias("broad"), "ord")
    return listed(per, ["item_id"], ["off", "broad", "ord"], F.col("paper"), "papers")


def findings(topics: DataFrame, topic_units: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` units that an item's ``topics`` (item_id, topic, hits, head) can feed: from_headline, weight and place.

    Units that the same topics feed are equal in every item but for their order, so no more than the first ``k`` of such are joined.
    """
    fed = topic_units.filter("topic is not null").groupBy("unit").agg(F.sort_array(F.collect_list("topic")).alias("by"))
    topic_units = first_k(fed, ["by"], [F.col("unit")], k, "_k").select("unit", F.explode("by").alias("topic"))
    u = topics.join(topic_units, "topic").groupBy("item_id", "unit").agg(F.max("head").alias("from_headline"), F.sum("hits").alias("weight"))
    return first_k(u, ["item_id"], [F.col("from_headline").desc(), F.col("weight").desc(), F.col("unit")], k)


def evidence(keywords: DataFrame, asked: DataFrame, questions: DataFrame, angles: int = 4, examples: int = 2) -> DataFrame:
    """What was asked about an item's ``keywords`` (item_id, keyword; repeated ones count once): the ``angles`` asked most (``asked``: keyword, n, formats) and ``examples`` of the newest ``questions`` (keyword, question, year).

    Only a keyword's own newest questions can be among an item's, so no more of them are joined. An item's few keywords are gathered once and put in order where they are.
    """
    newest = first_k(questions, ["keyword"], [F.col("year").desc(), F.col("question")], examples, "_k").groupBy("keyword").agg(F.collect_list(F.struct((-F.col("year")).alias("y"), "question")).alias("newest"))
    angle = F.struct((-F.col("n")).alias("k"), "keyword", F.concat("keyword", F.lit(":"), F.col("n").cast("string"), F.lit(":"), "formats").alias("said"), "newest")
    said = asked.join(newest, "keyword", "left").select("keyword", angle.alias("a"))
    item = keywords.join(said, "keyword").groupBy("item_id").agg(F.array_sort(F.collect_set("a")).alias("a"))
    best = F.slice(F.array_sort(F.flatten(F.transform("a", lambda a: F.coalesce(a["newest"], F.array())))), 1, examples)
    joined = lambda xs, c: F.array_join(F.transform(xs, lambda x: x[c].cast("string")), ",")
    return item.select("item_id", joined(F.slice("a", 1, angles), "said").alias("angles"), F.when(F.size(best) > 0, joined(best, "question")).alias("examples"))


def tied(rows: DataFrame) -> DataFrame:
    """topic, unit, weight: in how many items each topic and each unit of ``rows`` (item_id, unit, topic: a struct of it, or null for none) meet. An item's topics and units are gathered once, not joined."""
    item = rows.filter("item_id is not null").groupBy("item_id").agg(F.collect_set("topic").alias("topics"), F.collect_set("unit").alias("units"))
    return item.select(F.explode("topics").alias("t"), "units").select("t.topic", F.explode("units").alias("unit")).groupBy("topic", "unit").agg(F.count("*").alias("weight"))


def relinked(prior: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new_id, item_id: rows made anew get the item of the ``prior`` row (ord, item_id) of equal ``keys`` (the last one), the first row of a key alone, and each item once."""
    old = prior.groupBy(*keys).agg(F.max(F.struct("ord", "item_id"))["item_id"].alias("item_id"))
    first = new.groupBy(*keys).agg(F.min("new_id").alias("new_id"))
    both = first.join(old, keys)
    return both.groupBy("item_id").agg(F.min("new_id").alias("new_id")).select("new_id", "item_id")


def search(items: DataFrame, columns: list[str], keywords: DataFrame, key: str, keyword: str, term: str | None, least: int = 2) -> DataFrame:
    """``items`` of which a column, or one of whose ``keywords`` (key, keyword), holds ``term``, letter case aside and wildcards taken literally. Terms of fewer than ``least`` characters find none."""
    term = (term or "").strip()
    if len(term) < least:
        return items.limit(0)
    holds = lambda c: F.coalesce(F.call_function("ilike", F.col(c), F.lit(like_literal(term)), F.lit("~")), F.lit(False))
    named = keywords.filter(holds(keyword)).select(key).distinct().withColumn("_named", F.lit(True))
    own = F.lit(False)
    for c in columns:
        own = own | holds(c)
    return items.join(named, key, "left").filter(own | F.col("_named").isNotNull()).drop("_named")


def remainder(judged: DataFrame, group: str, order: list[Column], least: int = 12, most: int = 35) -> DataFrame:
    """``judged`` (high, drafted) with place, target and already: rows still to be drafted of each group.

    The band is a budget of the day: its target is the rows that were read as high and those drafted before, between ``least`` and ``most``, and what has been drafted is taken off it.
    """
    t = judged.groupBy(group).agg(F.count_if(F.col("high") & ~F.col("drafted")).alias("wanted"), F.count_if("drafted").alias("already"))
    t = t.select(group, "already", F.greatest(F.lit(least), F.least(F.lit(most), F.col("wanted") + F.col("already"))).alias("target"))
    left = first_k(judged.filter(~F.col("drafted")), [group], order, most)
    return left.join(t, group).filter(F.col("place") <= F.greatest(F.lit(0), F.col("target") - F.col("already")))


def places(articles: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """doc_id, name, mentions of the places of ``articles`` (doc_id, text, byline): each of ``terms`` that the text holds, and the place that ends the byline, as titles."""
    low = F.lower(F.coalesce("text", F.lit("")))
    known = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t))
    line = F.lower(dateline(F.col("byline")))
    all_ = F.explode(F.filter(F.concat(known, F.array(line)), lambda x: x != ""))
    return articles.select("doc_id", all_.alias("name")).groupBy("doc_id", F.initcap("name").alias("name")).agg(F.count("*").alias("mentions"))
