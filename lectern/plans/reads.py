"""Composite reads: windows, selections, cards, queues, plans, coverage and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import local_day, n_words
from lectern.operators import ranking as K
from lectern.operators import reads as V
from lectern.operators import relational as R
from lectern.operators import schedule as S
from lectern.operators.quality import plain
from lectern.plans.relational import DIGEST, SHARES, month_digest
from lectern.plans.roles import answers, articles, attempts, day_text, days, item_units, items, mcqs, opened, query, reviewed, shown, table, units


def reading_order():
    return [F.col("bucket"), F.col("score").desc(), F.col("item_id")]


@query("card_projection", """
WITH {articles} SELECT doc_id, edition, headline, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS words FROM articles""")
def card_projection(spark, sf):
    """Cards for lists: no text, but how long it is."""
    return V.cards(articles(spark, sf).select("doc_id", "edition", "headline", "text"), ["text"])


_WINDOWS = ({"scope": "day", "date": "1997-03-05"}, {"scope": "month", "month": "1997-12"}, {"start": "1996-02-01", "end": "1996-02-29"}, {"start": "2000-06-15"}, {"end": "1995-01-31"}, {})


@query("window_resolver", """
WITH {items}, p AS (SELECT day FROM items WHERE status = 'published')
SELECT '1997-03-05' AS label, count(*)::BIGINT AS items FROM p WHERE day = '1997-03-05' UNION ALL SELECT '1997-12', count(*) FROM p WHERE strftime(day, '%Y-%m') = '1997-12'
UNION ALL SELECT '1996-02-01 → 1996-02-29', count(*) FROM p WHERE day BETWEEN '1996-02-01' AND '1996-02-29' UNION ALL SELECT 'since 2000-06-15', count(*) FROM p WHERE day >= '2000-06-15'
UNION ALL SELECT 'up to 1995-01-31', count(*) FROM p WHERE day <= '1995-01-31' UNION ALL SELECT 'all published', count(*) FROM p""")
def window_resolver(spark, sf):
    """Published items in windows of all six kinds."""
    return V.window_counts(R.visible(items(spark, sf)), [V.in_window(F.col("day"), **w) for w in _WINDOWS])


@query("month_range", "SELECT o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-12'")
def month_range(spark, sf):
    """Items of a month, by a range that reaches the scan."""
    o = table(spark, sf, "orders").filter(V.in_month(F.col("o_orderdate"), "1997-12"))
    return o.select(F.col("o_orderkey").alias("item_id"), day_text(F.col("o_orderdate")).alias("day"))


@query("explicit_selection", """
WITH {items}, {shown} SELECT item_id, item_id IN (5, 17, 23, 104, 40000) AS chosen FROM shown WHERE day < DATE '1996-01-01' OR item_id IN (5, 17, 23, 104)""")
def explicit_selection(spark, sf):
    """An explicit list of ids over a pool; ids that the pool does not hold are of no effect."""
    pool = shown(spark, sf).filter((F.col("day") < F.lit("1996-01-01").cast("date")) | F.col("item_id").isin(5, 17, 23, 104)).select("item_id")
    return V.chosen(pool, "item_id", V.item_ids("5, 17,x,-3,40000,23,104,,5"))


@query("check_constraints", """
SELECT o_orderkey AS item_id, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'bucket' END, CASE WHEN o_totalprice > 450000 THEN 'score' END) AS broken
FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR o_orderpriority = '5-LOW' OR o_totalprice > 450000""")
def check_constraints(spark, sf):
    """Rows that break a constraint, with the names of those they break."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "item_id")
    bad = R.violations(o, "item_id", {"status": F.col("o_orderstatus").isin("O", "F"), "bucket": F.col("o_orderpriority") != "5-LOW", "score": F.col("o_totalprice") <= 450000})
    return bad.select("item_id", F.array_join("broken", ",").alias("broken"))


@query("question_units", """
WITH {items}, {shown}, {mcqs}, {reviewed}, {units} SELECT mcq, item_id, r.unit, label, exam FROM reviewed r LEFT JOIN units u ON u.unit = r.unit AND NOT broad""")
def question_units(spark, sf):
    """Questions with their units' labels; those of retired units still show."""
    u = units(spark, sf).filter("not broad").select("unit", "label", "exam")
    return reviewed(spark, sf).select("mcq", "item_id", "unit").join(u, "unit", "left").select("mcq", "item_id", "unit", "label", "exam")


_CARDS = """e AS (SELECT user_id, event_type, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, ts FROM events WHERE event_type IN ('view', 'click')),
cards AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'item' ELSE 'mcq' END AS kind, CASE event_type WHEN 'view' THEN k ELSE k * 10 + 1 + k % 7 END AS ref, least(5, count(*)) AS box, max(ts + INTERVAL 330 MINUTES)::DATE AS last FROM e GROUP BY ALL),
dated AS (SELECT *, last + [1, 3, 7, 14, 30][box] AS due FROM cards)"""


def _cards(spark, sf):
    e = attempts(spark, sf).filter(F.col("event_type").isin("view", "click"))
    is_item = F.col("event_type") == "view"
    ref = F.when(is_item, F.col("mcq")).otherwise(F.col("mcq") * 10 + 1 + F.col("mcq") % 7)
    g = e.groupBy("user_id", F.when(is_item, "item").otherwise("mcq").alias("kind"), ref.alias("ref")).agg(F.least(F.lit(5), F.count("*")).alias("box"), F.max("ts").alias("at"))
    return g.select("user_id", "kind", "ref", "box", F.date_add(local_day(F.col("at")), S.due_in(F.col("box"))).alias("due"))


@query("due_queue", f"""
WITH {{items}}, {{shown}}, {{mcqs}}, {{reviewed}}, {_CARDS},
j AS (SELECT d.*, item_id FROM dated d JOIN shown s ON kind = 'item' AND s.item_id = ref UNION ALL SELECT d.*, item_id FROM dated d JOIN reviewed r ON kind = 'mcq' AND r.mcq = ref),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY due, ref) AS place FROM j WHERE due <= DATE '2024-02-01')
SELECT user_id, kind, ref, item_id, box::BIGINT AS box, strftime(due, '%Y-%m-%d') AS due, place::INT AS place FROM p WHERE place <= 40""")
def due_queue(spark, sf):
    """What each reader has to revise today: items and questions."""
    q = V.due_queue(_cards(spark, sf), shown(spark, sf), reviewed(spark, sf), F.lit("2024-02-01").cast("date"))
    return q.select("user_id", "kind", "ref", "item_id", "box", day_text(F.col("due")).alias("due"), "place")


@query("answer_check", """
WITH {items}, {shown}, {mcqs}, {reviewed}, {answers} SELECT attempt_id, user_id, mcq, item_id, selected, correct, selected = correct AS is_correct FROM answers JOIN reviewed USING (mcq) WHERE selected <> 'e'""")
def answer_check(spark, sf):
    """Answers marked against the key; unknown questions and options are refused."""
    return V.answered(answers(spark, sf), reviewed(spark, sf)).select("attempt_id", "user_id", "mcq", "item_id", "selected", "correct", "is_correct")


@query("questions_attempted", """
WITH {items}, {shown}, {mcqs}, {reviewed}, {answers}, n AS (SELECT item_id, count(*) AS n FROM reviewed GROUP BY ALL)
SELECT user_id, item_id, any_value(n)::BIGINT AS mcq_count, count(DISTINCT mcq)::BIGINT AS attempted FROM answers JOIN reviewed USING (mcq) JOIN n USING (item_id) GROUP BY ALL""")
def questions_attempted(spark, sf):
    """Of each item that a reader has met: its questions, and how many of them they have answered."""
    return V.questions_attempted(answers(spark, sf), reviewed(spark, sf))


@query("item_tags", """
WITH {items}, {shown}, {item_units}, {units}, {mcqs}, {reviewed}, {bookmarks},
t AS (SELECT item_id, string_agg(iu.unit || ':' || coalesce(paper, ''), ',' ORDER BY iu.unit) AS tags FROM item_units iu LEFT JOIN units u ON u.unit = iu.unit AND NOT broad GROUP BY item_id),
q AS (SELECT item_id, count(*) AS n FROM reviewed GROUP BY ALL), b AS (SELECT item_id, count(*) AS n FROM bookmarks GROUP BY ALL)
SELECT s.item_id, coalesce(tags, '') AS tags, coalesce(q.n, 0)::BIGINT AS questions, coalesce(b.n, 0)::BIGINT AS saved FROM shown s LEFT JOIN t USING (item_id) LEFT JOIN q USING (item_id) LEFT JOIN b USING (item_id)""")
def item_tags(spark, sf):
    """Items with their units, questions and savers: one aggregate and one join for each, none a row."""
    u = units(spark, sf).filter("not broad").select("unit", "paper")
    t = item_units(spark, sf).join(u, "unit", "left")
    tags = R.listed(t, ["item_id"], ["unit"], F.concat(F.col("unit").cast("string"), F.lit(":"), F.coalesce("paper", F.lit(""))), "tags")
    n = lambda df, name: df.groupBy("item_id").agg(F.count("*").alias(name))
    out = shown(spark, sf).select("item_id").join(tags, "item_id", "left").join(n(reviewed(spark, sf), "questions"), "item_id", "left").join(n(opened(spark, sf, "purchase"), "saved"), "item_id", "left")
    return out.fillna(0, ["questions", "saved"]).fillna("", ["tags"])


@query("library_reuse_map", """
SELECT l_suppkey AS topic, count(DISTINCT l_orderkey)::BIGINT AS items, count(DISTINCT l_partkey)::BIGINT AS units, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS papers
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(DISTINCT p_brand) >= 2""")
def library_reuse_map(spark, sf):
    """Topics that reach two papers or more, broad units included."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"))
    n = l.select("topic", "item_id").distinct().groupBy("topic").agg(F.count("*").alias("items"))
    u = l.select("topic", "unit").distinct().join(units(spark, sf).select("unit", "paper"), "unit").groupBy("topic").agg(F.count("*").alias("units"), F.collect_set("paper").alias("papers")).filter("size(papers) >= 2")
    return n.join(u, "topic").select("topic", "items", "units", F.array_join(F.array_sort("papers"), ",").alias("papers"))


@query("scoring_context", """
SELECT 'keyword' AS kind, lower(p_name) AS key, count(*)::BIGINT AS n FROM part GROUP BY ALL
UNION ALL SELECT 'topic', l_suppkey::VARCHAR, count(DISTINCT p_brand) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 45 GROUP BY ALL""")
def scoring_context(spark, sf):
    """What the score looks up: how often each keyword was asked, and how many papers each topic feeds."""
    asked = table(spark, sf, "part").groupBy(F.lit("keyword").alias("kind"), F.lower("p_name").alias("key")).agg(F.count("*").alias("n"))
    pairs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_partkey").alias("unit")).distinct()
    papers = pairs.join(units(spark, sf).filter("not broad").select("unit", "paper"), "unit").select("topic", "paper").distinct().groupBy(F.lit("topic").alias("kind"), F.col("topic").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return asked.union(papers)


@query("derived_topic_units", """
WITH {item_units}, {units}, ti AS (SELECT DISTINCT s_nationkey AS topic, l_orderkey AS item_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), man AS (SELECT p_partkey % 25 AS topic, p_partkey AS unit FROM part WHERE p_size <= 10)
SELECT topic, unit, count(*)::BIGINT AS weight FROM ti JOIN item_units iu USING (item_id) JOIN units USING (unit) WHERE NOT broad AND NOT EXISTS (SELECT 1 FROM man m WHERE m.topic = ti.topic AND m.unit = iu.unit) GROUP BY ALL""")
def derived_topic_units(spark, sf):
    """How many items tie each topic to each unit that can be fed; rows set by hand are left to themselves."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("topic"))
    topic = F.struct(F.col("topic").cast("long").alias("topic"))
    l = table(spark, sf, "lineitem").join(s.withColumn("_fed", F.lit(True)), "l_suppkey", "left").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"), F.when(F.col("_fed"), topic).alias("topic"))
    by_hand = table(spark, sf, "part").filter("p_size <= 10").select((F.col("p_partkey") % 25).alias("topic"), F.col("p_partkey").alias("unit"))
    weighed = V.tied(l).join(by_hand, ["topic", "unit"], "left_anti")
    return weighed.join(units(spark, sf).filter("not broad").select("unit"), "unit", "left_semi").select("topic", "unit", "weight")


@query("draft_findings", """
WITH {items}, {shown}, tu AS (SELECT p_partkey % 25 AS topic, p_partkey AS unit FROM part WHERE p_partkey % 7 = 0),
met AS (SELECT l_orderkey AS item_id, s_nationkey AS topic, sum(l_quantity)::BIGINT AS hits, max(l_quantity) >= 48 AS head FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey IN (SELECT item_id FROM shown) GROUP BY ALL),
u AS (SELECT item_id, unit, bool_or(head) AS from_headline, sum(hits) AS weight FROM met JOIN tu USING (topic) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY from_headline DESC, weight DESC, unit) AS place FROM u)
SELECT item_id, unit, from_headline, weight::BIGINT AS weight, place::INT AS place FROM p WHERE place <= 6""")
def draft_findings(spark, sf):
    """The six units that an item's topics make likeliest."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("topic"))
    l = table(spark, sf, "lineitem").join(shown(spark, sf).select(F.col("item_id").alias("l_orderkey")), "l_orderkey", "left_semi").join(s, "l_suppkey")
    topics = l.groupBy(F.col("l_orderkey").alias("item_id"), "topic").agg(F.sum("l_quantity").cast("long").alias("hits"), (F.max("l_quantity") >= 48).alias("head"))
    tu = table(spark, sf, "part").filter("p_partkey % 7 = 0").select((F.col("p_partkey") % 25).alias("topic"), F.col("p_partkey").alias("unit"))
    return V.findings(topics, tu)


@query("past_question_evidence", """
WITH {items}, {shown}, {item_units}, {units}, ak AS (SELECT DISTINCT item_id, label AS keyword FROM item_units JOIN units USING (unit) JOIN shown USING (item_id)),
n AS (SELECT p_name AS keyword, count(*) AS n, string_agg(DISTINCT (p_size % 5)::VARCHAR, '/' ORDER BY (p_size % 5)::VARCHAR) AS formats FROM part GROUP BY ALL),
a AS (SELECT item_id, keyword, n, formats, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, keyword) AS place FROM ak JOIN n USING (keyword)),
e AS (SELECT item_id, p_partkey AS question, row_number() OVER (PARTITION BY item_id ORDER BY p_size DESC, p_partkey) AS place FROM ak JOIN part ON p_name = keyword WHERE length(p_name || ' of ' || p_type) BETWEEN 15 AND 18),
x AS (SELECT item_id, string_agg(question::VARCHAR, ',' ORDER BY place) AS examples FROM e WHERE place <= 2 GROUP BY item_id)
SELECT item_id, string_agg(keyword || ':' || n || ':' || formats, ',' ORDER BY place) AS angles, any_value(examples) AS examples FROM a LEFT JOIN x USING (item_id) WHERE place <= 4 GROUP BY item_id""")
def past_question_evidence(spark, sf):
    """What was asked before about an item's keywords: the commonest angles and the newest examples of fitting length."""
    tags = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"))
    k = tags.join(units(spark, sf).select("unit", F.col("label").alias("keyword")), "unit").join(shown(spark, sf).select("item_id"), "item_id", "left_semi").select("item_id", "keyword")
    p = table(spark, sf, "part")
    asked = p.groupBy(F.col("p_name").alias("keyword")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set((F.col("p_size") % 5).cast("string"))), "/").alias("formats"))
    stem = F.concat("p_name", F.lit(" of "), "p_type")
    return V.evidence(k, asked, p.filter(F.length(stem).between(15, 18)).select(F.col("p_name").alias("keyword"), F.col("p_partkey").alias("question"), F.col("p_size").alias("year")))


_HEAD60 = "substr(trim(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g')), 1, 60)"


@query("relink_prior", f"""
WITH {{articles}}, k AS (SELECT doc_id, edition, doc_id % 2 AS page, {_HEAD60} AS head FROM articles),
o AS (SELECT edition, page, head, max_by(doc_id * 2 + 1, doc_id) AS item_id FROM k WHERE doc_id % 3 = 0 GROUP BY ALL), n AS (SELECT edition, page, head, min(doc_id + 1000000) AS new_id FROM k GROUP BY ALL)
SELECT new_id, item_id FROM n JOIN o USING (edition, page, head)""")
def relink_prior(spark, sf):
    """Articles read again get back the items that their earlier selves produced, by page and opening of the headline."""
    k = articles(spark, sf).select("doc_id", "edition", (F.col("doc_id") % 2).alias("page"), F.substring(plain(F.col("headline")), 1, 60).alias("head"))
    prior = k.filter("doc_id % 3 = 0").select("edition", "page", "head", F.col("doc_id").alias("ord"), (F.col("doc_id") * 2 + 1).alias("item_id"))
    return V.relinked(prior, k.select("edition", "page", "head", (F.col("doc_id") + 1000000).alias("new_id")), ["edition", "page", "head"])


SECTIONS = [f"s{k}" for k in range(8)]
BROAD = ("Brand#1", "Brand#13")
_SECTION = """v AS (SELECT item_id, unit, CASE WHEN unit % 9 < 8 THEN 's' || unit % 9 END AS section, CASE WHEN unit % 7 = 0 THEN 1 ELSE 2 END AS w FROM item_units),
sw AS (SELECT item_id, section, sum(w) AS w FROM v WHERE section IS NOT NULL GROUP BY ALL),
sb AS (SELECT item_id, first(section ORDER BY w DESC, section) AS section FROM sw GROUP BY item_id),
sec AS (SELECT i.item_id, coalesce(sb.section, 's3') AS section FROM (SELECT DISTINCT item_id FROM v) i LEFT JOIN sb USING (item_id))"""


def _tagged(spark, sf):
    v = item_units(spark, sf).select("item_id", "unit", F.when(F.col("unit") % 9 < 8, F.concat(F.lit("s"), (F.col("unit") % 9).cast("string"))).alias("unit_section"))
    votes = v.select("item_id", F.col("unit_section").alias("section"), F.when(F.col("unit") % 7 == 0, 1).otherwise(2).alias("w"), (F.col("unit") % 9).alias("ord"))
    return v, K.vote(votes, "item_id", "section", "w", "ord", "s3").select("item_id", "section")


@query("papers_for_item", f"""
WITH {{item_units}}, {{units}}, {_SECTION},
g AS (SELECT v.item_id, paper, bool_or(v.section IS NOT DISTINCT FROM sec.section) AS on_topic, min(unit) AS ord FROM v JOIN units USING (unit) JOIN sec USING (item_id) WHERE v.section IS NOT NULL GROUP BY ALL)
SELECT item_id, string_agg(paper, ',' ORDER BY NOT on_topic, paper IN {BROAD}, ord) AS papers FROM g GROUP BY item_id""")
def papers_for_item(spark, sf):
    """Papers that an item's units belong to: those of its own section first, the broad ones last."""
    v, section = _tagged(spark, sf)
    tags = v.filter("unit_section is not null").join(units(spark, sf).select("unit", "paper"), "unit").join(section, "item_id")
    return V.papers_of(tags.select("item_id", F.col("unit").alias("ord"), "paper", (F.col("unit_section") == F.col("section")).alias("on_topic")), BROAD)


_PICKED = f"{DIGEST}, d AS (SELECT month, bucket, item_id, score, position <= 15 OR tier = 0 AS chosen, position FROM p)"


def _pool(spark, sf):
    """Published items by month, with their places in the month's digest (null: not chosen)."""
    digest = month_digest(spark, sf).select("item_id", "position")
    return R.visible(items(spark, sf)).select(F.date_format("day", "yyyy-MM").alias("month"), "bucket", "item_id", "score").join(digest, "item_id", "left").withColumn("chosen", F.col("position").isNotNull())


@query("digest_coverage", f"""
WITH {{items}}, {{item_units}}, {_PICKED}, {_SECTION}, m AS (SELECT DISTINCT month FROM d),
s AS (SELECT d.*, coalesce(section, 's3') AS section FROM d LEFT JOIN sec USING (item_id)),
g AS (SELECT month, 'bucket' AS kind, unnest({list(SHARES)}) AS value FROM m UNION ALL SELECT month, 'section', unnest({SECTIONS}) FROM m),
c AS (SELECT month, 'bucket' AS kind, bucket AS value, count(*) FILTER (chosen) AS a, count(*) AS b FROM s GROUP BY ALL UNION ALL SELECT month, 'section', section, count(*) FILTER (chosen), count(*) FROM s GROUP BY ALL)
SELECT g.month, g.kind, g.value, coalesce(a, 0)::BIGINT AS in_digest, coalesce(b, 0)::BIGINT AS in_day FROM g LEFT JOIN c ON c.month = g.month AND c.kind = g.kind AND c.value = g.value""")
def digest_coverage(spark, sf):
    """Buckets and sections of each month's digest against all that the month has; those without any are named too."""
    pool = _pool(spark, sf).join(_tagged(spark, sf)[1], "item_id", "left").withColumn("section", F.coalesce("section", F.lit("s3")))
    both = [V.coverage(pool.filter("chosen"), pool, "month", c, values).withColumn("kind", F.lit(c)) for c, values in (("bucket", list(SHARES)), ("section", SECTIONS))]
    return both[0].unionByName(both[1]).select("month", "kind", "value", "in_digest", "in_day")


@query("digest_load", f"""
WITH {{items}}, {{mcqs}}, {_PICKED}, q AS (SELECT item_id, count(*) AS n FROM mcqs WHERE status = 'published' GROUP BY ALL), j AS (SELECT d.*, coalesce(n, 0) AS n FROM d LEFT JOIN q USING (item_id))
SELECT month, count(*)::BIGINT AS total, count(*) FILTER (chosen)::BIGINT AS chosen, count(*) FILTER (NOT chosen)::BIGINT AS omitted, coalesce(sum(least(n, 2)) FILTER (chosen), 0)::BIGINT AS questions, coalesce(sum(greatest(n - 2, 0)) FILTER (chosen), 0)::BIGINT AS questions_dropped FROM j GROUP BY month""")
def digest_load(spark, sf):
    """What a month's digest holds and leaves out, with two questions an item."""
    n = mcqs(spark, sf).filter("status = 'published'").groupBy("item_id").agg(F.count("*").alias("n"))
    j = _pool(spark, sf).join(n, "item_id", "left").fillna(0, ["n"])
    some = lambda c: F.coalesce(F.sum(F.when(F.col("chosen"), c)), F.lit(0)).cast("long")
    return j.groupBy("month").agg(F.count("*").alias("total"), F.count_if("chosen").alias("chosen"), F.count_if(~F.col("chosen")).alias("omitted"), some(F.least("n", F.lit(2))).alias("questions"), some(F.greatest(F.col("n") - 2, F.lit(0))).alias("questions_dropped"))


@query("digest_plan", f"""
WITH {{items}}, {{item_units}}, {{units}}, {{mcqs}}, {_PICKED}, {_SECTION}, q AS (SELECT item_id, count(*) AS n FROM mcqs WHERE status = 'published' GROUP BY ALL),
g AS (SELECT v.item_id, paper, bool_or(v.section IS NOT DISTINCT FROM sec.section) AS on_topic, min(unit) AS ord FROM v JOIN units USING (unit) JOIN sec USING (item_id) WHERE v.section IS NOT NULL GROUP BY ALL),
pp AS (SELECT item_id, string_agg(paper, ',' ORDER BY NOT on_topic, paper IN {BROAD}, ord) AS papers FROM g GROUP BY item_id)
SELECT month, item_id, bucket, chosen, CASE WHEN chosen THEN position END::INT AS position, least(coalesce(n, 0), 4)::BIGINT AS questions, coalesce(section, 's3') AS section, coalesce(papers, '') AS papers, bucket = '4-NOT SPECIFIED' AND papers IS NULL AS foreign_no_paper
FROM d LEFT JOIN sec USING (item_id) LEFT JOIN q USING (item_id) LEFT JOIN pp USING (item_id)""")
def digest_plan(spark, sf):
    """A month's digest before it is printed: what is in, what is out and what it would bring."""
    n = mcqs(spark, sf).filter("status = 'published'").groupBy("item_id").agg(F.count("*").alias("n"))
    j = _pool(spark, sf).join(n, "item_id", "left").join(_tagged(spark, sf)[1], "item_id", "left").join(papers_for_item(spark, sf), "item_id", "left")
    return j.select(
        "month", "item_id", "bucket", "chosen", "position", F.least(F.coalesce("n", F.lit(0)), F.lit(4)).cast("long").alias("questions"), F.coalesce("section", F.lit("s3")).alias("section"), F.coalesce("papers", F.lit("")).alias("papers"),
        ((F.col("bucket") == "4-NOT SPECIFIED") & F.col("papers").isNull()).alias("foreign_no_paper"),
    )


_PLACED = """placed AS (SELECT item_id, day, row_number() OVER w AS position, count(*) OVER (PARTITION BY day) AS total, lag(item_id) OVER w AS prev, lead(item_id) OVER w AS next FROM shown WINDOW w AS (PARTITION BY day ORDER BY bucket, score DESC, item_id)),
nd AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev_day, lead(day) OVER (ORDER BY day) AS next_day FROM (SELECT DISTINCT day FROM days WHERE status = 'published'))"""


def _published_days(spark, sf):
    return R.neighbours(days(spark, sf).filter("status = 'published'").select("day"), "day").withColumnsRenamed({"prev": "prev_day", "next": "next_day"})


@query("day_digest", f"""
WITH {{items}}, {{days}}, {{shown}}, {{item_units}}, {{mcqs}}, {{reviewed}}, {_PLACED}, t AS (SELECT item_id, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS units FROM item_units GROUP BY ALL), q AS (SELECT item_id, count(*) AS n FROM reviewed GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, position::INT AS position, item_id, coalesce(units, '') AS units, coalesce(n, 0)::BIGINT AS questions, strftime(prev_day, '%Y-%m-%d') AS prev_day, strftime(next_day, '%Y-%m-%d') AS next_day
FROM placed LEFT JOIN nd USING (day) LEFT JOIN t USING (item_id) LEFT JOIN q USING (item_id)""")
def day_digest(spark, sf):
    """A day as it is read: its items in order, with units and questions, and the days beside it."""
    t = R.listed(item_units(spark, sf), ["item_id"], ["unit"], F.col("unit"), "units")
    q = reviewed(spark, sf).groupBy("item_id").agg(F.count("*").alias("questions"))
    p = V.placed(shown(spark, sf), "day", reading_order()).select("day", "position", "item_id")
    out = p.join(_published_days(spark, sf), "day", "left").join(t, "item_id", "left").join(q, "item_id", "left").fillna(0, ["questions"]).fillna("", ["units"])
    return out.select(day_text(F.col("day")).alias("day"), "position", "item_id", "units", "questions", day_text(F.col("prev_day")).alias("prev_day"), day_text(F.col("next_day")).alias("next_day"))


@query("item_detail", f"""
WITH {{items}}, {{days}}, {{shown}}, {{mcqs}}, {{reviewed}}, {{views}}, {{bookmarks}}, {_PLACED},
q AS (SELECT item_id, string_agg(mcq::VARCHAR, ',' ORDER BY mcq) AS questions, count(*) AS n FROM reviewed GROUP BY item_id), met AS (SELECT user_id, item_id, bool_or(read) AS read FROM (SELECT user_id, item_id, true AS read FROM views UNION ALL SELECT user_id, item_id, false FROM bookmarks) GROUP BY ALL)
SELECT user_id, item_id, position::INT AS position, total::BIGINT AS total, prev, next, CASE WHEN next IS NULL THEN strftime(next_day, '%Y-%m-%d') END AS next_day, read AS marked_read, coalesce(n, 0)::BIGINT AS n_questions, CASE WHEN read THEN coalesce(questions, '') ELSE '' END AS questions
FROM met JOIN placed USING (item_id) LEFT JOIN nd USING (day) LEFT JOIN q USING (item_id)""")
def item_detail(spark, sf):
    """An item as a reader who read or saved it sees it: its place in the day, where to go on, and its questions once it is read."""
    met = opened(spark, sf, "view").select("user_id", "item_id", F.lit(True).alias("read")).union(opened(spark, sf, "purchase").select("user_id", "item_id", F.lit(False))).groupBy("user_id", "item_id").agg(F.max("read").alias("marked_read"))
    p = V.placed(shown(spark, sf), "day", reading_order()).select("day", "item_id", "position", "total", "prev", "next").join(_published_days(spark, sf).select("day", "next_day"), "day", "left")
    r = reviewed(spark, sf)
    q = R.listed(r, ["item_id"], ["mcq"], F.col("mcq"), "questions").join(r.groupBy("item_id").agg(F.count("*").alias("n_questions")), "item_id")
    j = met.join(p, "item_id").join(q, "item_id", "left")
    return j.select(
        "user_id", "item_id", "position", "total", "prev", "next", F.when(F.col("next").isNull(), day_text(F.col("next_day"))).alias("next_day"), "marked_read", F.coalesce("n_questions", F.lit(0)).cast("long").alias("n_questions"),
        F.when(F.col("marked_read"), F.coalesce("questions", F.lit(""))).otherwise("").alias("questions"),
    )


@query("bookmarks_newest", """
WITH {items}, {shown}, {bookmarks} SELECT user_id, item_id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, item_id)::INT AS place FROM bookmarks JOIN shown USING (item_id)""")
def bookmarks_newest(spark, sf):
    """What each reader saved, the newest first."""
    j = opened(spark, sf, "purchase").join(shown(spark, sf).select("item_id", "day"), "item_id")
    place = F.row_number().over(W.Window.partitionBy("user_id").orderBy(F.col("at").desc(), "item_id"))
    return j.select("user_id", "item_id", day_text(F.col("day")).alias("day"), place.alias("place"))


@query("session_list", """
WITH s AS (SELECT user_id, event_type AS scope, ts::DATE AS day, count(*) AS total, count(*) FILTER (value > 100) AS answered, count(*) FILTER (value > 250) AS correct, max(ts) AS seen_at FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen_at DESC, scope) AS place FROM s)
SELECT user_id, scope, strftime(day, '%Y-%m-%d') AS day, total::BIGINT AS total, answered::BIGINT AS answered, correct::BIGINT AS correct, place::INT AS place FROM p WHERE place <= 60""")
def session_list(spark, sf):
    """The last sixty sessions of each reader."""
    e = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("scope"), F.to_date("ts").alias("day"))
    s = e.agg(F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("answered"), F.count_if(F.col("value") > 250).alias("correct"), F.max("ts").alias("at"))
    return R.first_k(s, ["user_id"], [F.col("at").desc(), F.col("scope")], 60).drop("at").withColumn("day", day_text(F.col("day")))


@query("pacing_plan", """
WITH d AS (SELECT doc_id AS item_id, greatest(45, least(480, floor(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) * 60::DOUBLE / 200 + 0.5)))::BIGINT AS required FROM documents),
v AS (SELECT user_id, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS item_id, min(ts) AS started FROM events WHERE event_type = 'view' GROUP BY ALL), n AS (SELECT user_id, max(ts) AS now FROM events WHERE event_type = 'view' GROUP BY ALL),
c AS (SELECT user_id, item_id, required, greatest(0, required - (epoch(date_trunc('second', now)) - epoch(date_trunc('second', started))))::BIGINT AS remaining FROM v JOIN d USING (item_id) JOIN n USING (user_id))
SELECT user_id, count(*)::BIGINT AS items, sum(required)::BIGINT AS required, sum(remaining)::BIGINT AS remaining, count(*) FILTER (remaining = 0)::BIGINT AS unlocked FROM c GROUP BY user_id""")
def pacing_plan(spark, sf):
    """What each reader's opened items cost at their pace and what is still owed at their last view."""
    v = attempts(spark, sf).filter("event_type = 'view'").select("user_id", F.col("mcq").alias("item_id"), "ts")
    words = articles(spark, sf).select(F.col("doc_id").alias("item_id"), n_words(F.col("text")).alias("words"))
    c = V.clock(v, words, v.groupBy("user_id").agg(F.max("ts").alias("now")))
    return c.groupBy("user_id").agg(F.count("*").alias("items"), F.sum("required").alias("required"), F.sum("remaining").alias("remaining"), F.count_if("unlocked").alias("unlocked"))


@query("vocabulary_dump", """
SELECT 'unit' AS kind, row_number() OVER (ORDER BY p_brand, p_partkey)::INT AS ord, p_partkey::VARCHAR AS key, p_name AS label FROM part
UNION ALL SELECT 'topic', row_number() OVER (ORDER BY n_name)::INT, n_nationkey::VARCHAR, n_name FROM nation UNION ALL SELECT 'area', row_number() OVER (ORDER BY r_name)::INT, r_regionkey::VARCHAR, r_name FROM region""")
def vocabulary_dump(spark, sf):
    """The reference vocabularies, each in its own order."""
    lists = (("unit", table(spark, sf, "part"), ["p_brand", "p_partkey"], "p_partkey", "p_name"), ("topic", table(spark, sf, "nation"), ["n_name"], "n_nationkey", "n_name"), ("area", table(spark, sf, "region"), ["r_name"], "r_regionkey", "r_name"))
    out = None
    for kind, df, order, key, label in lists:
        one = K.positions(df, order).select(F.lit(kind).alias("kind"), F.col("ord").cast("int").alias("ord"), F.col(key).cast("string").alias("key"), F.col(label).alias("label"))
        out = one if out is None else out.union(one)
    return out


@query("topic_dossier", """
WITH {items}, {units}, {days}, l AS (SELECT l_orderkey AS item_id, l_partkey AS unit, s_nationkey AS topic, l_quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
i AS (SELECT topic, count(DISTINCT item_id) AS items FROM l JOIN items USING (item_id) WHERE status = 'published' GROUP BY ALL),
w AS (SELECT topic, unit, sum(l_quantity)::BIGINT AS weight FROM l GROUP BY ALL), p AS (SELECT topic, string_agg(DISTINCT paper, ',' ORDER BY paper) AS papers FROM w JOIN units USING (unit) GROUP BY topic),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, unit) AS place FROM w), u AS (SELECT topic, string_agg(unit || ':' || weight, ',' ORDER BY place) AS units FROM k WHERE place <= 10 GROUP BY topic),
e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), r AS (SELECT a AS topic, b AS other FROM e UNION SELECT b, a FROM e), o AS (SELECT topic, string_agg(n_name, ',' ORDER BY n_name) AS related FROM r JOIN nation ON n_nationkey = other GROUP BY topic),
f AS (SELECT p_partkey % 25 AS topic, p_size % 5 AS format, count(*) AS n FROM part WHERE p_size % 5 NOT IN (3, 4) GROUP BY ALL), g AS (SELECT topic, string_agg(format || ':' || n, ',' ORDER BY n DESC, format) AS formats FROM f GROUP BY topic)
SELECT n_nationkey AS topic, n_name AS name, coalesce(items, 0)::BIGINT AS items, coalesce(units, '') AS units, coalesce(papers, '') AS papers, coalesce(related, '') AS related, coalesce(formats, '') AS formats
FROM nation t LEFT JOIN i ON i.topic = n_nationkey LEFT JOIN u ON u.topic = n_nationkey LEFT JOIN p ON p.topic = n_nationkey LEFT JOIN o ON o.topic = n_nationkey LEFT JOIN g ON g.topic = n_nationkey""")
def topic_dossier(spark, sf):
    """All about a topic: published items, its ten heaviest units, the papers it reaches (drafts count), related topics, and the formats asked."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("topic"))
    l = table(spark, sf, "lineitem").join(s, "l_suppkey").select("topic", F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"), "l_quantity")
    i = l.select("topic", "item_id").distinct().join(R.visible(items(spark, sf)).select("item_id"), "item_id", "left_semi").groupBy("topic").agg(F.count("*").alias("items"))
    w = l.groupBy("topic", "unit").agg(F.sum("l_quantity").cast("long").alias("weight"))
    top = R.first_k(w, ["topic"], [F.col("weight").desc(), F.col("unit")], 10)
    u = R.listed(top, ["topic"], ["place"], F.concat(F.col("unit").cast("string"), F.lit(":"), F.col("weight").cast("string")), "units")
    p = R.listed(w.join(units(spark, sf).select("unit", "paper"), "unit"), ["topic"], ["paper"], F.col("paper"), "papers", distinct=True)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_name").alias("name"))
    other = ((F.col("topic") * 7 + 3) % 25).cast("int")
    edges = n.select("topic", other.alias("other")).union(n.select(other, "topic")).distinct()
    o = R.listed(edges.join(n.select(F.col("topic").alias("other"), "name"), "other"), ["topic"], ["name"], F.col("name"), "related")
    asked = table(spark, sf, "part").filter("p_size % 5 not in (3, 4)").groupBy((F.col("p_partkey") % 25).alias("topic"), (F.col("p_size") % 5).alias("format")).agg(F.count("*").alias("n"))
    g = R.listed(asked.withColumn("less", -F.col("n")), ["topic"], ["less", "format"], F.concat(F.col("format").cast("string"), F.lit(":"), F.col("n").cast("string")), "formats")
    out = n.join(i, "topic", "left").join(u, "topic", "left").join(p, "topic", "left").join(o, "topic", "left").join(g, "topic", "left")
    return out.fillna(0, ["items"]).fillna("", ["units", "papers", "related", "formats"]).select("topic", "name", "items", "units", "papers", "related", "formats")


@query("lens_split", """
WITH {item_units}, {units} SELECT item_id, coalesce(string_agg(unit::VARCHAR, ',' ORDER BY unit) FILTER (exam <> 'ECONOMY'), '') AS first_lens, coalesce(string_agg(unit::VARCHAR, ',' ORDER BY unit) FILTER (exam = 'ECONOMY'), '') AS second_lens FROM item_units JOIN units USING (unit) GROUP BY item_id""")
def lens_split(spark, sf):
    """An item's units by the exam that is looked at."""
    j = item_units(spark, sf).join(units(spark, sf).select("unit", "exam"), "unit")
    all_ = j.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("unit", "exam"))).alias("u"))
    lens = lambda cond: F.array_join(F.transform(F.filter("u", cond), lambda x: x["unit"].cast("string")), ",")
    return all_.select("item_id", lens(lambda x: x["exam"] != "ECONOMY").alias("first_lens"), lens(lambda x: x["exam"] == "ECONOMY").alias("second_lens"))


@query("reach_tiers", """
WITH l AS (SELECT l_suppkey AS topic, count(DISTINCT l_orderkey) FILTER (l_quantity >= 48) AS about, count(DISTINCT l_orderkey) AS met, count(DISTINCT p_brand) AS papers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT topic, about::BIGINT AS about, (met - about)::BIGINT AS mentions, floor(100 * about::DOUBLE / met + 0.5)::BIGINT AS percent, CASE WHEN papers >= 3 THEN 'wide' WHEN papers = 2 THEN 'pair' ELSE 'single' END AS reach FROM l""")
def reach_tiers(spark, sf):
    """Topics by what is about them and what only mentions them, and by how many papers they reach."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"), "l_quantity")
    per = l.groupBy("topic", "item_id").agg((F.max("l_quantity") >= 48).alias("about")).groupBy("topic").agg(F.count_if("about").alias("about"), F.count("*").alias("met"))
    papers = l.select("topic", "unit").distinct().join(units(spark, sf).select("unit", "paper"), "unit").select("topic", "paper").distinct().groupBy("topic").agg(F.count("*").alias("papers"))
    reach = F.when(F.col("papers") >= 3, "wide").when(F.col("papers") == 2, "pair").otherwise("single")
    return per.join(papers, "topic").select("topic", "about", (F.col("met") - F.col("about")).alias("mentions"), R.share(F.col("about"), F.col("met")).alias("percent"), reach.alias("reach"))
