"""Queries over items, readers, units and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.text import js_round, like_literal, local_day
from lectern.operators import ranking as K
from lectern.operators import relational as R
from lectern.operators import schedule as S
from lectern.plans.roles import articles, attempts, day_text, item_units, items, query, table, units

#: Shares of a digest by bucket, in the order of the buckets' names.
SHARES = {"1-URGENT": 0.47, "2-HIGH": 0.33, "3-MEDIUM": 0.13, "4-NOT SPECIFIED": 0.07, "5-LOW": 0.07}
FLOORS = {"1-URGENT": 3, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 1}
#: The format mix of a quiz, over the event types that stand for formats.
MIX = {"click": 0.30, "view": 0.18, "purchase": 0.18, "error": 0.14, "login": 0.10}


def _case(column: str, values: dict, other=0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {other}::DOUBLE END"


@query("mistakes_by_angle", """
WITH {attempts}, {items},
last AS (SELECT user_id, mcq, max_by(ok, attempt_id) AS ok FROM attempts GROUP BY user_id, mcq)
SELECT l.user_id, coalesce(i.bucket, 'untagged') AS angle, count(*)::BIGINT AS wrong, string_agg(mcq::VARCHAR, ',' ORDER BY mcq) AS mcqs
FROM last l LEFT JOIN items i ON i.item_id = l.mcq AND i.status = 'published' WHERE NOT ok GROUP BY ALL""")
def mistakes_by_angle(spark, sf):
    """The latest attempt of each reader at each question, the wrong ones grouped by angle."""
    wrong = R.latest(attempts(spark, sf), ["user_id", "mcq"], "attempt_id").filter("not ok")
    angle = R.visible(items(spark, sf)).select(F.col("item_id").alias("mcq"), "bucket")
    g = wrong.join(angle, "mcq", "left").groupBy("user_id", F.coalesce("bucket", F.lit("untagged")).alias("angle"))
    return g.agg(F.count("*").alias("wrong"), F.array_join(F.transform(F.array_sort(F.collect_list("mcq")), lambda x: x.cast("string")), ",").alias("mcqs"))


@query("progress_buckets", """
WITH {attempts}, {items},
seen AS (SELECT DISTINCT user_id, mcq AS item_id FROM attempts WHERE event_type = 'view'),
n AS (SELECT bucket, count(*) AS items FROM items WHERE status = 'published' GROUP BY bucket),
r AS (SELECT user_id, bucket, count(*) AS read FROM seen JOIN items USING (item_id) WHERE status = 'published' GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM seen)
SELECT u.user_id, n.bucket, n.items::BIGINT AS items, coalesce(r.read, 0)::BIGINT AS read, floor(100 * coalesce(r.read, 0)::DOUBLE / n.items + 0.5)::BIGINT AS percent
FROM u CROSS JOIN n LEFT JOIN r ON r.user_id = u.user_id AND r.bucket = n.bucket""")
def progress_buckets(spark, sf):
    """Coverage of each bucket by each reader; buckets without a read item count too."""
    pub = R.visible(items(spark, sf))
    seen = attempts(spark, sf).filter("event_type = 'view'").select("user_id", F.col("mcq").alias("item_id")).distinct()
    n = pub.groupBy("bucket").agg(F.count("*").alias("items"))
    read = seen.join(pub.select("item_id", "bucket"), "item_id").groupBy("user_id", "bucket").agg(F.count("*").alias("read"))
    # The buckets are a fixed list: each reader gets a row for each, and those that hold nothing go.
    grid = seen.select("user_id").distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in SHARES]))).join(n, "bucket")
    out = grid.join(read, ["user_id", "bucket"], "left").withColumn("read", F.coalesce("read", F.lit(0)).cast("long"))
    return out.withColumn("percent", R.share(F.col("read"), F.col("items")))


@query("weak_angles", """
WITH {attempts}, {items},
a AS (SELECT user_id, bucket AS angle, count(*) AS n, sum(ok::INT) AS right_ FROM attempts JOIN items ON item_id = mcq GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY right_::DOUBLE / n, n DESC, angle) AS place FROM a WHERE n >= 3 AND right_ < 0.8 * n)
SELECT user_id, angle, n::BIGINT AS n, right_::BIGINT AS correct, place::INT AS place FROM w WHERE place <= 8""")
def weak_angles(spark, sf):
    """Angles with three attempts or more and under 80 % right; the worst eight of each reader."""
    a = attempts(spark, sf).join(items(spark, sf).select(F.col("item_id").alias("mcq"), F.col("bucket").alias("angle")), "mcq")
    g = R.count_by(a, ["user_id", "angle"], correct=F.col("ok")).filter("n >= 3 and correct < 0.8 * n")
    return R.first_k(g, ["user_id"], [F.col("correct") / F.col("n"), F.col("n").desc(), F.col("angle")], 8)


@query("daily_activity_local", """
WITH {attempts}, m AS (SELECT max(ts) AS now FROM attempts)
SELECT user_id, strftime((ts + INTERVAL 330 MINUTES)::DATE, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, count(*) FILTER (ok)::BIGINT AS correct
FROM attempts, m WHERE ts >= now - INTERVAL 90 DAYS GROUP BY ALL""")
def daily_activity_local(spark, sf):
    """Attempts by local day, over the 90 days before the last one."""
    a = attempts(spark, sf)
    now = a.agg(F.max("ts").alias("now"))
    recent = a.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 90 DAYS"))  # one row
    return R.count_by(recent.withColumn("day", day_text(local_day(F.col("ts")))), ["user_id", "day"], correct=F.col("ok"))


@query("user_streak", """
WITH {attempts}, d AS (SELECT DISTINCT user_id, (ts + INTERVAL 330 MINUTES)::DATE AS day FROM attempts), t AS (SELECT max(day) AS today FROM d),
g AS (SELECT user_id, day, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS run FROM d),
r AS (SELECT user_id, max(day) AS last, count(*) AS length FROM g GROUP BY user_id, run)
SELECT user_id, length::BIGINT AS length, strftime(last, '%Y-%m-%d') AS last FROM r, t WHERE last >= today - 1""")
def user_streak(spark, sf):
    """Consecutive local days that reach today (the last day of all) or yesterday."""
    d = attempts(spark, sf).select("user_id", local_day(F.col("ts")).alias("day")).distinct()
    today = d.agg(F.max("day").alias("today"))
    return R.streaks(d, "user_id").join(F.broadcast(today), F.col("last") >= F.date_sub("today", 1)).select("user_id", "length", day_text(F.col("last")).alias("last"))


_COUNTS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM"}


@query("day_list", """
WITH {items}, {attempts}, d AS (SELECT DISTINCT day FROM items),
p AS (SELECT * FROM items WHERE status = 'published'),
c AS (SELECT day, count(*) AS n, count(*) FILTER (score >= 80) AS tier1, count(*) FILTER (bucket = '1-URGENT') AS urgent, count(*) FILTER (bucket = '2-HIGH') AS high, count(*) FILTER (bucket = '3-MEDIUM') AS medium FROM p GROUP BY day),
r AS (SELECT day, count(DISTINCT item_id) AS reads FROM items JOIN attempts ON mcq = item_id AND event_type = 'view' GROUP BY day)
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n, coalesce(tier1, 0)::BIGINT AS tier1, coalesce(urgent, 0)::BIGINT AS urgent, coalesce(high, 0)::BIGINT AS high, coalesce(medium, 0)::BIGINT AS medium, coalesce(reads, 0)::BIGINT AS reads
FROM d LEFT JOIN c USING (day) LEFT JOIN r USING (day)""")
def day_list(spark, sf):
    """Days with counts of published items; days without any stay. Reads count whatever the item's status."""
    i = items(spark, sf)
    c = R.count_by(R.visible(i), ["day"], tier1=F.col("score") >= 80, **{k: F.col("bucket") == v for k, v in _COUNTS.items()})
    r = i.join(attempts(spark, sf).filter("event_type = 'view'").select(F.col("mcq").alias("item_id")).distinct(), "item_id", "left_semi").groupBy("day").agg(F.count("*").alias("reads"))
    out = i.select("day").distinct().join(c, "day", "left").join(r, "day", "left")
    return out.select(day_text(F.col("day")).alias("day"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("n", "tier1", *_COUNTS, "reads")])


@query("month_archive", """
WITH {items} SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT day)::BIGINT AS days, count(*)::BIGINT AS items FROM items WHERE status = 'published' GROUP BY ALL""")
def month_archive(spark, sf):
    """Published days and items by month."""
    return R.visible(items(spark, sf)).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.countDistinct("day").alias("days"), F.count("*").alias("items"))


@query("prev_next_day", """
WITH {items}, d AS (SELECT DISTINCT day FROM items WHERE status = 'published')
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(lag(day) OVER (ORDER BY day), '%Y-%m-%d') AS prev, strftime(lead(day) OVER (ORDER BY day), '%Y-%m-%d') AS next FROM d""")
def prev_next_day(spark, sf):
    """The published days before and after each, whatever the year."""
    d = R.neighbours(R.visible(items(spark, sf)).select("day").distinct(), "day")
    return d.select(*[day_text(F.col(c)).alias(c) for c in ("day", "prev", "next")])


@query("reading_order_position", """
WITH {items}, p AS (SELECT *, row_number() OVER w AS position, lag(item_id) OVER w AS prev, lead(item_id) OVER w AS next, count(*) OVER (PARTITION BY day) AS total FROM items WHERE status = 'published' WINDOW w AS (PARTITION BY day ORDER BY bucket, score DESC, item_id))
SELECT item_id, strftime(day, '%Y-%m-%d') AS day, position::INT AS position, prev, next, total::BIGINT AS total FROM p""")
def reading_order_position(spark, sf):
    """Place of each item in its day, with its neighbours."""
    day = W.Window.partitionBy("day")
    w = day.orderBy("bucket", F.col("score").desc(), "item_id")
    return R.visible(items(spark, sf)).select("item_id", day_text(F.col("day")).alias("day"), F.row_number().over(w).alias("position"), F.lag("item_id").over(w).alias("prev"), F.lead("item_id").over(w).alias("next"), F.count("*").over(day).alias("total"))


@query("search_escaped", """
WITH {articles} SELECT doc_id, edition, headline FROM articles WHERE text ILIKE '%a~_%' ESCAPE '~' OR edition ILIKE '%rc1%' ORDER BY doc_id DESC LIMIT 50""")
def search_escaped(spark, sf):
    """The newest 50 articles that hold a term, letter case aside and wildcards taken literally."""
    a = articles(spark, sf)
    hit = F.call_function("ilike", "text", F.lit(like_literal("a_")), F.lit("~")) | F.col("edition").ilike("%rc1%")
    return a.filter(hit).orderBy(F.col("doc_id").desc()).limit(50).select("doc_id", "edition", "headline")


@query("topic_search", """
SELECT n_nationkey AS topic, n_name AS name FROM nation WHERE n_name ILIKE '%_a%' OR EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name ILIKE '%asia%')""")
def topic_search(spark, sf):
    """Topics by name or by an alias; wildcards of the term act as such."""
    alias = table(spark, sf, "region").filter(F.col("r_name").ilike("%asia%")).select(F.col("r_regionkey").alias("n_regionkey"))
    n = table(spark, sf, "nation")
    by_alias = n.join(alias, "n_regionkey", "left_semi")
    return n.filter(F.col("n_name").ilike("%_a%")).select("n_nationkey", "n_name").union(by_alias.select("n_nationkey", "n_name")).distinct().toDF("topic", "name")


@query("topic_list_counts", """
WITH s AS (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY ALL), c AS (SELECT c_nationkey AS n, count(*) AS readers FROM customer GROUP BY ALL),
o AS (SELECT c_nationkey AS n, count(*) AS items, count(*) FILTER (o_orderstatus = 'O') AS published FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
m AS (SELECT c_nationkey AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY ALL)
SELECT n_nationkey AS topic, n_name AS name, coalesce(suppliers, 0)::BIGINT AS suppliers, coalesce(readers, 0)::BIGINT AS readers, coalesce(items, 0)::BIGINT AS items, coalesce(published, 0)::BIGINT AS published, coalesce(segments, '') AS segments
FROM nation LEFT JOIN s ON s.n = n_nationkey LEFT JOIN c ON c.n = n_nationkey LEFT JOIN o ON o.n = n_nationkey LEFT JOIN m ON m.n = n_nationkey""")
def topic_list_counts(spark, sf):
    """Topics with four counts and a distinct list, each aggregated before it is joined."""
    key = F.col("n_nationkey").alias("topic")
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("topic")).agg(F.count("*").alias("suppliers"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("author"), F.col("c_nationkey").alias("topic"), "c_mktsegment")
    c = cust.groupBy("topic").agg(F.count("*").alias("readers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))
    # Items by author first: the join then moves a row an author, not a row an item.
    o = R.count_by(items(spark, sf), ["author"], published=F.col("status") == "published").join(cust, "author").groupBy("topic").agg(F.sum("n").alias("items"), F.sum("published").alias("published"))
    out = table(spark, sf, "nation").select(key, F.col("n_name").alias("name")).join(s, "topic", "left").join(c, "topic", "left").join(o, "topic", "left")
    return out.select("topic", "name", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("suppliers", "readers", "items", "published")], F.coalesce("segments", F.lit("")).alias("segments"))


@query("reuse_map", """
WITH t AS (SELECT l_suppkey AS topic, p_brand AS paper, sum(l_quantity)::BIGINT AS weight FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 45 GROUP BY ALL)
SELECT topic, count(*)::BIGINT AS papers, string_agg(paper, ',' ORDER BY paper) AS paper_list, first(paper ORDER BY weight DESC, paper) AS study_from FROM t GROUP BY topic HAVING count(*) >= 2""")
def reuse_map(spark, sf):
    """Topics that two papers or more ask for, and the paper of most weight (ties: the smaller one). Broad units don't count."""
    u = units(spark, sf).filter("not broad").select(F.col("unit").alias("l_partkey"), "paper")
    t = table(spark, sf, "lineitem").join(u, "l_partkey").groupBy(F.col("l_suppkey").alias("topic"), "paper").agg(F.sum("l_quantity").cast("long").alias("weight"))
    return t.groupBy("topic").agg(F.count("*").alias("papers"), F.array_join(F.array_sort(F.collect_list("paper")), ",").alias("paper_list"), F.min(F.struct((-F.col("weight")).alias("w"), "paper"))["paper"].alias("study_from")).filter("papers >= 2")


@query("topic_gaps", """
WITH {units} SELECT unit, paper, label FROM units WHERE NOT broad AND NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = unit AND o_orderstatus = 'O' AND l_quantity >= 48)""")
def topic_gaps(spark, sf):
    """Units that no published item feeds with 48 hits or more."""
    fed = item_units(spark, sf).filter("hits >= 48").join(R.visible(items(spark, sf)).select("item_id"), "item_id", "left_semi").select("unit").distinct()
    return units(spark, sf).filter("not broad").join(fed, "unit", "left_anti").select("unit", "paper", "label")


@query("syllabus_coverage", """
WITH {units}, {item_units}, {items},
f AS (SELECT unit, count(*) AS fed FROM item_units JOIN items USING (item_id) WHERE status = 'published' GROUP BY unit)
SELECT exam, count(*)::BIGINT AS units, count(*) FILTER (NOT broad)::BIGINT AS feedable, count(*) FILTER (NOT broad AND fed IS NOT NULL)::BIGINT AS covered, coalesce(sum(fed) FILTER (NOT broad), 0)::BIGINT AS items,
       floor(100 * count(*) FILTER (NOT broad AND fed IS NOT NULL)::DOUBLE / nullif(count(*) FILTER (NOT broad), 0) + 0.5)::BIGINT AS percent
FROM units LEFT JOIN f USING (unit) GROUP BY exam""")
def syllabus_coverage(spark, sf):
    """Units of each exam, those that can be fed, and those that are."""
    f = item_units(spark, sf).join(R.visible(items(spark, sf)).select("item_id"), "item_id", "left_semi").groupBy("unit").agg(F.count("*").alias("fed"))
    g = units(spark, sf).join(f, "unit", "left").groupBy("exam")
    out = g.agg(F.count("*").alias("units"), F.count_if(~F.col("broad")).alias("feedable"), F.count_if(~F.col("broad") & F.col("fed").isNotNull()).alias("covered"), F.coalesce(F.sum(F.when(~F.col("broad"), F.col("fed"))), F.lit(0)).alias("items"))
    return out.withColumn("percent", R.share(F.col("covered"), F.col("feedable")))


@query("candidate_rows", """
WITH {items}, {item_units}, {units},
j AS (SELECT i.item_id, i.score, iu.unit AS tagged, u.unit, iu.hits FROM items i LEFT JOIN item_units iu USING (item_id) LEFT JOIN units u ON u.unit = iu.unit AND NOT u.broad)
SELECT item_id, any_value(score) AS score, count(DISTINCT unit)::BIGINT AS units, coalesce(max((hits >= 40)::INT), 0)::BIGINT AS strong FROM j WHERE tagged IS NULL OR unit IS NOT NULL GROUP BY item_id""")
def candidate_rows(spark, sf):
    """Items with their number of units and whether one is strong. Items whose units are all broad are left out; untagged ones stay."""
    iu = item_units(spark, sf).join(units(spark, sf).filter("not broad").select("unit", F.lit(True).alias("good")), "unit", "left")
    per = iu.groupBy("item_id").agg(F.count_if("good").alias("units"), F.max(F.when(F.col("good"), (F.col("hits") >= 40).cast("long"))).alias("strong"))
    j = items(spark, sf).select("item_id", "score").join(per, "item_id", "left").filter("units is null or units > 0")
    return j.select("item_id", "score", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("strong", F.lit(0)).alias("strong"))


_BANDED = """{items}, {item_units},
c AS (SELECT i.item_id, strftime(i.day, '%Y-%m') AS edition, i.bucket, i.score, count(iu.unit) AS n, coalesce(max(iu.hits), 0) >= 48 AS head FROM items i LEFT JOIN item_units iu USING (item_id) WHERE status <> 'discarded' GROUP BY ALL),
l AS (SELECT *, least(100, CASE WHEN n = 0 THEN 0 WHEN n = 1 THEN 40 WHEN n = 2 THEN 62 WHEN n = 3 THEN 76 ELSE 85 END + CASE WHEN head THEN 15 ELSE 0 END) AS leverage FROM c)"""


def _banded(spark, sf, *more):
    per = item_units(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"), F.max("hits").alias("most"))
    c = items(spark, sf).filter("status <> 'discarded'").join(per, "item_id", "left")
    return c.select("item_id", F.date_format("day", "yyyy-MM").alias("edition"), "bucket", "score", K.leverage(F.coalesce("n", F.lit(0)), F.coalesce(F.col("most") >= 48, F.lit(False))).cast("long").alias("leverage"), *more)


@query("selection_band", f"""
WITH {_BANDED},
r AS (SELECT *, floor(0.55::DOUBLE * leverage + 0.45::DOUBLE * score + 0.5)::BIGINT AS rank FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY rank DESC, score DESC, item_id) AS place, row_number() OVER (PARTITION BY edition, bucket ORDER BY rank DESC, score DESC, item_id) AS inside FROM r),
w AS (SELECT *, CASE WHEN score >= 32 AND rank >= 45 AND place <= 35 THEN 'band' WHEN place <= 12 THEN 'floor' WHEN inside <= {_case("bucket", FLOORS)} THEN 'bucket' END AS why FROM p)
SELECT item_id, edition, bucket, score, leverage::BIGINT AS leverage, rank, place::INT AS place, why FROM w WHERE why IS NOT NULL""")
def selection_band(spark, sf):
    """What is drafted of each month: rank by leverage and score, with floors by bucket."""
    return K.selection_band(_banded(spark, sf), "edition", "bucket", "score", "leverage", "item_id", FLOORS)


#: The digest of a month: tiers of its items, and their places in the order in which they are taken.
DIGEST = f"""b AS (SELECT *, strftime(day, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(day, '%Y-%m'), bucket ORDER BY score DESC, item_id) AS inside, greatest(1, floor(15 * {_case("bucket", SHARES)} + 0.5)) AS quota FROM items WHERE status = 'published'),
t AS (SELECT *, CASE WHEN inside = 1 THEN 0 WHEN inside <= quota THEN 1 ELSE 2 END AS tier FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY tier, CASE WHEN tier = 1 THEN inside - quota ELSE 0 END, score DESC, item_id) AS position FROM t)"""


def month_digest(spark, sf):
    i = R.visible(items(spark, sf)).select(F.date_format("day", "yyyy-MM").alias("month"), "bucket", "item_id", "score")
    return K.quota_top_k(i, "month", "bucket", [F.col("score").desc(), F.col("item_id")], 15, SHARES)


@query("quota_topk_per_bucket", f"""
WITH {{items}}, {DIGEST}
SELECT month, bucket, item_id, score, position::INT AS position, ['best', 'quota', 'backfill'][tier + 1] AS picked FROM p WHERE position <= 15 OR tier = 0""")
def quota_topk_per_bucket(spark, sf):
    """Fifteen items a month: the best of each bucket, quotas, then the best of the rest; beyond fifteen, the weakest of the buckets that most exceed their quotas go."""
    return month_digest(spark, sf)


@query("format_mix_sample", f"""
WITH {{attempts}}, q AS (SELECT user_id, attempt_id, event_type AS format, sha256('quiz:' || attempt_id) AS h FROM attempts),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, format ORDER BY h) > floor(10 * {_case("format", MIX)} + 0.5) AS over FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY over, h) AS position FROM p)
SELECT user_id, format, attempt_id, position::INT AS position FROM o WHERE position <= 10""")
def format_mix_sample(spark, sf):
    """Ten questions for each reader, in the mix of formats, in a reproducible shuffle."""
    q = attempts(spark, sf).select("user_id", F.col("event_type").alias("format"), "attempt_id")
    return K.format_mix(q, ["user_id"], "format", "attempt_id", 10, MIX)


@query("largest_remainder", """
WITH {attempts}, c AS (SELECT user_id, event_type AS format, count(*) AS n FROM attempts GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c),
f AS (SELECT *, (n * 12) // total AS base, (n * 12) % total AS rest FROM t WHERE total >= 4),
p AS (SELECT *, 12 - sum(base) OVER (PARTITION BY user_id) AS left_, row_number() OVER (PARTITION BY user_id ORDER BY rest DESC, n DESC, format) AS k FROM f)
SELECT user_id, format, n::BIGINT AS n, (base + (k <= left_)::INT)::BIGINT AS seats FROM p""")
def largest_remainder(spark, sf):
    """Twelve questions shared over the formats that each reader has met."""
    return K.largest_remainder(attempts(spark, sf).groupBy("user_id", F.col("event_type").alias("format")).agg(F.count("*").alias("n")), "user_id", "format", "n", 12)


@query("latest_version_upsert", """
WITH o AS (SELECT p_partkey AS unit, p_brand AS paper, 'seed' AS origin FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS unit, p_type AS paper, 'new' AS origin FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.unit, o.unit) AS unit, coalesce(n.paper, o.paper) AS paper, coalesce(n.origin, o.origin) AS origin FROM o FULL JOIN n ON n.unit = o.unit""")
def latest_version_upsert(spark, sf):
    """New rows over old ones by key."""
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("paper"), F.lit("seed").alias("origin"))
    return R.upsert(old, p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("paper"), F.lit("new").alias("origin")), ["unit"])


@query("upsert_ignore", """
WITH o AS (SELECT p_partkey AS unit, p_brand AS paper FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS unit, p_type AS paper FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(o.unit, n.unit) AS unit, coalesce(o.paper, n.paper) AS paper FROM o FULL JOIN n ON n.unit = o.unit""")
def upsert_ignore(spark, sf):
    """Old rows over new ones by key."""
    p = table(spark, sf, "part")
    return R.upsert(p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("paper")), p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("paper")), ["unit"], "ignore")


@query("coverage_audit_median", """
WITH {units}, {item_units}, f AS (SELECT paper, u.unit, count(item_id) AS fed FROM units u LEFT JOIN item_units USING (unit) WHERE NOT broad GROUP BY ALL),
m AS (SELECT paper, list_sort(list(fed) FILTER (fed > 0)) AS s FROM f GROUP BY paper), k AS (SELECT paper, s[len(s) // 2 + 1] AS median FROM m)
SELECT paper, median::BIGINT AS median, count(*)::BIGINT AS units, count(*) FILTER (fed = 0)::BIGINT AS cold, count(*) FILTER (fed >= 3 * median)::BIGINT AS crowded FROM f JOIN k USING (paper) GROUP BY ALL""")
def coverage_audit_median(spark, sf):
    """Per paper: the median feed of its fed units, those without any, and those with three times the median."""
    per = item_units(spark, sf).groupBy("unit").agg(F.count("*").alias("fed"))
    f = units(spark, sf).filter("not broad").join(per, "unit", "left").select("paper", "unit", F.coalesce("fed", F.lit(0)).alias("fed"))
    m = f.filter("fed > 0").groupBy("paper").agg(R.upper_median("fed").alias("median"))
    j = f.join(m, "paper").groupBy("paper", "median")
    return j.agg(F.count("*").alias("units"), F.count_if(F.col("fed") == 0).alias("cold"), F.count_if(F.col("fed") >= 3 * F.col("median")).alias("crowded"))


@query("leitner_replay", """
WITH {attempts}, a AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, mcq ORDER BY ts, attempt_id) AS misses FROM attempts),
c AS (SELECT user_id, mcq, max(misses) AS last_miss, count(*) AS reviews, max(ts) AS last FROM a GROUP BY ALL),
s AS (SELECT c.*, (SELECT count(*) FROM a WHERE a.user_id = c.user_id AND a.mcq = c.mcq AND a.misses = c.last_miss AND a.ok) AS wins FROM c),
b AS (SELECT *, CASE WHEN last_miss = 0 THEN least(wins, 5) ELSE least(1 + wins, 5) END AS box FROM s)
SELECT user_id, mcq, reviews::BIGINT AS reviews, box::BIGINT AS box, strftime(((last + INTERVAL 330 MINUTES)::DATE + [1, 3, 7, 14, 30][box]), '%Y-%m-%d') AS due FROM b""")
def leitner_replay(spark, sf):
    """Box and due day of each card after all its outcomes."""
    return S.replayed(attempts(spark, sf)).withColumn("due", day_text(F.col("due")))


@query("due_forecast", """
WITH {attempts}, a AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, mcq ORDER BY ts, attempt_id) AS misses FROM attempts),
c AS (SELECT user_id, mcq, max(misses) AS last_miss, max(ts) AS last FROM a GROUP BY ALL),
w AS (SELECT a.user_id, a.mcq, c.last_miss, c.last, count(*) FILTER (a.ok) AS wins FROM a JOIN c ON a.user_id = c.user_id AND a.mcq = c.mcq AND a.misses = c.last_miss GROUP BY ALL),
d AS (SELECT (last + INTERVAL 330 MINUTES)::DATE + [1, 3, 7, 14, 30][CASE WHEN last_miss = 0 THEN least(wins, 5) ELSE least(1 + wins, 5) END] AS due FROM w)
SELECT strftime(due, '%Y-%m-%d') AS due, count(*)::BIGINT AS cards FROM d WHERE due >= DATE '2024-01-28' AND due < DATE '2024-02-11' GROUP BY ALL""")
def due_forecast(spark, sf):
    """Cards that fall due in a fortnight."""
    return S.due_forecast(S.replayed(attempts(spark, sf)), F.lit("2024-01-28").cast("date")).withColumn("due", day_text(F.col("due")))


@query("rate_windows", """
WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t FROM events), w(user_id, start) AS (SELECT user_id, min(t) FROM e GROUP BY user_id UNION ALL SELECT user_id, next FROM (SELECT w.user_id, min(e.t) AS next FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.start + 3600 GROUP BY w.user_id, w.start)),
n AS (SELECT w.user_id, w.start, count(*) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.start AND e.t < w.start + 3600 GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS windows, sum(greatest(n - 2, 0))::BIGINT AS refused FROM n GROUP BY user_id""")
def rate_windows(spark, sf):
    """Windows of an hour that start at a reader's first event, with refusals beyond two events."""
    return S.fixed_windows(attempts(spark, sf), "user_id", "ts", 3600, 2)


@query("session_validation", """
SELECT event_id, event_type, CASE WHEN NOT (value > 0 AND value <= 500) THEN 'total' WHEN regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT > value THEN 'answered' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'scope' ELSE 'valid' END AS verdict FROM events""")
def session_validation(spark, sf):
    """The first rule that a session breaks: its total, its answers, its scope."""
    e = table(spark, sf, "events")
    verdict = F.when(~((F.col("value") > 0) & (F.col("value") <= 500)), "total").when(F.get_json_object("props", "$.k").cast("long") > F.col("value"), "answered").when(~F.col("event_type").isin("view", "click", "purchase"), "scope").otherwise("valid")
    return e.select("event_id", "event_type", verdict.alias("verdict"))


@query("edition_counts", """
WITH {items} SELECT strftime(day, '%Y-%m') AS edition, count(*)::BIGINT AS n, count(*) FILTER (status = 'published')::BIGINT AS published, count(*) FILTER (status = 'draft')::BIGINT AS draft, count(*) FILTER (status = 'discarded')::BIGINT AS discarded, count(*) FILTER (score >= 80)::BIGINT AS critical, count(*) FILTER (score >= 40 AND score < 80)::BIGINT AS middling FROM items GROUP BY ALL""")
def edition_counts(spark, sf):
    """Six counts an edition in one pass."""
    i = items(spark, sf).withColumn("edition", F.date_format("day", "yyyy-MM"))
    return R.count_by(i, ["edition"], **{s: F.col("status") == s for s in ("published", "draft", "discarded")}, critical=F.col("score") >= 80, middling=(F.col("score") >= 40) & (F.col("score") < 80))


@query("format_mix_share", """
WITH {attempts}, c AS (SELECT mcq, event_type AS format, count(*) AS n FROM attempts WHERE event_type NOT IN ('error') GROUP BY ALL)
SELECT mcq, format, n::BIGINT AS n, floor(100 * n::DOUBLE / sum(n) OVER (PARTITION BY mcq) + 0.5)::BIGINT AS percent FROM c""")
def format_mix_share(spark, sf):
    """Observed formats of each question's topic, with their shares."""
    c = attempts(spark, sf).filter("event_type <> 'error'").groupBy("mcq", F.col("event_type").alias("format")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", R.share(F.col("n"), F.sum("n").over(W.Window.partitionBy("mcq"))))


@query("keyword_frequency", """
SELECT p_type AS keyword, count(*)::BIGINT AS asked, count(DISTINCT p_brand)::BIGINT AS papers, string_agg(DISTINCT (p_size % 5)::VARCHAR, ',' ORDER BY (p_size % 5)::VARCHAR) AS formats FROM part GROUP BY p_type ORDER BY asked DESC, keyword LIMIT 40""")
def keyword_frequency(spark, sf):
    """The 40 keywords asked most, with papers and formats."""
    g = table(spark, sf, "part").groupBy(F.col("p_type").alias("keyword")).agg(F.count("*").alias("asked"), F.countDistinct("p_brand").alias("papers"), F.array_join(F.array_sort(F.collect_set((F.col("p_size") % 5).cast("string"))), ",").alias("formats"))
    return g.orderBy(F.col("asked").desc(), "keyword").limit(40)


@query("topic_recurrence", """
WITH r AS (SELECT l_suppkey AS topic, count(DISTINCT l_partkey) AS questions, count(DISTINCT p_brand) AS papers FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
t AS (SELECT *, CASE WHEN papers >= 24 OR questions >= 60 THEN 1 WHEN questions >= 40 THEN 2 ELSE 3 END AS tier FROM r)
SELECT topic, questions::BIGINT AS questions, papers::BIGINT AS papers, tier::INT AS tier FROM t WHERE tier <> 2""")
def topic_recurrence(spark, sf):
    """Topics whose suggested tier, by distinct questions and papers, is not the present one (2)."""
    pairs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_partkey").alias("unit")).distinct()
    r = pairs.join(units(spark, sf).select("unit", "paper"), "unit").groupBy("topic").agg(F.count("*").alias("questions"), F.countDistinct("paper").alias("papers"))
    return r.withColumn("tier", F.when((F.col("papers") >= 24) | (F.col("questions") >= 60), 1).when(F.col("questions") >= 40, 2).otherwise(3)).filter("tier <> 2")


@query("blueprint_pressure", """
WITH {item_units}, n AS (SELECT unit, count(*) AS asked FROM item_units GROUP BY unit), p AS (SELECT item_id, max(asked) AS pressure FROM item_units JOIN n USING (unit) GROUP BY item_id)
SELECT item_id, pressure::BIGINT AS pressure, CASE WHEN pressure >= 40 THEN 'CORE' WHEN pressure >= 33 THEN 'HIGH' WHEN pressure >= 1 THEN 'MED' ELSE '' END AS tier FROM p""")
def blueprint_pressure(spark, sf):
    """The greatest count, not the sum, over an item's keywords."""
    iu = item_units(spark, sf)
    p = iu.join(iu.groupBy("unit").agg(F.count("*").alias("asked")), "unit").groupBy("item_id").agg(F.max("asked").alias("pressure"))
    return p.withColumn("tier", F.when(F.col("pressure") >= 40, "CORE").when(F.col("pressure") >= 33, "HIGH").when(F.col("pressure") >= 1, "MED").otherwise(""))


@query("question_cap", """
WITH l AS (SELECT l_orderkey AS item_id, l_partkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
SELECT item_id, count(*) FILTER (k <= 3)::BIGINT AS kept, count(*) FILTER (k > 3)::BIGINT AS dropped, sum(q) FILTER (k <= 3)::BIGINT AS checksum FROM l GROUP BY ALL""")
def question_cap(spark, sf):
    """The first three questions of each item, and how many go."""
    w = W.Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    l = table(spark, sf, "lineitem").withColumn("k", F.row_number().over(w))
    return l.groupBy(F.col("l_orderkey").alias("item_id")).agg(F.count_if(F.col("k") <= 3).alias("kept"), F.count_if(F.col("k") > 3).alias("dropped"), F.sum(F.when(F.col("k") <= 3, F.col("l_partkey"))).alias("checksum"))


@query("triage_counts", """
WITH j AS (SELECT d.source, CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'high' WHEN l.doc_id IS NOT NULL THEN 'partial' ELSE 'unread' END AS class FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*)::BIGINT AS n, count(*) FILTER (class = 'high')::BIGINT AS high, count(*) FILTER (class = 'partial')::BIGINT AS partial, count(*) FILTER (class = 'drop')::BIGINT AS "drop", count(*) FILTER (class = 'unread')::BIGINT AS unread FROM j GROUP BY source""")
def triage_counts(spark, sf):
    """Classes of verdicts by source; unread articles count."""
    j = _classed(spark, sf)
    return R.count_by(j, ["source"], **{c: F.col("class") == c for c in ("high", "partial", "drop", "unread")})


def _classed(spark, sf):
    l = table(spark, sf, "labels").withColumn("seen", F.lit(True))
    kind = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "high").when(F.col("seen"), "partial").otherwise("unread")
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(l, "doc_id", "left").select("doc_id", "source", "n_chars", kind.alias("class"))


@query("band_redraw", """
WITH j AS (SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic <> 1), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM j)
SELECT doc_id, source, k::INT AS place, CASE WHEN k <= 12 THEN 'high' ELSE 'partial' END AS band FROM p""")
def band_redraw(spark, sf):
    """The best twelve of each source become high, the rest partial."""
    j = _classed(spark, sf).filter("class in ('high', 'partial')")
    place = F.row_number().over(W.Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    return j.select("doc_id", "source", place.alias("place")).withColumn("band", F.when(F.col("place") <= 12, "high").otherwise("partial"))


@query("triaged_selection", """
WITH j AS (SELECT d.doc_id, d.source, d.n_chars, (l.quality = 1 AND l.toxic <> 1)::INT AS high FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic <> 1),
t AS (SELECT source, greatest(12, least(35, sum(high))) AS target FROM j GROUP BY source), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM j)
SELECT doc_id, p.source, k::INT AS place, target::BIGINT AS target FROM p JOIN t USING (source) WHERE k <= target""")
def triaged_selection(spark, sf):
    """As many articles a source as were read as high, between 12 and 35."""
    j = _classed(spark, sf).filter("class in ('high', 'partial')")
    t = j.groupBy("source").agg(F.greatest(F.lit(12), F.least(F.lit(35), F.count_if(F.col("class") == "high"))).alias("target"))
    place = F.row_number().over(W.Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    return j.withColumn("place", place).join(t, "source").filter("place <= target").select("doc_id", "source", "place", "target")


@query("salvage_leftovers", """
WITH j AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS k FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic <> 1) SELECT doc_id, source FROM j WHERE k > 12""")
def salvage_leftovers(spark, sf):
    """Read and not dropped, but not picked."""
    j = _classed(spark, sf).filter("class in ('high', 'partial')")
    picked = R.first_k(j, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 12).select("doc_id")
    return j.join(picked, "doc_id", "left_anti").select("doc_id", "source")


@query("alias_provenance", """
WITH f AS (SELECT l_partkey AS unit, min(l_shipdate) AS first_hit FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT p_brand AS provenance, count(*)::BIGINT AS aliases, count(first_hit)::BIGINT AS fired, floor(100 * count(first_hit)::DOUBLE / count(*) + 0.5)::BIGINT AS percent FROM part LEFT JOIN f ON unit = p_partkey GROUP BY ALL""")
def alias_provenance(spark, sf):
    """How many aliases of each provenance ever fired."""
    f = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("first_hit"))
    out = table(spark, sf, "part").join(f, "p_partkey", "left").groupBy(F.col("p_brand").alias("provenance")).agg(F.count("*").alias("aliases"), F.count("first_hit").alias("fired"))
    return out.withColumn("percent", R.share(F.col("fired"), F.col("aliases")))


@query("rescore_diff", """
WITH o AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS unit FROM lineitem WHERE l_quantity >= 10), n AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS unit FROM lineitem WHERE l_quantity <= 45)
SELECT item_id, unit, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT item_id, unit, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def rescore_diff(spark, sf):
    """Tags that a new scoring takes away or adds."""
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit"), "l_quantity")
    return R.difference(l, ["item_id", "unit"], F.col("l_quantity") >= 10, F.col("l_quantity") <= 45)


@query("section_vote", """
WITH {item_units}, {units}, v AS (SELECT item_id, CASE WHEN broad THEN NULL ELSE paper END AS section, CASE WHEN unit % 7 = 0 THEN 1 ELSE 2 END AS w FROM item_units JOIN units USING (unit)),
s AS (SELECT item_id, section, sum(w) AS w FROM v WHERE section IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, regexp_extract(section, '([0-9]+)$', 1)::INT) AS k FROM s)
SELECT i.item_id, coalesce(section, 'general') AS section, coalesce(w, 0)::BIGINT AS weight FROM (SELECT DISTINCT item_id FROM v) i LEFT JOIN b ON b.item_id = i.item_id AND k = 1""")
def section_vote(spark, sf):
    """The section that most of an item's units vote for; weak units have half a vote, broad ones none."""
    v = item_units(spark, sf).join(units(spark, sf), "unit").select("item_id", F.when(~F.col("broad"), F.col("paper")).alias("section"), F.when(F.col("unit") % 7 == 0, 1).otherwise(2).alias("w"))
    return K.vote(v.withColumn("ord", F.regexp_extract("section", "([0-9]+)$", 1).try_cast("int")), "item_id", "section", "w", "ord", "general")


@query("run_lock", """
WITH {attempts}, r AS (SELECT event_type AS mode, max(attempt_id) AS run FROM attempts GROUP BY ALL), n AS (SELECT max(ts) AS now FROM attempts)
SELECT mode, run, CASE WHEN now - ts > INTERVAL 2 HOURS THEN 'stale' ELSE 'running' END AS state FROM r JOIN attempts ON attempt_id = run, n""")
def run_lock(spark, sf):
    """The latest run of each mode, stale after two hours."""
    a = attempts(spark, sf)
    last = R.latest(a.select(F.col("event_type").alias("mode"), F.col("attempt_id").alias("run"), "ts"), ["mode"], "run")
    return last.join(F.broadcast(a.agg(F.max("ts").alias("now"))), F.lit(True)).select("mode", "run", F.when(F.col("now") - F.col("ts") > F.expr("INTERVAL 2 HOURS"), "stale").otherwise("running").alias("state"))


@query("reading_clock", """
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS words FROM documents)
SELECT doc_id, words, greatest(45, least(480, floor(words * 60::DOUBLE / 200 + 0.5)))::BIGINT AS required, CASE WHEN words > 0 THEN greatest(1, floor(words::DOUBLE / 220 + 0.5)) ELSE 0 END::BIGINT AS minutes FROM d""")
def reading_clock(spark, sf):
    """Words of each article, the seconds that open its questions, and its reading minutes."""
    from lectern.functions.text import n_words

    d = table(spark, sf, "documents").select("doc_id", n_words(F.col("text")).alias("words"))
    return d.select("doc_id", "words", S.required_seconds(F.col("words")).alias("required"), S.minutes(F.col("words"), 220).alias("minutes"))


@query("month_compendium", """
WITH {items}, p AS (SELECT strftime(day, '%Y-%m') AS month, item_id, score, row_number() OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY score DESC, item_id) AS k, count(*) OVER (PARTITION BY strftime(day, '%Y-%m')) AS total FROM items WHERE status = 'published')
SELECT month, item_id, score, k::INT AS place, total::BIGINT AS total FROM p WHERE k <= 150""")
def month_compendium(spark, sf):
    """The 150 most important items of each month, with the month's total."""
    i = R.visible(items(spark, sf)).select(F.date_format("day", "yyyy-MM").alias("month"), "item_id", "score").withColumn("total", F.count("*").over(W.Window.partitionBy("month")))
    return R.first_k(i, ["month"], [F.col("score").desc(), F.col("item_id")], 150)


@query("undirected_neighbours", """
WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 49), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a AS topic, count(*)::BIGINT AS neighbours, string_agg(n_name, ',' ORDER BY n_name) AS names FROM u JOIN nation ON n_nationkey = b WHERE a <> b GROUP BY a""")
def undirected_neighbours(spark, sf):
    """Topics linked in either direction."""
    l = table(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("b"))
    e = l.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").select("a", "b").distinct()
    u = e.union(e.select("b", "a")).distinct().filter("a <> b")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), "n_name")
    return u.join(n, "b").groupBy(F.col("a").alias("topic")).agg(F.count("*").alias("neighbours"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("clamped_scores", """
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR value <= 0 THEN 50 ELSE least(greatest(value, 10), 90) END AS score FROM events""")
def clamped_scores(spark, sf):
    from lectern.functions.text import clamp

    return table(spark, sf, "events").select("event_id", clamp(F.col("value"), 10.0, 90.0, 50.0).alias("score"))


@query("merit_default", """
WITH {items}, {item_units}, s AS (SELECT item_id, sum(hits) AS hits FROM item_units GROUP BY ALL) SELECT i.item_id, coalesce(hits, 50)::BIGINT AS merit, floor(coalesce(hits, 50)::DOUBLE / 3 + 0.5)::BIGINT AS rounded FROM items i LEFT JOIN s USING (item_id)""")
def merit_default(spark, sf):
    """Merit of each item; 50 where no article stands behind it."""
    s = item_units(spark, sf).groupBy("item_id").agg(F.sum("hits").alias("hits"))
    return items(spark, sf).select("item_id").join(s, "item_id", "left").select("item_id", F.coalesce("hits", F.lit(50)).alias("merit")).withColumn("rounded", js_round(F.col("merit") / 3).cast("long"))
