"""The roles that the star-schema tables play, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import headline
from lectern.operators.relational import visible

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with the SQL for its rows; {role} in the SQL's WITH list stands for that role's CTE."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_roles(sql)
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Published, draft and discarded items with a day, a bucket and a score of 0 to 100."""
    status = F.when(F.col("o_orderstatus") == "O", "published").when(F.col("o_orderstatus") == "F", "draft").otherwise("discarded")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("bucket"), status.alias("status"), F.floor(F.col("o_totalprice") % 101).alias("score"))


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("mcq"), (F.col("event_type") != "error").alias("ok"), "event_type", "ts")


def units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("paper"), F.col("p_type").alias("exam"), (F.col("p_size") > 45).alias("broad"), F.col("p_name").alias("label"))


def item_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit")).agg(F.max("l_quantity").cast("long").alias("hits"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("edition"), headline(F.col("text")).alias("headline"))


def days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with items; some are not published yet."""
    return items(spark, sf).select("day").distinct().withColumn("status", F.when(F.pmod(F.unix_date("day"), F.lit(11)) == 0, "draft").otherwise("published"))


def shown(spark: SparkSession, sf: str) -> DataFrame:
    """Published items of published days."""
    return visible(items(spark, sf), days(spark, sf))


def mcqs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of items: their unit, their right option, their format, and whether they were reviewed."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("unit"), F.max("l_returnflag").alias("flag"))
    formats = F.array(*[F.lit(x) for x in FORMATS])
    return q.select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mcq"), "unit", F.when(F.col("flag") == "A", "draft").otherwise("published").alias("status"),
        F.substring(F.lit("abcd"), (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(4)) + 1).cast("int"), F.lit(1)).alias("correct"), F.get(formats, F.pmod("unit", F.lit(5)).cast("int")).alias("format"),
    )


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """Published questions of shown items."""
    return mcqs(spark, sf).filter("status = 'published'").join(shown(spark, sf).select("item_id", "day"), "item_id").drop("status")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Options picked by readers; some are none of the four, some belong to no question."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(F.col("event_id").alias("attempt_id"), "user_id", (F.col("k") * 10 + 1 + F.col("event_id") % 7).alias("mcq"), F.substring(F.lit("abcde"), (F.col("event_id") % 5 + 1).cast("int"), F.lit(1)).alias("selected"), "ts")


def opened(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """user_id, item_id, at: the last time each reader did something of ``kind`` with an item."""
    return attempts(spark, sf).filter(F.col("event_type") == kind).groupBy("user_id", F.col("mcq").alias("item_id")).agg(F.max("ts").alias("at"))


FORMATS = ("direct_recall", "statement_based", "multi_statement", "list_matching", "chronological")

ROLES = {
    "days": "days AS (SELECT DISTINCT o_orderdate::DATE AS day, CASE WHEN (o_orderdate::DATE - DATE '1970-01-01') % 11 = 0 THEN 'draft' ELSE 'published' END AS status FROM orders)",
    "shown": "shown AS (SELECT * FROM items WHERE status = 'published' AND (day - DATE '1970-01-01') % 11 <> 0)",
    "mcqs": "mcqs AS (SELECT l_orderkey AS item_id, l_orderkey * 10 + l_linenumber AS mcq, min(l_partkey) AS unit, CASE max(l_returnflag) WHEN 'A' THEN 'draft' ELSE 'published' END AS status, substr('abcd', ((l_orderkey + l_linenumber) % 4 + 1)::INT, 1) AS correct, ["
    + ", ".join(f"'{x}'" for x in FORMATS)
    + "][(min(l_partkey) % 5 + 1)::INT] AS format FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "reviewed": "reviewed AS (SELECT m.*, s.day FROM mcqs m JOIN shown s USING (item_id) WHERE m.status = 'published')",
    "answers": "answers AS (SELECT event_id AS attempt_id, user_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT * 10 + 1 + event_id % 7 AS mcq, substr('abcde', (event_id % 5 + 1)::INT, 1) AS selected, ts FROM events)",
    "views": "views AS (SELECT user_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS item_id, max(ts) AS seen_at FROM events WHERE event_type = 'view' GROUP BY ALL)",
    "bookmarks": "bookmarks AS (SELECT user_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS item_id, max(ts) AS seen_at FROM events WHERE event_type = 'purchase' GROUP BY ALL)",
    "items": "items AS (SELECT o_orderkey AS item_id, o_custkey AS author, o_orderdate::DATE AS day, o_orderpriority AS bucket, CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'F' THEN 'draft' ELSE 'discarded' END AS status, floor(o_totalprice % 101)::BIGINT AS score FROM orders)",
    "attempts": "attempts AS (SELECT event_id AS attempt_id, user_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT AS mcq, event_type <> 'error' AS ok, event_type, ts FROM events)",
    "units": "units AS (SELECT p_partkey AS unit, p_brand AS paper, p_type AS exam, p_size > 45 AS broad, p_name AS label FROM part)",
    "item_units": "item_units AS (SELECT l_orderkey AS item_id, l_partkey AS unit, max(l_quantity)::BIGINT AS hits FROM lineitem GROUP BY ALL)",
    "articles": "articles AS (SELECT doc_id, text, lang, source AS edition, split_part(coalesce(text, ''), chr(10), 1) AS headline FROM documents)",
}


def with_roles(sql: str) -> str:
    for name, cte in ROLES.items():
        sql = sql.replace("{" + name + "}", cte)
    return sql
