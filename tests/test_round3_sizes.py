"""Findings of round 3 on size: each test fails on the code before it."""

from __future__ import annotations

import random

from helpers import joined
from pyspark.sql import functions as F

from lectern.operators import dedup, desk, reads, relational, segmentation
from lectern.plans import catalogue


def test_pairs_across_languages_are_counted_where_blocks_meet(spark, monkeypatch):
    docs = lambda rows: spark.createDataFrame(rows, "edition long, doc_id long, kind string, text string")
    same_text = " ".join(str(100 + k) for k in range(10))
    df = dedup.cross_pairs(docs([(1, k, "ed"[k % 2], same_text) for k in range(80)]), "edition", "kind")
    assert joined(df) <= 80 and df.count() == 1600
    monkeypatch.setattr(dedup, "_BLOCK", 7)
    monkeypatch.setattr(dedup, "_AT_ONCE", 200)
    draw = random.Random(3)
    sets = [(k % 2, k, draw.choice("edf"), sorted({draw.randrange(100, 130) for _ in range(draw.choice((2, 4, 12)))})) for k in range(60)]
    sets += [(0, 90, None, [100, 101, 102]), (None, 91, "e", [100, 101, 102]), (0, None, "e", [100, 101, 102]), (0, 7, "f", [100, 101, 102, 103]), (5, 92, "e", [])]
    got = dedup.cross_pairs(docs([(e, d, k, " ".join(map(str, t))) for e, d, k, t in sets] + [(0, 93, "e", None)]), "edition", "kind")
    whole = [(e, d, k, set(t)) for e, d, k, t in sets if len(t) >= 3 and None not in (e, d, k)]
    want = [(e, d, b, len(t & u), min(len(t), len(u))) for e, d, k, t in whole for f, b, l, u in whole if e == f and k != l and d < b and 100 * len(t & u) >= 34 * min(len(t), len(u))]
    assert sorted(map(tuple, got.collect())) == sorted(want) != []

def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_topics_and_units_of_an_item_are_gathered_and_not_joined(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert joined(catalogue.QUERIES["derived_topic_units"](spark, sf)) <= lines
    rows = spark.createDataFrame([(1, 1, (3,)), (1, 1, (3,)), (1, 2, None), (1, None, (None,)), (2, 1, (3,)), (None, 1, (3,))], "item_id long, unit long, topic struct<topic: long>")
    assert _rows(reads.tied(rows)) == [(3, 1, 2), (3, 2, 1), (None, 1, 1), (None, 2, 1)]


def test_tags_gone_and_come_are_told_in_one_aggregate(spark, sf):
    assert joined(catalogue.QUERIES["rescore_diff"](spark, sf)) == 0
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 50), (1, 2, 5), (1, 3, 50), (None, 4, 5), (None, 4, 50), (None, None, 50), (2, 5, None), (2, 6, None), (2, 6, 7)], "item_id long, unit long, n long")
    got = relational.difference(rows, ["item_id", "unit"], F.col("n") >= 10, F.col("n") <= 45)
    assert _rows(got) == _rows(spark.createDataFrame([(1, 2, "added"), (1, 3, "removed"), (None, None, "removed"), (2, 6, "added")], "item_id long, unit long, change string"))


def test_changes_of_tags_are_counted_without_a_join(spark, sf):
    assert joined(catalogue.QUERIES["unit_reconcile"](spark, sf)) == 0
    tags = spark.createDataFrame([(1, 1, 5), (1, 2, 20), (1, 3, 50), (1, None, 20), (2, 1, None), (None, 1, 20)], "item_id long, unit long, hits long")
    assert _rows(desk.unit_changes(tags, F.col("hits") >= 10, F.col("hits") <= 45)) == [(1, 2, 2, 1), (None, 1, 1, 0)]


def test_what_was_asked_is_put_in_order_where_it_is_gathered(spark, sf):
    plan = catalogue.QUERIES["past_question_evidence"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1
    keywords = spark.createDataFrame([(1, k) for k in "aabcdefa"] + [(2, "b"), (3, "none"), (None, "a")], "item_id long, keyword string")
    asked = spark.createDataFrame([(k, n, "0/1") for k, n in zip("abcdef", (2, 9, 3, 3, 9, 1))], "keyword string, n long, formats string")
    questions = spark.createDataFrame([("a", 7, 1990), ("a", 8, 1990), ("a", 9, 1980), ("f", 6, 1990), ("c", 5, 1970)], "keyword string, question long, year int")
    assert _rows(reads.evidence(keywords, asked, questions)) == [(1, "b:9:0/1,e:9:0/1,c:3:0/1,d:3:0/1", "6,7"), (2, "b:9:0/1", None), (None, "a:2:0/1", "7,8")]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_articles_are_made_where_their_page_is(spark, sf):
    for name in ("page_segments", "segmented_articles"):
        df = catalogue.QUERIES[name](spark, sf)
        # One exchange numbers the questions, one deals their pages.
        assert _exchanges(df) == 2 and joined(df) == 0, name
    blocks = spark.createDataFrame([(1, 1, 1, 0.0, 80.0, 90.0, 90.0, 20.0, "A headline as they are set"), (1, None, 1, 0.0, 80.0, 90.0, 90.0, 20.0, "A headline as they are set")], "doc int, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert [(r.block, r.role, r.body_size) for r in segmentation.guarded(segmentation.classified(blocks)).collect()] == [(1, "body", 20.0)]


def test_lines_of_banks_are_dealt_over_all_partitions(spark, sf):
    assert "REPARTITION_BY_NUM" in catalogue.QUERIES["bank_questions"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_tags_to_judge_are_dealt_over_all_partitions(spark, sf):
    assert "REPARTITION_BY_NUM" in catalogue.QUERIES["seeded_sample"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_page_articles_are_made_where_their_page_is(spark, sf):
    df = catalogue.QUERIES["page_articles"](spark, sf)
    assert _exchanges(df) == 2 and joined(df) == 0
