"""Findings of round 3: each test fails on the code before it."""

from __future__ import annotations

import re

from helpers import joined, same
from pyspark.sql import functions as F

from lectern.functions import lists
from lectern.functions import text as X
from lectern.operators import dedup, desk, reads
from lectern.plans import catalogue


def test_pairs_that_cannot_reach_the_score_are_never_counted(spark, monkeypatch):
    # All share their rarest headline word with one other, and little besides.
    rows = [(k, "e", f"odd{k // 2} " + " ".join(f"h{k}x{j}" for j in range(9)) + "\n" + " ".join(f"b{k}x{j}" for j in range(30))) for k in range(40)]
    rows += [(100, "e", "one two three four\nfive six seven"), (101, "e", "one two three four\nfive six eight"), (102, "e", "one two three four\nfive six seven")]
    written = []
    plain = dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df, *a: written.append(plain(df, *a)) or written[-1])
    got = dedup.similar_pairs(spark.createDataFrame(rows, "doc_id long, edition string, text string"), "edition").collect()
    assert sorted(tuple(r) for r in got) == [("e", 100, 101, 4, 4, 6, 8), ("e", 100, 102, 4, 4, 7, 7)]
    assert [t.count() for t in written if "head_shared" in t.columns] == [1]


def test_findings_join_no_unit_that_cannot_be_among_the_first(spark):
    topics = spark.createDataFrame([(i, t, i % 3 + t, i % 2 == 0) for i in range(50) for t in range(3)], "item_id long, topic long, hits long, head boolean")
    units = spark.createDataFrame([(u % 3, u) for u in range(600)] + [(0, 1), (1, 1), (2, None), (None, 7), (None, 2000)], "topic long, unit long")
    u = topics.join(units, "topic").groupBy("item_id", "unit").agg(F.max("head").alias("from_headline"), F.sum("hits").alias("weight")).createOrReplaceTempView("fed_units")
    want = spark.sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY from_headline DESC, weight DESC, unit) AS place FROM fed_units) WHERE place <= 6")
    got = reads.findings(topics, units)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert u is None and joined(got) <= 50 * 3 * 6 * 2


def test_datelines_letter_by_letter(spark, tmp_path):
    texts = ["Erßtzbe und\nx", "straße", "ſabcd x", "eluru\u0085", "eluru\tx", "eluru\r\nx", "ŉabcd x", None, "", "ABCD x"]
    spark.createDataFrame([(k, t, "de", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    same(catalogue.QUERIES["named_places"](spark, str(tmp_path)), str(tmp_path), catalogue.ORACLES["named_places"])


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_readers_days_are_not_dealt_again(spark, sf):
    top = next(x for x in _plan(catalogue.QUERIES["reader_days"](spark, sf)).splitlines() if "Join" in x)
    assert re.search(r"Join \w+, \(day#\d+ = day#\d+\)", top), top


def test_edges_ask_for_first_letters(spark):
    for p in (*[p for _, p in lists.SUBJECTS], *[p for _, p in lists.VETO], lists.SPORT_REPORT, r"\b(?:one|two)\b", r"\bbod(?:y|ies)\b"):
        assert re.match(r"(\(\?i\))?\(\?=\[[A-Za-z]+\]\)", lists.edged(p)), p
    for p in (r"\b(?:s?one|two)\b", r"\b(?:one|\d+)\b", r"\bone|two", r"\b(?:one)?two", r"\b(?:one)|two", r"^one\b", r"\bs*x"):
        assert lists.edged(p) == p.replace(r"\b", lists.EDGE)
    texts = spark.createDataFrame([(t,) for t in ("bodies", "a body.", "nobody", "éone", "one_", "TWO one", "", None, "writ", "Bills", "murdered")], "t string")
    for p in (lists.SUBJECTS[0][1], lists.VETO[0][1], r"\b(?:one|two)\b", r"\bbod(?:y|ies)\b"):
        assert texts.filter(F.col("t").rlike(lists.edged(p)) != F.col("t").rlike(p.replace(r"\b", lists.EDGE))).count() == 0


def test_sets_and_genres_are_made_once(spark):
    t = spark.createDataFrame([("a b", "b c")], "h string, b string")
    assert _plan(t.select(X.jaccard(X.tokens(F.col("h")), X.tokens(F.col("b"))).alias("x"))).count("regexp_replace(") == 2
    assert _plan(t.select(desk.vetoed(F.col("h"), F.col("b"), (), "x", "x", "x", genre=F.reverse("h")).alias("x"))).count("reverse(") == 1


def test_words_of_texts_are_read_once(spark, sf):
    assert not any("documents" in f for f in catalogue.QUERIES["vocab_prefix_truncation"](spark, sf).inputFiles())


def test_glyphs_of_a_font_are_counted_by_width(spark):
    g = spark.createDataFrame([("a", 1.0 + k % 4) for k in range(400)] + [("b", 2.0)] * 3, "font string, width double")
    out = desk.glyph_reference(g, ["font"])
    assert [tuple(r) for r in out.collect()] == [("a", 1.0, 400)]
    window = _plan(out).split("Window")[1]
    assert "Aggregate" in window.split("LogicalRDD")[0]
