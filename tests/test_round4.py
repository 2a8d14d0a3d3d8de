"""Findings of round 4: each test fails on the code before it."""

from __future__ import annotations

import random

import pytest
from helpers import same

from lectern.operators import dedup
from lectern.plans import catalogue
from lectern.plans.roles import articles

DOCS = "doc_id long, text string, lang string, source string"


def _tables(monkeypatch):
    written, plain = [], dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df, *a: written.append(plain(df, *a)) or written[-1])
    return written


@pytest.mark.parametrize("query", ["dup_components", "dup_collapsed", "paper_lane"])
def test_groups_are_tied_without_all_their_pairs(spark, tmp_path, monkeypatch, query):
    text = "flood in the delta district " + " ".join(f"w{k}x" for k in range(30))
    rows = [(k, f"{text} own{k}\nbody of the day {k}", "en", "src") for k in range(60)] + [(99, "other words here", "en", "src"), (100, None, "en", "src")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    written = _tables(monkeypatch)
    same(catalogue.QUERIES[query](spark, str(tmp_path)), str(tmp_path), catalogue.ORACLES[query])
    assert max(t.count() for t in written) <= 2 * 60


def test_sets_of_several_blocks_meet_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "_SMALL", 12, raising=False)
    r = random.Random(4)
    words = lambda n, k: " ".join(f"w{min(int(r.paretovariate(1)), k)}x" for _ in range(n))
    rows = [(k, words(r.randint(0, 9), 40) + r.choice(["", "\n" + words(r.randint(0, 60), 300)]), "en", f"s{k % 2}") for k in range(160)]
    rows += [(200, "éclair\nau lait", "fr", None), (201, "éclair\nau lait", "fr", None), (202, "a b\n", "fr", "s0"), (203, "", "fr", "s0"), (204, None, "fr", "s0"), (205, "x " * 900 + "long headline", "fr", "s0"), (206, "x " * 900 + "long headline", "fr", "s1"), (207, "y " * 900 + "long headline here", "fr", "s1")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    for query in ("near_dup_jaccard", "dup_components", "dup_collapsed"):
        same(catalogue.QUERIES[query](spark, str(tmp_path)), str(tmp_path), catalogue.ORACLES[query])
    got = dedup.similar_pairs(articles(spark, str(tmp_path)), "edition")
    met = [tuple(x) for x in got.select("edition", "a", "b").collect()]
    assert len(met) == len(set(met)) > 100


def test_low_scores_are_refused(spark):
    with pytest.raises(ValueError):
        dedup.similar_pairs(spark.createDataFrame([(1, "e", "x")], "doc_id long, edition string, text string"), "edition", percent=40)


@pytest.mark.parametrize("query", ["dup_collapsed", "dup_components"])
def test_whole_texts_are_compared(spark, tmp_path, query):
    many = lambda c, n: " ".join(f"{c}{k}x" for k in range(n))
    rows = [(1, f"one two three\n{many('a', 300)} {many('s', 3000)}"), (2, f"one four five\n{many('b', 300)} {many('s', 3000)}"), (3, f"six seven eight\n{many('t', 300)} {many('c', 3000)}"), (4, f"six nine ten\n{many('t', 300)} {many('d', 3000)}")]
    spark.createDataFrame([(k, t, "en", "s") for k, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = catalogue.QUERIES[query](spark, str(tmp_path))
    same(out, str(tmp_path), catalogue.ORACLES[query])
    tied = {r.node for r in out.collect()} if query == "dup_components" else {r.leader for r in out.collect() if r.copies > 1}
    assert tied == ({1, 2} if query == "dup_components" else {1})


def test_a_readers_rows_carry_what_items_say_of_themselves(spark, sf):
    plan = catalogue.QUERIES["reader_days"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    row = plan.split("Join")[0].lower()
    assert not any(x in row for x in ("date_format", "gettimestamp", "floor", "greatest", "least")), row
