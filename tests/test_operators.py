"""Operators on small rows made by hand."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import aliases, dedup, desk, genre, layout, quality, ranking, reads, relational, schedule, segmentation, vocabulary
from lectern.sources import readers


@pytest.mark.parametrize(("alias", "text", "strict", "found"), [
    ("fertilizer", "new fertilizers sold", False, True), ("direct tax", "on direct taxes", False, True), ("municipality", "two municipalities", False, True),
    ("RTI", "all PARTIES", True, False), ("port", "the airport", False, False), ("export", "an exporter", False, False), ("cole", "école", False, True), ("cole", "recole", False, False),
])
def test_alias_patterns(spark, alias, text, strict, found):
    assert spark.range(1).select(F.lit(text).rlike(X.alias_pattern(alias, strict))).first()[0] is found


def test_local_day_at_midnight(spark):
    at = [("2026-08-22 20:30:00", "2026-08-23"), ("2026-08-22 03:00:00", "2026-08-22"), ("2026-08-22 19:00:00", "2026-08-23")]
    df = spark.createDataFrame(at, "t string, d string").select(X.local_day(F.to_timestamp("t")).cast("string").alias("got"), "d")
    assert all(r.got == r.d for r in df.collect())


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    got = df.select(X.tokens(F.col("t")), X.n_words(F.col("t")), X.headline_signature(F.col("t")), X.html_text(F.col("t")), X.jaccard(X.tokens(F.col("t")), X.tokens(F.col("t")))).collect()
    assert all(r[0] in ([""], []) and r[1] == 0 and r[2] == "" and r[3] == "" and r[4] == 0 for r in got)


def test_ligatures(spark):
    r = spark.range(1).select(X.repaired_ligatures(F.lit("con#ict, OF#CE, #nal"), "#", {"fl": ("ict",)})).first()
    assert r[0] == "conflict, OFFICE, final"


def test_leitner(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, 1, t(1), 1, True), (1, 1, t(2), 2, True), (1, 1, t(3), 3, False), (1, 1, t(4), 4, True)], "user_id long, mcq long, ts timestamp, attempt_id long, ok boolean")
    r = schedule.replayed(df).first()
    assert (r.reviews, r.box, str(r.due)) == (4, 2, "2024-01-07")


def test_upserts(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    rows = lambda how: sorted((r.k, r.v) for r in relational.upsert(a, b, ["k"], how).collect())
    assert rows("update") == rows("fill") == [(1, "a"), (2, "b"), (3, "c")]
    assert {r.k: r.v for r in relational.upsert(a, b, ["k"], "ignore").collect()} == {1: "a", 2: None, 3: "c"}


def test_questions(spark):
    cols = "question string, option_a string, option_b string, option_c string, option_d string, correct_option string, format string, explanation string, fact_as_of string"
    rows = [("Which is generally so?", "Rs 2,880", "rs. 2880", "All of the above", "x", "a", "direct_recall", "e", "2024"), ("Which one?", "a1", "b1", "c1", "d1", "b", "direct_recall", "e", "2024"), (None, None, None, None, None, None, None, None, None)]
    got = quality.inspected(spark.createDataFrame(rows, cols)).select("fatal", "soft").collect()
    assert set(got[0].fatal) == {"hedged stem", "option about options"} and got[1].fatal == [] and "no key" in got[2].fatal


def test_groups_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.leader for r in dedup.groups(pairs).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def test_feeds_and_press_pages(spark):
    xml = "<rss><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>Hi</p>]]></description></item><item><title>no date</title><link>http://x/2</link></item></rss>"
    r = readers.feed_items(spark.createDataFrame([("f", xml), ("g", None)], "feed string, xml string")).collect()
    assert [(x.title, x.link, str(x.day), x.summary) for x in r] == [("A & B", "http://x/1", "2024-01-05", "Hi")]
    html = "<h3>Finance</h3><a href='/1'>one</a><a href='/2'>two</a><h3>Law</h3><a href='/3'>three</a>"
    p = readers.press_index(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()
    assert [(x.ministry, x.link, x.title) for x in p] == [("Finance", "/1", "one"), ("Finance", "/2", "two"), ("Law", "/3", "three")]


BANK = """| 9 | before any paper | a | Count-based |
# Group Screening Test 2019
*Source: `a.pdf`*
*Source: `b.pdf`*
## Polity
| q | gloss | keywords | format |
| 1 | why? | **law**, _rule_ *(old)*,  | Direct recall (multi-select) |
### Courts
| 2 | how? | art | Negative match |
## Duplicate of Polity
| 3 | lost | x | y |
### Still lost
| 4 | lost | x | y |
## History
| 5 | when? | era | Something new |
## Section: GROUP MAINS 2021, Paper – II
| 1 | what? | z | list  matching |
# Screening test of 2019 (again)
*Source: `c.pdf`*
| 2 | how again? | art | Statement-based |
| 6 | x | y |"""


def test_question_banks(spark):
    """Two headings of one paper merge, sections of duplicates are skipped, a paper's start resets what was carried."""
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(BANK.split("\n"))], "file string, line_no int, value string")
    bank = readers.question_bank(lines)
    rows = [(r.slug, r.section, r.source, r.q_no, r.gloss, r.keywords, r.format) for r in bank.orderBy("line_no").collect()]
    one, two = "g2-2019-prelims-screening-bank", "g2-2021-mains-paper-2-bank"
    assert rows == [
        (one, "Polity", "a.pdf", 1, "why?", ["law", "rule"], "direct_recall"), (one, "Courts", "a.pdf", 2, "how?", ["art"], "negative_statement"), (one, "History", "a.pdf", 5, "when?", ["era"], None), (two, "", None, 1, "what?", ["z"], "list_matching"), (one, "", "c.pdf", 2, "how again?", ["art"], "statement_based"),
    ]
    papers = {r.slug: r for r in readers.bank_papers(bank).collect()}
    assert (papers[one].n, papers[one].first_q, papers[one].last_q, papers[one].twice, papers[one].sources) == (4, 1, 5, [2], ["a.pdf", "c.pdf"]) and len(papers[one].titles) == 2
    assert {(r.slug, r.q_no): r.gloss for r in readers.bank_questions(bank).collect()}[one, 2] == "how?"


def test_question_banks_against_a_loop(spark):
    rng = random.Random(3)
    kinds = ["# Mains 2020 Paper {}", "## Section: Paper-III mains 2022 {}", "## Topic {}", "## duplicate {}", "### Part {}", "*Source: `s{}`*", "| {} | g | k | f |", "| {} | g | k | f |", "| {} | g | k | f | more |", "text {}", ""]
    files = {f: [rng.choice(kinds).format(rng.randrange(1, 9)) for _ in range(60)] for f in range(20)}
    want = []
    for f, lines in files.items():
        title, section, ignored, block, source = None, "", False, -1, {}
        for k, v in enumerate(lines):
            if v.startswith("## Section:") or v.startswith("# "):
                title, section, ignored, block = v.removeprefix("## Section:").removeprefix("#").strip(), "", False, block + 1
            elif v.startswith("## "):
                ignored = v.lower().startswith("## duplicate")
                section = section if ignored else v[3:].strip()
            elif v.startswith("### "):
                section = v[4:].strip()
            elif v.startswith("*Source"):
                source.setdefault(block, v.split("`")[1])
            elif v.startswith("|") and not ignored and title:
                want.append([f, k, title, section, block])
        want = [[*w[:4], source.get(w[4])] if len(w) == 5 and w[0] == f else w for w in want]
    df = spark.createDataFrame([(f, k, v) for f, lines in files.items() for k, v in enumerate(lines)], "file int, line_no int, value string")
    assert sorted([r.file, r.line_no, r.title, r.section, r.source] for r in readers.question_bank(df).collect()) == sorted(want)


def test_uploads(spark):
    files = spark.createDataFrame([("p", "d", b"%PDF1"), ("p", "d", b"%PDF1"), ("p", "d", b"no")], "publication string, day string, content binary")
    new = readers.new_uploads(files, spark.createDataFrame([], "publication string, day string, file_hash string"))
    assert new.count() == 1 and readers.new_uploads(files, new).count() == 0


def test_page_layout(spark):
    blocks = [("d", 1, 1, 0, 0, 200, 20, 20.0, "Head one"), ("d", 1, 2, 0, 30, 200, 90, 10.0, "x" * 200), ("d", 1, 3, 300, 0, 500, 20, 20.0, "Head two"), ("d", 1, 4, 300, 30, 500, 90, 10.0, "y" * 200), ("d", 1, 5, 210, 60, 250, 90, 10.0, "z" * 50)]
    b = layout.roles(spark.createDataFrame([(*x[:3], *map(float, x[3:7]), *x[7:]) for x in blocks], "doc string, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string")).cache()
    owned = layout.owners(b)
    assert {r.block: r.owner for r in owned.collect()} == {2: 1, 4: 3, 5: None}
    assert {r.block: r.owner for r in layout.adopted(b, owned).collect()}[5] in (1, 3)
    assert {r.owner for r in layout.articles(b, owned).collect()} == {1, 3}
    assert layout.column_width(b).first().column_width == 200 and layout.body_size(b).first().body_size == 10.0


def test_streamed_boxes_equal_the_batch_replay(spark, tmp_path):
    from lectern.streaming.reviews import boxes

    schema = "user_id long, mcq long, ts timestamp, attempt_id long, ok boolean"
    rows = [(u, 1, datetime.datetime(2024, 1, d), d, (u + d) % 3 > 0) for u in range(3) for d in range(1, 9)]
    for k, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(sorted(part, key=lambda r: r[2]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (spark.readStream.schema(schema).parquet(str(tmp_path / "in")).transform(boxes).writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120))
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("user_id").agg(F.max("reviews").alias("reviews")).collect()
    assert {r.user_id: r.reviews for r in out} == {0: 8, 1: 8, 2: 8}


def test_alias_hits(spark):
    rows = [(1, "Direct taxes rose.\nA direct tax, an école and two municipalities; direct, tax. SCs and ITDAs, scs."), (2, None), (3, "écoles"), (4, "tax tax tax"), (5, "a_tax taxé tax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = [("t", "direct tax"), ("m", "municipality"), ("e", "école"), ("x", "absent"), ("s", "SC", True), ("a", "ITDA", True), ("r", "tax tax")]
    got = {(r.doc_id, r.alias): (r.hits, r.plain, r.in_headline, r.plain_headline) for r in aliases.alias_hits(docs, vocabulary).collect()}
    assert got == {(1, "direct tax"): (2, 1, True, False), (1, "municipality"): (1, 0, False, False), (1, "école"): (1, 1, False, False), (3, "école"): (1, 1, True, True), (1, "ITDA"): (1, 0, False, False), (4, "tax tax"): (1, 1, True, True)}
    assert "Exchange" not in aliases.alias_hits(docs, vocabulary)._jdf.queryExecution().toString()


def test_alias_hits_are_those_of_the_patterns(spark):
    vocabulary = [("a", "tax"), ("b", "policy"), ("c", "class"), ("d", "de la"), ("e", "as"), ("f", "UPSC"), ("g", "Lok Sabha", True), ("h", "OBC", True), ("i", "a b a"), ("j", "re:form")]
    texts = ["Taxes policies classes tax-policy de  la de las as AS upsc UPSC UPSCs", "Lok Sabhas Lok Sabha lok sabha OBCs OBC", "a b a b a; re:form re:forms reform", "_tax tax_ 9tax tax9 étax tax,policy"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.alias): r.hits for r in aliases.alias_hits(docs, vocabulary).collect()}
    text = lambda strict: F.col("text") if strict else X.norm(F.col("text"))
    counts = docs.select("doc_id", *[F.regexp_count(text(len(v) > 2), F.lit(X.alias_pattern(*v[1:]))).alias(v[1]) for v in vocabulary]).collect()
    assert got == {(r.doc_id, v[1]): r[v[1]] for r in counts for v in vocabulary if r[v[1]]}


@pytest.mark.parametrize(("text", "clean"), [
    ("The Alluri Raju Academy met.", 0), ("Directorate of Public Health met.", 0), ("Directorate of Public Health. Spending on public health rose.", 1), ("BRICS+ Legal Forum", 0), ("the BRICS grouping", 1), ("Election Commission of India said", 1),
    ("public health and the academy", 1), ("public health of the academy", 1), ("public health for academy", 0), ("Academy: public health", 1), ("Academy public health", 0), ("academic public health", 1),
])
def test_occurrences_inside_proper_names(spark, text, clean):
    """One clean occurrence keeps an alias; one linking word is passed over, not two."""
    hits = aliases.alias_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), [("a", "Alluri Raju"), ("b", "public health"), ("c", "BRICS"), ("d", "Election Commission")], ("academy", "Directorate"))
    assert [r.clean for r in hits.collect()] == [clean]
    assert aliases.clean_hits(hits).count() == (clean > 0)


def test_windows_lists_and_limits():
    assert reads.item_ids(None) is None and reads.item_ids("") is None and reads.item_ids("x,-1,0") == [] and reads.item_ids(" 7,5,7") == [5, 7]
    assert [reads.cap_of(v, 12, 60) for v in ("0", "all", "ALL ", "5", "100", "x", None, "-3")] == [0, 0, 0, 5, 60, 12, 12, 12]


def test_month_ranges(spark):
    df = spark.createDataFrame([("2024-11-30",), ("2024-12-01",), ("2024-12-31",), ("2025-01-01",), (None,)], "d string").select(F.to_date("d").alias("d"))
    assert df.filter(reads.in_month(F.col("d"), "2024-12")).count() == 2
    assert df.filter(reads.in_window(F.col("d"), start="2024-12-01")[0]).count() == 3


@pytest.mark.parametrize(("reply", "found"), [
    ('```json\n[{"a": 1}, {"a": "}"}]\n```', 2), ('[{"a": "line\nbreak"}, {"a": {"b": [1, {"c": 2}]}}, {"a": "cut', 2), ("no list at all", 0), ("", 0), ('[{"a": "q\\"}"}, {bad}, {"b": 1}]', 2), ('[{"a": 1}', 1),
])
def test_whole_objects(reply, found):
    assert len(desk.whole_objects(reply)) == found


def test_question_shapes(spark):
    cols = "question string, option_a string, option_b string, option_c string, option_d string, correct_option string, format string, explanation string, fact_as_of string"
    ar = ("Assertion (A): x. Reason (R): y. Which?", "Both A and R are true and R explains A", "Both A and R are true but R does not explain A", "A is true, R is false", "A is false, R is true", "a", "assertion_reason", "e", "2024")
    ms = ("Consider:\nI. one\nII. two", "I only", "II only", "III only", "None of them", "a", "multi_statement", "e", "2024")
    got = [r.fatal for r in quality.inspected(spark.createDataFrame([ar, (ar[0], "x", *ar[2:]), ms], cols)).collect()]
    assert got == [[], ["not the four fixed options"], ["option about options", "option beyond the statements"]]


def test_bylines(spark):
    df = spark.createDataFrame([("By A. Person, NEW DELHI",), ("VIJAYAWADA",), ("By B PTI",), (None,)], "b string")
    assert [tuple(r) for r in df.select(X.dateline(F.col("b")), X.without_dateline(F.col("b"))).collect()] == [("NEW DELHI", "By A. Person"), ("VIJAYAWADA", "VIJAYAWADA"), ("", "By B PTI"), ("", "")]


def test_rate_windows_over_batches(spark):
    rows = [(k, float(t)) for k in (None, 1, 2) for t in (0, 10, 20, 3600, 3601, 9000)]
    got = {r.u: (r.windows, r.refused) for r in schedule.fixed_windows(spark.createDataFrame(rows, "u long, t double"), "u", "t", 3600, 2).collect()}
    assert got == {None: (3, 1), 1: (3, 1), 2: (3, 1)}
    assert schedule.fixed_windows(spark.createDataFrame([], "u long, t double"), "u", "t", 3600, 2).isEmpty()


def test_resumed_and_written(spark, tmp_path):
    from lectern.sources import sinks

    log = spark.createDataFrame([(1, "a", "new"), (3, "a", "done"), (2, "b", "new")], "line_no int, key string, state string")
    assert {r.key: r.state for r in readers.resumed(log).collect()} == {"a": "done", "b": "new"}
    sinks.write_text(log, "state", str(tmp_path / "out"))
    sinks.write_text(log.filter("key = 'b'"), "state", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["new"]


def test_feeds_with_dates_and_categories(spark):
    xml = "<item><title>T</title><link>http://x</link><dc:date>2024-05-06T01:02:03Z</dc:date><category>News</category></item>"
    r = readers.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).first()
    assert (str(r.day), r.category) == ("2024-05-06", "News")


def _genre(spark, body="", told="", byline=None, section=None, marker=None, label=None):
    row = spark.createDataFrame([(body, told, byline, section, marker, label)], "body string, told string, byline string, section string, marker string, label string")
    return tuple(row.select(genre.genre_of(*[F.col(c) for c in row.columns]).alias("g")).select("g.*").first())


def test_genre_in_six_steps(spark):
    talk = "BC: It is so. Why? AS: It is. Buddha Chandrasekhar: So it is."
    assert _genre(spark, talk, "PARLEY", "By A", "Editorial", "column", "NOTEBOOK") == ("column", "page label NOTEBOOK")
    assert _genre(spark, talk, "FIFTY YEARS AGO " + talk, None, "Editorial")[0] == "archive"
    assert _genre(spark, " " + talk, talk)[0] == "interview" and _genre(spark, " " + talk.replace("?", "."), "")[0] == "report"
    assert _genre(spark, "So. The views expressed are personal.", "", "By A", "Business")[0] == "oped"
    assert _genre(spark, "x", "x", "By A", "Opinion") == ("oped", "signed piece on the Opinion page") and _genre(spark, "x", "x", " ", "Leader page") == ("editorial", "unsigned piece on the Leader page page")
    assert _genre(spark, None, None, None, "Business") == ("report", "Business page") and _genre(spark) == ("report", "no contrary signal")


def test_labels_and_sections_of_a_page(spark):
    blocks = [
        (1, 1, 1, 10.0, 20.0, 300.0, 30.0, "THE HINDU 6 Friday, August 21, 2026 Vijayawada Editorial"), (1, 1, 2, 10.0, 40.0, 300.0, 50.0, "Vijayawada Text & Context"), (1, 2, 3, 10.0, 20.0, 300.0, 30.0, "Vijayawada www.a.com 5"), (1, 2, 4, 10.0, 400.0, 300.0, 410.0, "Vijayawada Sport"),
        (1, 1, 5, 100.0, 190.0, 160.0, 200.0, "PARLEY"), (1, 1, 6, 400.0, 215.0, 460.0, 225.0, "NOTEBOOK"), (1, 1, 7, 100.0, 150.0, 160.0, 165.0, "FROM THE ARCHIVES"), (1, 1, 8, 0.0, 0.0, 0.0, 0.0, None),
    ]
    b = spark.createDataFrame(blocks, "doc int, page int, block int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r.page, r.section) for r in genre.sections(b).collect()} == {(1, "Editorial")}
    heads = [(1, 1, 20, 100.0, 205.0, 200.0), (1, 1, 21, 100.0, 241.0, 200.0), (1, 1, 22, 450.0, 221.0, 600.0), (1, 1, 23, 473.0, 230.0, 600.0), (1, 2, 24, 100.0, 205.0, 200.0), (1, 1, 25, 100.0, 195.9, 200.0), (1, 1, 26, 170.0, 240.0, 200.0)]
    a = spark.createDataFrame(heads, "doc int, page int, id int, x0 double, y0 double, x1 double")
    assert {r.id: r.marker for r in genre.labelled(a, b).collect()} == {20: "interview", 21: None, 22: "column", 23: None, 24: None, 25: "archive", 26: "interview"}


def test_stories_are_merged_before_the_gate(spark):
    """Two copies would take two of an edition's places; merged, one place is left for another story."""
    docs = [(k, f"head {k}", f"body {k}", "A", k, 1) for k in range(4)] + [(4, "head 0", "body 0, and more of it", "B", 0, 3), (5, "head 0", "body 0", None, 2, 2), (6, "head 0", "body 0", "C", 9, 0)]
    printed = spark.createDataFrame([("e", *d, False) for d in docs], "edition string, doc_id long, headline string, body string, publication string, page int, prominence int, area boolean")
    members = spark.createDataFrame([(k, 0) for k in (0, 4, 5, 6)], "node long, leader long")
    stories = dedup.merged_stories(printed, members)
    one = {r.lead: r for r in stories.collect()}
    assert set(one) == {1, 2, 3, 4}
    s = one[4]
    assert s.body == "body 0, and more of it\n\n[Also reported in A]\nbody 0" and (s.copies, s.prominence, s.pages, s.publications) == (4, 3, [0, 2, 9], ["A", "B", "C"])
    scored = lambda df, key: desk.gate(df.withColumn("veto", F.lit(None).cast("string")).withColumn("points", 6.0 + F.col("prominence")), "edition", F.col("prominence").desc(), key, most=3)
    assert {r.doc_id for r in scored(printed, "doc_id").filter("keep").collect()} == {4, 5, 0}
    assert {r.lead for r in scored(stories, "lead").filter("keep").collect()} == {4, 1, 2}


PAGE = "doc int, page int, block int, x0 double, y0 double, x1 double, y1 double, size double, text string"
PROSE = "words of a story that is long enough to be kept " * 4


def test_drop_caps_make_headlines_of_lines_above(spark):
    """Fragments go on the line above them; a line that one drop cap took is not there for the next; owned drop caps take none."""
    rows = [
        (1, 1500.0, 800.0, 1600.0, 810.0, 9.0, PROSE), (2, 100.0, 200.0, 200.0, 220.0, 20.0, "A line that says it all."), (3, 100.0, 222.0, 200.0, 242.0, 20.0, "and goes on here."), (4, 100.0, 250.0, 120.0, 290.0, 40.0, "A"), (5, 130.0, 252.0, 140.0, 290.0, 40.0, "B"),
        (6, 100.0, 292.0, 200.0, 400.0, 9.0, "nd so it was. " + PROSE), (7, 500.0, 200.0, 700.0, 220.0, 20.0, "A headline as they are set"), (8, 500.0, 230.0, 700.0, 240.0, 20.0, "A quotation."), (9, 500.0, 250.0, 520.0, 290.0, 40.0, "C"), (10, 500.0, 300.0, 600.0, 400.0, 9.0, PROSE),
        (11, 300.0, 300.0, 650.0, 400.0, 9.0, "wide " * 9), (12, 900.0, 120.0, 920.0, 160.0, 40.0, "D"), (13, 900.0, 170.0, 1000.0, 180.0, 9.0, "PARTY » PAGE 9 CONTINUED ON » PAGE 12"),
    ]
    blocks = spark.createDataFrame([(1, 1, *r) for r in rows], PAGE)
    b = segmentation.guarded(segmentation.promoted(segmentation.classified(blocks)))
    role = {r.block: (r.role, r.text) for r in b.collect()}
    assert role[2] == ("headline", "A line that says it all. and goes on here.") and role[3][0] == "noise" and role[8][0] == "secondary" and role[11][0] == "merged" and role[13][0] == "jumpline"
    a = {r.id: r for r in segmentation.segmented(blocks).collect()}
    assert set(a) == {2, 7} and a[2].body.startswith("And so it was.") and a[7].standfirst == "A quotation." and a[7].body.startswith("Cwords of a story")


def test_orphans_widen_the_article_they_join(spark):
    rows = [(1, 100.0, 100.0, 200.0, 120.0, 20.0, "A headline as they are set"), (2, 100.0, 130.0, 200.0, 200.0, 9.0, PROSE), (3, 320.0, 130.0, 420.0, 200.0, 9.0, "near " + PROSE), (4, 540.0, 130.0, 640.0, 200.0, 9.0, "next " + PROSE), (5, 800.0, 130.0, 900.0, 200.0, 9.0, "far " + PROSE)]
    got = {r.block: (r.owner, r.late) for r in segmentation.adopted(segmentation.classified(spark.createDataFrame([(1, 1, *r) for r in rows], PAGE))).collect()}
    assert got == {2: (1, False), 3: (1, True), 4: (1, True), 5: (None, False)}


def test_page_offsets_need_a_quorum(spark):
    rows = [(d, p, 1, f"THE HINDU {n} Friday, August 21") for d, ns in ((1, (1, 1, 2, 3)), (2, (1, 1, 3)), (3, (9, 9, 9, 9))) for p, n in enumerate(ns, 1)] + [(4, 1, 1, None)]
    blocks = spark.createDataFrame(rows, "doc int, page int, block int, text string")
    assert dict(segmentation.page_offset(blocks).collect()) == {1: 1, 2: 0, 3: 0, 4: 0}


def test_searches_by_keyword_and_what_is_left_to_draft(spark):
    items = spark.createDataFrame([(1, "A 5% rise"), (2, "A 50 rise"), (3, None), (4, "none")], "item_id int, headline string")
    words = spark.createDataFrame([(3, "tax_5%"), (3, "5%"), (2, "x")], "item_id int, keyword string")
    find = lambda term, least=2: sorted(r.item_id for r in reads.search(items, ["headline"], words, "item_id", "keyword", term, least).collect())
    assert find("5%") == [1, 3] and find(" x ", 1) == [2, 3] and find("x") == [] and find(None) == [] and find("a ") == [] and find("A 5") == [1, 2]
    judged = spark.createDataFrame([("e", k, k < 15, k % 3 == 0) for k in range(30)] + [("f", k, True, k < 14) for k in range(14)], "edition string, id int, high boolean, drafted boolean")
    left = reads.remainder(judged, "edition", [F.col("id")]).collect()
    # 10 wanted and 10 drafted before make a target of 20; all of the other edition's are drafted.
    assert [r.id for r in sorted(left, key=lambda r: r.place)] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14] and {r.edition for r in left} == {"e"}


def test_places_of_an_article(spark):
    a = spark.createDataFrame([(1, "In Guntur, and guntur again", "A Writer NEW DELHI"), (2, None, None), (3, "none", "STAFF")], "doc_id int, text string, byline string")
    assert sorted((r.doc_id, r.name, r.mentions) for r in reads.places(a, ("guntur", "eluru")).collect()) == [(1, "Guntur", 1), (1, "New Delhi", 1), (3, "Staff", 1)]


def test_feeds_in_all_forms(spark):
    item = "<item><title><![CDATA[A &amp; B]]></title><link>http://x/1</link><dc:date>2024-02-03T01:00:00Z</dc:date></item>"
    atom = '<feed><entry><title>C</title><link rel="alternate" href="http://x/2"/><published>2024-05-06T00:00:00Z</published><summary>s &lt;b&gt;</summary></entry><entry><title>no link</title><updated>2024-05-06</updated></entry></feed>'
    got = [(r.title, r.link, str(r.day)) for r in readers.feed_items(spark.createDataFrame([(1, f"<rss>{item}<item><title>no date</title><link>http://x/3</link></item></rss>"), (2, atom)], "feed int, xml string")).orderBy("feed").collect()]
    assert got == [("A & B", "http://x/1", "2024-02-03"), ("C", "http://x/2", "2024-05-06")]


def test_seeding_a_vocabulary_again(spark):
    """Aliases that the seed dropped go, those made by hand and those of other topics stay; one row a change; seeding twice changes nothing."""
    df = spark.createDataFrame
    seed = {"topics": df([("t", "Tax"), ("u", "Union")], "topic string, name string"), "aliases": df([("t", 1, "levy", False), ("t", 2, " LEVY ", True), ("u", 1, "", False), ("u", 2, "ఆంధ్ర", False)], "topic string, ord int, alias string, strict boolean"), "links": df([("t", "u"), ("t", "nowhere")], "a string, b string")}
    stored = {
        "topics": df([("t", "Taxes"), ("old", "Old")], "topic string, name string"), "links": df([], "a string, b string"),
        "aliases": df([("t", "tax", "Tax", "en", False, False), ("t", "duty", "duty", "en", False, False), ("t", "cess", "cess", "en", False, True), ("old", "old", "Old", "en", False, False)], "topic string, norm string, alias string, lang string, strict boolean, manual boolean"),
    }
    changes = vocabulary.reseeded(seed, stored)
    assert sorted((r.what, r.topic, r.key, r.change, r["name"], r.lang, r.strict) for r in changes.filter("key is not null").collect()) == [
        ("alias", "t", "duty", "delete", None, None, None), ("alias", "t", "levy", "insert", " LEVY ", "en", "true"), ("alias", "u", "union", "insert", "Union", "en", "false"), ("alias", "u", "ఆంధ్ర", "insert", "ఆంధ్ర", "te", "false"), ("link", "t", "u", "insert", None, None, None),
    ]
    assert {(r.topic, r.change, r["name"]) for r in changes.filter("what = 'topic'").collect()} == {("t", "update", "Tax"), ("u", "insert", "Union")}
    after = vocabulary.applied_aliases(stored["aliases"], changes)
    assert {(r.topic, r.norm) for r in after.collect()} == {("t", "tax"), ("t", "levy"), ("t", "cess"), ("old", "old"), ("u", "union"), ("u", "ఆంధ్ర")}
    assert vocabulary.reseeded(seed, {"topics": seed["topics"], "aliases": after, "links": seed["links"]}).count() == 0


def test_feed_files(spark, tmp_path):
    """Rows of RSS and Atom files by Spark's XML source; a broken row is told apart."""
    (tmp_path / "rss.xml").write_text("<rss><channel>" + "".join(f"<item><title><![CDATA[A &amp; {k}]]></title><link> http://x/{k} </link><pubDate>Mon, 0{k} Jan 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;s&lt;/b&gt; {k}</description></item>" for k in range(1, 4)) + "<item><title>broken</b></item><item><title>no date</title><link>http://x/9</link></item></channel></rss>")
    items, broken = readers.feed_files(spark, str(tmp_path / "rss.xml"))
    assert sorted((r.title, r.link, str(r.day), r.summary) for r in items.collect()) == [(f"A & {k}", f"http://x/{k}", f"2024-01-0{k}", f"s  {k}") for k in range(1, 4)]
    assert ["broken" in r.record for r in broken.collect()] == [True]
    (tmp_path / "atom.xml").write_text('<feed><entry><title>C</title><link rel="self" href="http://s"/><link rel="alternate" href="http://x/2"/><updated>2024-05-06T00:00:00Z</updated><summary>t</summary></entry></feed>')
    items, broken = readers.feed_files(spark, str(tmp_path / "atom.xml"), "entry")
    assert [(r.title, r.link, str(r.day)) for r in items.collect()] == [("C", "http://x/2", "2024-05-06")] and broken.count() == 0


def test_whole_objects_of_cut_replies():
    got = desk.whole_objects('```json\n[{"a": "x\ny", "b": {"c": "}"}}, {broken}, {"d": "\\"{"}, {"e": 1')
    assert got == ['{"a":"x\\ny","b":{"c":"}"}}', '{"d":"\\"{"}']
    assert desk.whole_objects('[{"a": 1}, "cut {') == ['{"a":1}'] and desk.whole_objects("none") == [] and desk.whole_objects('{"a": 1}') == []


def test_positions_over_many_ranges(spark):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = sorted((r.ord, r.a) for r in ranking.positions(df, ["a", "b"]).collect())
    assert got == [(k + 1, a) for k, a in enumerate(sorted(a for a, _ in rows))] and ranking.positions(df.limit(0), ["a"]).count() == 0
