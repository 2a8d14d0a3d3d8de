"""Markdown as columns, on texts made by hand and against loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lectern.functions import markdown as M


def _one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_small_forms(spark):
    assert _one(spark, M.tidy, " \n a  \r\n\n\n\nb\t\n ") == "a\n\nb" and _one(spark, M.tidy, None) == ""
    assert _one(spark, M.facts_list, "* a\n\n- b\n  + c\nd\n-e") == "- a\n- b\n- c\n- d\n- -e"
    assert _one(spark, lambda c: M.reheaded(c, 4), "# a\n## b\ntext # no\n#### c\n#no") == "#### a\n##### b\ntext # no\n###### c\n#no"
    assert _one(spark, lambda c: M.reheaded(c, 2), "### a\n#### b") == "## a\n### b" and _one(spark, lambda c: M.reheaded(c, 2), "no heading") == "no heading"
    assert _one(spark, M.hard_breaks, "a\nb\n\nc\nd") == "a  \nb\n\nc  \nd"


def test_lists_with_brackets_against_a_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,()[]") for _ in range(rng.randrange(30))) for _ in range(200)] + ["a (b, c [d, e]), f) , g", ""]

    def loop(line):
        out, depth, buf = [], 0, ""
        for ch in line:
            depth = depth + 1 if ch in "([" else max(0, depth - 1) if ch in ")]" else depth
            if ch == "," and depth == 0:
                out.append(buf)
                buf = ""
            else:
                buf += ch
        return [s.strip() for s in [*out, buf] if s.strip()]

    got = [r.r for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(M.split_angles(F.col("t")).alias("r")).collect()]
    assert got == [loop(t) for t in texts]


def test_blocks_against_a_loop(spark):
    rng = random.Random(2)
    pieces = ["| a | b |", "|---|:--|", "| c |", "| d | e | | f |", "text", "", "## head", "|  |  |", "  ", "tail |"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(300)] + [""]

    def fold(line):
        cells = [c.strip() for c in re.sub(r"\|\s*$", "", re.sub(r"^\s*\|", "", line)).split("|")]
        return [cells[0], cells[1] if len(cells) == 2 else " · ".join(c for c in cells[1:] if c)]

    def loop(text):
        lines, out, para, i = text.split("\n"), [], [], 0
        row = lambda x: bool(re.match(M.TABLE_ROW, x)) and not re.match(M.TABLE_RULE, x)

        def flush():
            if t := re.sub(r"\s+", " ", " ".join(para)).strip():
                out.append(("p", t, None, None))
            para.clear()

        while i < len(lines):
            if row(lines[i]) and i + 1 < len(lines) and re.match(M.TABLE_RULE, lines[i + 1]):
                flush()
                header, rows, i = fold(lines[i]), [], i + 2
                while i < len(lines) and row(lines[i]):
                    if any(fold(lines[i])):
                        rows.append(fold(lines[i]))
                    i += 1
                if rows:
                    out.append(("table", None, header, rows))
                continue
            if lines[i].strip():
                para.append(re.sub(r"^#+\s*", "", lines[i]).strip())
            else:
                flush()
            i += 1
        flush()
        return out

    got = [[tuple(b) for b in r.r] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(M.blocks(F.col("t")).alias("r")).collect()]
    assert got == [loop(t) for t in texts]


NOTE = """Lead that has no heading.
## What it is
A scheme.
It began
in 2019.

It goes on.
## Andhra Pradesh angle
- one
- two
## Unknown
lost
## Key Facts
| a | b | c |
|---|---|---|
| 1 | 2 | 3 |
After it.
## provisions

## what it is
Once more.
## Easily confused with
* only one"""


def test_sections_of_a_note(spark):
    got = [(s.title, s.type, s["items"], s.header, s.rows) for s in _one(spark, M.sections, NOTE)]
    assert got == [
        ("What it is", "p", ["A scheme. It began in 2019.", "It goes on.", "Once more."], None, None), ("Key facts", "table", ["After it."], ["a", "b · c"], [["1", "2 · 3"]]), ("Easily confused with", "p", ["* only one"], None, None), ("Andhra Pradesh", "list", ["one", "two"], None, None),
    ]
    assert _one(spark, M.sections, None) == [] and _one(spark, M.sections, "## Key facts") == []


def test_hooks_and_recaps(spark):
    facts = ["**Total outlay** (revised) — Rs 5 crore", "total outlay — RS 5 CRORE", "Number of the districts of — 26", "no pair", "Year — " + "9" * 41, "Launched — 2019", "A fourth — one"]
    row = spark.createDataFrame([(facts, ["It is so. And so."], "**Art. 21**"), ([], ["x"], "y"), (["Abc — d"], [], None)], "f array<string>, p array<string>, l string")
    got = row.select(M.hook(F.col("f")).alias("h"), M.recap(F.col("p"), F.col("f"), F.col("l")).alias("r")).collect()
    assert [r.h for r in got] == ["Total outlay = Rs 5 crore · Number of the districts = 26 · Launched = 2019", "", ""]
    assert [r.r for r in got] == [["It is so.", "Total outlay (revised) — Rs 5 crore; total outlay — RS 5 CRORE; Number of the districts of — 26", "Art. 21"], None, None]
