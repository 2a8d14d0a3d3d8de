"""Markdown as column expressions: tidying, lists of facts, headings moved, hard breaks, blocks, and lists with brackets in them.

What depends on the lines or characters before is a fold inside the row: it carries a state along the text, and nothing leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_ROW, TABLE_RULE = r"^\s*\|(.+)\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
_BLOCK = "struct<type: string, text: string, header: array<string>, rows: array<array<string>>>"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def tidy(c: Column) -> Column:
    """No blanks at line ends, at most one empty line between others, none around."""
    lines = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?m)[ \t\r\f\x0B]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def facts_list(c: Column) -> Column:
    """One bullet a line, whatever bullets the lines had."""
    lines = F.filter(F.transform(F.split(tidy(c), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"^[-*+]\s+", ""))), "\n")


def reheaded(c: Column, target: int) -> Column:
    """All headings moved by as many ranks as bring the highest to ``target``; ranks end at 1 and 6."""

    def moved(text: Column) -> Column:
        top = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s"), F.lit(1)), lambda h: F.length(h)))

        def line(x: Column) -> Column:
            rank = F.length(F.regexp_extract(x, r"^(#{1,6})(?:\s|$)", 1))
            return F.when(rank > 0, F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), rank + target - top)).cast("int")), F.substring(x, rank + 1, F.length(x)))).otherwise(x)

        return F.when(top.isNull() | (top == target), text).otherwise(F.array_join(F.transform(F.split(text, "\n"), line), "\n"))

    return _bound(tidy(c), moved)


def hard_breaks(c: Column) -> Column:
    """Two blanks after each line that another follows without an empty one between them."""
    full = lambda x: F.trim(x) != ""
    return _bound(F.split(tidy(c), "\n"), lambda ls: F.array_join(F.transform(ls, lambda x, i: F.when(full(x) & full(F.coalesce(F.get(ls, i + 1), F.lit(""))), F.concat(x, F.lit("  "))).otherwise(x)), "\n"))


def split_angles(c: Column) -> Column:
    """Parts between commas that stand in no bracket, round or square, however deep; a closing bracket too many counts for nothing."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "["), s["depth"] + 1).when(ch.isin(")", "]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        last = F.concat(F.slice(s["parts"], 1, F.size(s["parts"]) - 1), F.array(F.concat(F.element_at(s["parts"], -1), ch)))
        return F.struct(depth.alias("depth"), F.when((ch == ",") & (depth == 0), F.concat(s["parts"], F.array(F.lit("")))).otherwise(last).alias("parts"))

    # Runs without brackets and commas are taken at once.
    tokens = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)[(\[)\],]|[^(\[)\],]+"), F.lit(0))
    return F.filter(F.transform(F.aggregate(tokens, start, step, lambda s: s["parts"]), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _cells(line: Column) -> Column:
    """A table row in two columns: the first cell, and all others that are not empty."""
    return _bound(F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^\s*\|", ""), r"\|\s*$", ""), r"\|"), lambda x: F.trim(x)), lambda c: F.array(c[0], F.when(F.size(c) <= 2, F.coalesce(F.get(c, F.lit(1)), F.lit(""))).otherwise(F.array_join(F.filter(F.slice(c, F.lit(2), F.size(c)), lambda x: x != ""), " · "))))


def blocks(c: Column) -> Column:
    """Paragraphs and tables of a text, in order: type (p or table), text, header and rows (two cells each).

    A table is a row, a rule below it, and the rows that follow; a heading's marks go, and its line is part of a paragraph.
    """
    none = F.lit(None).cast("array<string>")
    start = F.struct(F.array().cast("array<string>").alias("para"), none.alias("header"), F.array().cast("array<array<string>>").alias("rows"), F.lit(0).alias("mode"), F.array().cast(f"array<{_BLOCK}>").alias("out"))
    block = lambda kind, text, header, rows: F.struct(F.lit(kind).alias("type"), text.alias("text"), header.alias("header"), rows.alias("rows"))

    def flushed(s: Column) -> Column:
        """What has been gathered, a paragraph and a table's rows, is put out."""
        text = F.trim(F.regexp_replace(F.array_join(s["para"], " "), r"\s+", " "))
        out = F.when(text != "", F.concat(s["out"], F.array(block("p", text, none, F.lit(None).cast("array<array<string>>"))))).otherwise(s["out"])
        return F.when(F.size(s["rows"]) > 0, F.concat(out, F.array(block("table", F.lit(None).cast("string"), s["header"], s["rows"])))).otherwise(out)

    def state(para: Column, header: Column, rows: Column, mode: int, out: Column) -> Column:
        return F.struct(para.alias("para"), header.alias("header"), rows.alias("rows"), F.lit(mode).alias("mode"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        """mode 0: text; 1: a table's header was read, its rule comes; 2: among a table's rows."""
        row = x["line"].rlike(TABLE_ROW) & ~x["line"].rlike(TABLE_RULE)
        empty, no_rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
        opens = row & x["rule_next"]
        line = F.trim(F.regexp_replace(x["line"], r"^#+\s*", ""))
        closed = F.when(s["mode"] == 2, flushed(s)).otherwise(s["out"])
        text = F.when(opens, state(empty, _cells(x["line"]), no_rows, 1, flushed(s))).when(F.trim(x["line"]) == "", state(empty, none, no_rows, 0, flushed(s))).otherwise(state(F.concat(F.when(s["mode"] == 2, empty).otherwise(s["para"]), F.array(line)), none, no_rows, 0, closed))
        more = _bound(_cells(x["line"]), lambda c: F.when(F.exists(c, lambda v: v != ""), F.concat(s["rows"], F.array(c))).otherwise(s["rows"]))
        return F.when(s["mode"] == 1, state(empty, s["header"], no_rows, 2, s["out"])).when((s["mode"] == 2) & row, state(empty, s["header"], more, 2, s["out"])).otherwise(text)

    lines = _bound(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n"), lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(ls, i + 1).rlike(TABLE_RULE), F.lit(False)).alias("rule_next"))))
    return F.aggregate(lines, start, step, flushed)


#: The sections of a note that are kept, in their order, and how their headings may be written.
SECTIONS = ("What it is", "Key facts", "The provisions that get asked", "Easily confused with", "Andhra Pradesh")
SECTION_NAMES = {
    "what it is": "What it is", "key facts": "Key facts", "the provisions that get asked": "The provisions that get asked", "provisions that get asked": "The provisions that get asked", "provisions": "The provisions that get asked",
    "easily confused with": "Easily confused with", "andhra pradesh": "Andhra Pradesh", "andhra pradesh angle": "Andhra Pradesh",
}
_SECTION = "struct<title: string, type: string, items: array<string>, header: array<string>, rows: array<array<string>>>"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(c: Column) -> Column:
    """The known sections of a note, in their order: title, type (p, list or table), items, header, rows.

    A section with a table is that table, and the paragraphs beside it are its items; one of several lines that are all bullets is a list; all others
    are paragraphs. Headings that say the same are one section: the first gives its type, later ones add items.
    """
    names = F.create_map(*[F.lit(x) for pair in SECTION_NAMES.items() for x in pair])

    def section(part: Column) -> Column:
        heading, body = _trimmed(F.substring_index(part, "\n", 1)), _trimmed(F.when(F.contains(part, F.lit("\n")), F.regexp_replace(part, r"^[^\n]*\n", "")).otherwise(""))
        lines = F.filter(F.transform(F.split(body, r"\n+"), _trimmed), lambda x: x != "")
        paragraphs = F.filter(F.transform(F.split(body, r"\n{2,}"), lambda x: _trimmed(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")
        bullets = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(r"^[-•*]\s"))

        def told(bs: Column) -> Column:
            table = F.get(F.filter(bs, lambda b: b["type"] == "table"), F.lit(0))
            texts = F.transform(F.filter(bs, lambda b: b["type"] == "p"), lambda b: b["text"])
            kind = F.when(table.isNotNull(), "table").when(bullets, "list").otherwise("p")
            items = F.when(table.isNotNull(), texts).when(bullets, F.transform(lines, lambda x: F.regexp_replace(x, r"^[-•*]\s*", ""))).otherwise(paragraphs)
            return F.struct(names[F.lower(heading)].alias("title"), kind.alias("type"), items.alias("items"), table["header"].alias("header"), table["rows"].alias("rows"))

        return F.when(body != "", _bound(blocks(body), told))

    def merged(parts: Column) -> Column:
        known = F.filter(parts, lambda s: s.isNotNull() & s["title"].isNotNull())

        def of(title: Column) -> Column:
            same = F.filter(known, lambda s: s["title"] == title)
            first = F.get(same, F.lit(0))
            return F.when(first.isNotNull(), F.struct(title.alias("title"), first["type"].alias("type"), F.flatten(F.transform(same, lambda s: s["items"])).alias("items"), first["header"].alias("header"), first["rows"].alias("rows")))

        return F.filter(F.transform(F.array(*[F.lit(t) for t in SECTIONS]), of), lambda s: s.isNotNull()).cast(f"array<{_SECTION}>")

    text = _trimmed(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    parts = F.filter(F.split(text, r"(?m)^##[ \t]+"), lambda p: _trimmed(p) != "")
    return _bound(F.transform(parts, section), merged)


def _bare(c: Column) -> Column:
    return _trimmed(F.replace(F.coalesce(c, F.lit("")), F.lit("**"), F.lit("")))


def _cut(c: Column, most: int = 40) -> Column:
    """The first words, and a mark where more followed."""
    return F.when(F.size(F.split(c, r"\s+")) <= most, c).otherwise(F.concat(F.array_join(F.slice(F.split(c, r"\s+"), 1, most), " "), F.lit("…")))


#: The longest value, pair, hook and shortest hook in characters; where no more pairs are taken.
VALUE, PAIR, LINE, HOOK, LEAST_HOOK, PAIRS = 40, 52, 92, 128, 12, 3
_TAIL = r"(?i)\s+(?:and|or|of|to|for|in|on|at|as|by|over|under|with|from|the|a|an)\s*$"


def hook(facts: Column) -> Column:
    """A line of short pairs out of ``facts`` ("name — value"), none twice: at most PAIRS, and none after the line is LINE long; empty if it is too short to tell anything."""

    def pair(f: Column) -> Column:
        shape = r"^(.{3,80}?)\s+—\s+(.+)$"
        key = _trimmed(F.regexp_replace(_bare(F.regexp_extract(f, shape, 1)), r"\s*\(.*?\)\s*", " "))
        value = _bare(F.regexp_extract(f, shape, 2))
        short = _trimmed(F.regexp_replace(F.array_join(F.slice(F.split(key, r"\s+"), 1, 4), " "), _TAIL, ""))
        piece = F.when(F.lower(short) == F.lower(value), value).otherwise(F.concat(short, F.lit(" = "), value))
        return F.when(f.rlike(shape) & (value != "") & (F.length(value) <= VALUE) & (short != "") & (F.length(piece) <= PAIR), piece)

    def step(taken: Column, piece: Column) -> Column:
        full = (F.length(F.array_join(taken, " · ")) > LINE) | (F.size(taken) >= PAIRS)
        return F.when(piece.isNull() | full | F.exists(taken, lambda t: F.lower(t) == F.lower(piece)), taken).otherwise(F.concat(taken, F.array(piece)))

    line = F.aggregate(F.transform(facts, pair), F.array().cast("array<string>"), step, lambda t: F.array_join(t, " · "))
    return _bound(line, lambda x: F.when(F.length(x) >= LEAST_HOOK, F.substring(x, 1, HOOK)).otherwise(""))


def recap(paragraphs: Column, facts: Column, link: Column) -> Column:
    """Three short lines: the first sentence, the first three facts, what it is linked with; null unless there are all three."""
    first = F.regexp_extract(_bare(F.get(paragraphs, F.lit(0))), r"(?s)^(.*?\.)(?=\s)", 1)
    sentence = F.when(first != "", first).otherwise(_bare(F.get(paragraphs, F.lit(0))))
    lines = F.array(_cut(sentence), _cut(F.array_join(F.transform(F.slice(facts, 1, 3), _bare), "; ")), _cut(_bare(link)))
    return F.when(~F.exists(lines, lambda x: x == ""), lines)
