"""Question checks and verdict handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions.lists import edged

#: Signs of each question format, from the most telling to the least.
FORMATS = (
    ("assertion_reason", r"(?i)\bassertion\b|\breason\s*\(\s*R\s*\)"),
    ("list_matching", r"(?i)\bmatch\s+list\s*-?\s*(?:I|1)\b|\bmatch\s+the\s+following\b|\busing\s+the\s+codes?\s+given\s+below\b|\blist\s*-?\s*I\b[\s\S]{0,80}\blist\s*-?\s*II\b"),
    ("chronological", r"(?i)\bchronological\s+order\b|\barrange\s+(?:the\s+)?following\b[\s\S]{0,60}\border\b|\bcorrect\s+(?:chronological\s+)?sequence\b|\bearliest\b[\s\S]{0,30}\blatest\b"),
    ("count_based", r"(?i)\bhow\s+many\s+of\s+the\s+(?:above|following)\b|\bhow\s+many\s+(?:statements?|pairs?)\b|\bnumber\s+of\s+(?:correct|incorrect)\s+statements?\b"),
    ("negative_statement", r"(?i)\bnot\b|\bincorrect\b|\bexcept\b|\b(?:is|are)\s+false\b|\bfalse\s+statement"),
    ("multi_statement", r"(?i)(?-i:\b(?:1|I)\s*[.):]\s*[\s\S]{5,240}?\b(?:2|II)\s*[.):])|\bboth\s+1\s+and\s+2\b|\b(?:1|2|3)\s+and\s+(?:2|3|4)\s+only\b|\bstatements?\s+(?:1|I)\s+and\s+(?:2|II)\b"),
    ("statement_based", r"(?i)\bwith\s+reference\s+to\b|\bwhich\s+of\s+the\s+following\s+statements?\b|\bconsider\s+the\s+following\b|\bwhich\s+of\s+the\s+above\s+statements?\b"),
)
#: Words that make a stem a matter of degree; openings that ask; options about other options.
HEDGES = r"(?i)\b(?:generally|usually|typically|normally|often|frequently|mostly|largely|arguably|probably|perhaps|somewhat|relatively|fairly|quite|rather)\b"
ASKS = r"(?i)\?|^\s*(?:which|what|who|whom|whose|when|where|why|how|consider|arrange|match|identify|choose|select|with reference to|in the context of|the correct|assertion)"
OTHERS = r"(?i)^\s*(?:all|none|any|both|neither)\s+(?:of\s+)?(?:the\s+)?(?:above|these|them|the\s+following)\b|^\s*both\s*\(?[a-d]\)?\s*(?:and|&)\s*\(?[a-d]\)?\s*$|^\s*(?:\(?[a-d]\)?\s*(?:and|&)\s*\(?[a-d]\)?)\s*$"
#: The four options of an assertion and its reason.
ASSERTION_OPTIONS = (
    r"(?i)both\s+a\s+and\s+r\s+are\s+true.*r\s+(?:correctly\s+)?explains",
    r"(?i)both\s+a\s+and\s+r\s+are\s+true.*r\s+(?:does\s+not|is\s+not)",
    r"(?i)a\s+is\s+true.*r\s+is\s+false",
    r"(?i)a\s+is\s+false.*r\s+is\s+true",
)
#: The formats of an item's questions where nothing is known of its keyword.
FORMAT_CYCLE = ("direct_recall", "multi_statement", "list_matching", "assertion_reason", "direct_recall", "negative_statement", "multi_statement", "statement_based", "list_matching", "count_based")
ROMANS = ("I", "II", "III", "IV", "V", "VI")
LETTERS = ("a", "b", "c", "d")


def question_format(stem: Column, options: Column) -> Column:
    """The first format whose signs are there; negation counts in the stem alone. Fewer than two options: descriptive; no signs: direct_recall."""
    full = F.concat_ws(" \n ", stem, options)
    out = F.lit("direct_recall")
    for name, pattern in reversed(FORMATS):
        out = F.when((stem if name == "negative_statement" else full).rlike(edged(pattern)), name).otherwise(out)
    return F.when(F.trim(full) == "", "unknown").when(F.size(options) < 2, "descriptive").otherwise(out)


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def inspected(questions: DataFrame) -> DataFrame:
    """``questions`` (question, option_a .. option_d, correct_option, format, explanation, fact_as_of) with fatal and soft findings, as arrays."""
    opts = [F.trim(F.coalesce(f"option_{x}", F.lit(""))) for x in LETTERS]
    norm = [plain(F.col(f"option_{x}")) for x in LETTERS]
    q, key = F.coalesce("question", F.lit("")), F.lower(F.coalesce("correct_option", F.lit("")))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    or_ = lambda cs: F.array_contains(F.array(*cs), True)
    every = lambda cs: ~F.array_contains(F.array(*cs), False)
    chosen = F.greatest(*[F.when(key == x, F.length(o)).otherwise(0) for x, o in zip(LETTERS, opts, strict=True)])
    longest = F.greatest(*[F.when(key == x, 0).otherwise(F.length(o)) for x, o in zip(LETTERS, opts, strict=True)])
    listed = lambda p: F.size(F.array_distinct(F.regexp_extract_all(q, F.lit(rf"(?:^|\s)({p})[.):]"), 1)))
    statements = F.greatest(listed("I{1,3}|IV|V|VI{0,3}"), listed("[1-6]"))
    said = F.concat_ws(" ", *opts)
    numbers = F.transform(F.regexp_extract_all(said, F.lit(edged(r"\b([1-6])\b")), 1), lambda x: x.cast("int"))
    romans = F.transform(F.regexp_extract_all(said, F.lit(edged(r"\b(I{1,3}|IV|V|VI{0,3})\b")), 1), lambda x: F.array_position(F.array(*[F.lit(r) for r in ROMANS]), x).cast("int"))
    top = F.coalesce(F.array_max(F.concat(numbers, romans)), F.lit(0))
    combined = F.col("format").isin("multi_statement", "count_based", "chronological", "list_matching")
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    fatal = F.array_compact(F.array(
        flag(~q.rlike(ASKS), "asks nothing"), flag(q.rlike(edged(HEDGES)), "hedged stem"), flag(or_([o.rlike(edged(OTHERS)) for o in opts]), "option about options"),
        flag(or_([(norm[i] != "") & (norm[i] == norm[j]) for i, j in pairs]), "equal options"), flag(~key.isin(*LETTERS), "no key"),
        flag((F.col("format") == "multi_statement") & (statements < 2), "no numbered statements"), flag((F.col("format") == "multi_statement") & (statements >= 2) & (top > statements), "option beyond the statements"),
        flag((F.col("format") == "assertion_reason") & ~every([or_([o.rlike(p) for o in opts]) for p in ASSERTION_OPTIONS]), "not the four fixed options"),
        flag((F.col("format") == "assertion_reason") & ~(q.rlike(r"(?im)assertion|^\s*a\s*[:.)]") & q.rlike(r"(?im)reason|^\s*r\s*[:.)]")), "no assertion and reason"), flag(F.trim(F.coalesce("explanation", F.lit(""))) == "", "no explanation"),
    ))
    soft = F.array_compact(F.array(
        flag(~combined & or_([(F.length(norm[i]) > 3) & norm[j].contains(F.concat(norm[i], F.lit(" "))) for i in range(4) for j in range(4) if i != j]), "contained option"),
        flag((chosen > 24) & (longest > 0) & (chosen > 1.8 * longest), "long key"), flag(F.col("fact_as_of").isNull(), "undated"),
    ))
    return questions.withColumn("fatal", fatal).withColumn("soft", soft)


def verdicts(said: DataFrame, known: DataFrame) -> DataFrame:
    """``said`` (batch, ord, id, class, score, reason) checked against ``known`` (id): unknown ids are refused, the first verdict of an id counts.

    Classes are folded; a score is cut to 0..100, a missing one stands for its class. Ids without a verdict come back as missing.
    """
    folded = F.lower(F.trim("class"))
    kind = F.when(folded.isin("high", "keep", "core"), "high").when(folded.isin("partial", "maybe", "medium"), "partial").when(folded.isin("drop", "reject", "low"), "drop")
    one = said.join(known, "id", "left_semi").withColumn("class", kind).filter("class is not null")
    one = one.withColumn("_p", F.row_number().over(W.Window.partitionBy("id").orderBy("batch", "ord"))).filter("_p = 1")
    default = F.when(F.col("class") == "high", 70).when(F.col("class") == "partial", 45).otherwise(10)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("score", default)))
    return known.join(one.select("id", "class", score.cast("long").alias("score"), "reason"), "id", "left").withColumn("missing", F.col("class").isNull())


def second_reading(questions: DataFrame, readings: DataFrame) -> DataFrame:
    """``readings`` (n, verdict, new_question) applied to ``questions`` (as for ``inspected``, with n): rejected ones go, rewritten ones are inspected again and go if anything fatal is left, unread ones stay."""
    j = questions.join(readings, "n", "left").withColumn("verdict", F.coalesce("verdict", F.lit("keep"))).filter("verdict <> 'reject'")
    j = j.withColumn("question", F.when(F.col("verdict") == "rewrite", F.coalesce("new_question", "question")).otherwise(F.col("question"))).drop("new_question")
    return inspected(j).filter((F.col("verdict") != "rewrite") | (F.size("fatal") == 0)).drop("fatal", "soft")


def question_count(units: Column) -> Column:
    """4 for one unit, 2 more for each other, 10 at most."""
    return F.least(F.lit(10), 4 + 2 * F.greatest(F.lit(0), units - 1)).cast("long")


def planned_formats(items: DataFrame, cycle: tuple[str, ...] = FORMAT_CYCLE) -> DataFrame:
    """A row a question of ``items`` (index, units): k from 1 and its format, the cycle going on from item to item."""
    n = question_count(F.col("units"))
    rows = items.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    at = F.pmod(F.col("index") * F.col("_n") + F.col("k") - 1, F.lit(len(cycle))).cast("int")
    return rows.withColumn("format", F.get(F.array(*[F.lit(c) for c in cycle]), at)).drop("_n")


def canonical_code(raw: Column, codes: list[str]) -> Column:
    """A known code: as it stands, without brackets, before a dash, or the only one inside the text; null otherwise. ``codes``: a bounded vocabulary."""
    known = F.array(*[F.lit(c) for c in codes])
    unbracketed = lambda c: F.trim(F.regexp_replace(c, r"\s*\[[^\]]*\]\s*$", ""))
    before = F.trim(F.regexp_extract(raw, r"^(.*?)\s+[—–-]\s", 1))
    inside = F.filter(known, lambda c: raw.contains(c))
    check = lambda x: F.when(F.array_contains(known, x), x)
    return F.coalesce(check(F.trim(raw)), check(unbracketed(raw)), check(before), check(unbracketed(before)), F.when(F.size(inside) == 1, F.get(inside, F.lit(0))))
