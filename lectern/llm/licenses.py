r"""License scans by ordered signature rules, in DataFrame functions only.

A rule is a regex over words (lower-cased, joined by single spaces) with a label, a priority and a confidence; rules are the names
below, alone and after a grant ("licensed under the terms of ..."), written by one law. Two prefilters stand before them: a text without any of
the key stems is not cut into words, and a rule is tried only where its first word stands and its key occurs within the SPAN words that follow.
Each match is an interval of words. One that lies within another of higher priority (or of the same and longer) is suppressed: "general public
license" within "lesser general public license v3" tells nothing of its own. Rules are short, so only matches that begin at most SPAN words before are looked at.

Texts stay where they are: no shuffle, no Python, and work that grows with the text, however many matches there are. Null texts are empty;
rows without id, repeated rows and other columns pass; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases, always reported, with their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Names: label, priority, regexes over words. A name must begin with a plain word and hold one of KEYS.
V2, V21, V3 = r"(?: version| v)? (?:v2|2)(?: 0)?", r"(?: version| v)? (?:v2|2) 1", r"(?: version| v)? (?:v3|3)(?: 0)?"
LATER = r"(?: or(?: at your option)?(?: any)? later(?: versions?)?)?"
NAMES = (
    ("mit", 20, ("mit licen[cs]e", "mit style licen[cs]e", "mit expat licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e", "the mit licen[cs]e mit")),
    ("mit-0", 30, ("mit no attribution licen[cs]e", "mit 0 licen[cs]e", "mit licen[cs]e no attribution")),
    ("apache", 15, ("apache licen[cs]e", "apache software licen[cs]e", "asf licen[cs]e")),
    ("apache-1.0", 30, (r"apache (?:software )?licen[cs]e(?: version| v)? 1 0", "apache licen[cs]e v1 0")),
    ("apache-1.1", 30, (r"apache (?:software )?licen[cs]e(?: version| v)? 1 1", "apache licen[cs]e v1 1")),
    ("apache-2.0", 30, (rf"apache (?:software )?licen[cs]e{V2}", "asl licen[cs]e 2 0", "apache 2 0 licen[cs]e", "apache 2 licen[cs]e")),
    ("gpl", 10, ("gnu general public licen[cs]e", "general public licen[cs]e", "gnu gpl", "gpl", "gpl licen[cs]e")),
    ("gpl-1.0", 25, (r"gnu general public licen[cs]e(?: version| v)? (?:v1|1)(?: 0)?", "gplv1", "gpl 1 0", "gpl v1")),
    ("gpl-2.0", 25, (rf"gnu general public licen[cs]e{V2}{LATER}", rf"general public licen[cs]e{V2}{LATER}", "gplv2", "gpl2", "gpl 2 0", "gpl v2", "gpl version 2", "gnu gpl v2", "gnu gplv2", "gnu gpl version 2")),
    ("gpl-3.0", 25, (rf"gnu general public licen[cs]e{V3}{LATER}", rf"general public licen[cs]e{V3}{LATER}", "gplv3", "gpl3", "gpl 3 0", "gpl v3", "gpl version 3", "gnu gpl v3", "gnu gplv3", "gnu gpl version 3")),
    ("lgpl", 35, ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "lesser general public licen[cs]e", "library general public licen[cs]e", "gnu lgpl", "lgpl")),
    ("lgpl-2.0", 40, (rf"gnu (?:lesser|library) general public licen[cs]e{V2}{LATER}", rf"library general public licen[cs]e{V2}{LATER}", "lgplv2", "lgpl 2 0", "lgpl v2")),
    ("lgpl-2.1", 45, (rf"gnu (?:lesser|library) general public licen[cs]e{V21}{LATER}", rf"lesser general public licen[cs]e{V21}{LATER}", "lgplv2 1", "lgpl 2 1", "lgpl v2 1", "gnu lgpl 2 1")),
    ("lgpl-3.0", 40, (rf"gnu lesser general public licen[cs]e{V3}{LATER}", rf"lesser general public licen[cs]e{V3}{LATER}", "lgplv3", "lgpl 3 0", "lgpl v3", "gnu lgpl 3", "gnu lgplv3")),
    ("agpl", 35, ("gnu affero general public licen[cs]e", "affero general public licen[cs]e", "gnu agpl", "agpl")),
    ("agpl-3.0", 40, (rf"gnu affero general public licen[cs]e{V3}{LATER}", rf"affero general public licen[cs]e{V3}{LATER}", "agplv3", "agpl 3 0", "agpl v3", "gnu agplv3")),
    ("gfdl", 30, ("gnu free documentation licen[cs]e", "free documentation licen[cs]e", r"gnu free documentation licen[cs]e(?: version| v)? 1 [1-3]", "gfdl licen[cs]e")),
    ("bsd", 15, ("bsd licen[cs]e", "bsd style licen[cs]e", "berkeley software distribution licen[cs]e")),
    ("bsd-2-clause", 30, ("bsd 2 clause", "bsd 2 clause licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e", "two clause bsd licen[cs]e", "2 clause bsd licen[cs]e")),
    ("bsd-3-clause", 30, ("bsd 3 clause", "bsd 3 clause licen[cs]e", "new bsd licen[cs]e", "modified bsd licen[cs]e", "revised bsd licen[cs]e", "three clause bsd licen[cs]e", "3 clause bsd licen[cs]e")),
    ("bsd-4-clause", 30, ("bsd 4 clause", "bsd 4 clause licen[cs]e", "original bsd licen[cs]e", "old bsd licen[cs]e", "four clause bsd licen[cs]e")),
    ("0bsd", 30, ("0bsd", "zero clause bsd licen[cs]e", "bsd zero clause licen[cs]e")),
    ("isc", 20, ("isc licen[cs]e", "internet systems consortium licen[cs]e")),
    ("mpl", 15, ("mozilla public licen[cs]e", "mpl licen[cs]e")),
    ("mpl-1.1", 30, (r"mozilla public licen[cs]e(?: version| v)? (?:v1|1) 1", "mpl licen[cs]e 1 1")),
    ("mpl-2.0", 30, (rf"mozilla public licen[cs]e{V2}", "mpl licen[cs]e 2 0", "mpl 2 0 licen[cs]e")),
    ("epl", 15, ("eclipse public licen[cs]e", "epl licen[cs]e")),
    ("epl-1.0", 30, (r"eclipse public licen[cs]e(?: version| v)? (?:v1|1)(?: 0)?",)),
    ("epl-2.0", 30, (rf"eclipse public licen[cs]e{V2}",)),
    ("cddl", 20, ("common development and distribution licen[cs]e", "cddl licen[cs]e", r"common development and distribution licen[cs]e(?: version| v)? 1 [01]")),
    ("cpl", 20, ("common public licen[cs]e", r"common public licen[cs]e(?: version| v)? 1 0")),
    ("eupl", 20, ("european union public licen[cs]e", "eupl licen[cs]e", r"european union public licen[cs]e(?: version| v)? 1 [12]")),
    ("artistic", 15, ("artistic licen[cs]e", "perl artistic licen[cs]e", "clarified artistic licen[cs]e")),
    ("artistic-2.0", 30, (rf"artistic licen[cs]e{V2}",)),
    ("boost", 20, ("boost software licen[cs]e", r"boost software licen[cs]e(?: version| v)? 1 0", "bsl licen[cs]e")),
    ("zlib", 20, ("zlib licen[cs]e", "zlib libpng licen[cs]e", "libpng licen[cs]e")),
    ("python", 20, ("python software foundation licen[cs]e", "psf licen[cs]e", "python licen[cs]e")),
    ("ruby", 20, ("ruby licen[cs]e",)),
    ("php", 20, ("php licen[cs]e", r"php licen[cs]e(?: version| v)? 3 01?")),
    ("postgresql", 20, ("postgresql licen[cs]e", "postgres licen[cs]e")),
    ("openssl", 20, ("openssl licen[cs]e", "original ssleay licen[cs]e")),
    ("ofl", 20, ("sil open font licen[cs]e", "open font licen[cs]e", r"sil open font licen[cs]e(?: version| v)? 1 1")),
    ("osl", 20, ("open software licen[cs]e", r"open software licen[cs]e(?: version| v)? 3 0")),
    ("afl", 20, ("academic free licen[cs]e", r"academic free licen[cs]e(?: version| v)? 3 0")),
    ("ms-pl", 20, ("microsoft public licen[cs]e", "ms pl licen[cs]e")),
    ("ms-rl", 20, ("microsoft reciprocal licen[cs]e", "ms rl licen[cs]e")),
    ("unlicense", 20, ("unlicen[cs]e", "the unlicen[cs]e")),
    ("wtfpl", 20, ("wtfpl", "do what the fuck you want to public licen[cs]e")),
    ("public-domain", 15, ("public domain", "dedicated to the public domain", "released into the public domain", "placed in the public domain")),
    ("cc0", 30, ("cc0", "cc zero", "creative commons zero", "cc0 1 0", "cc0 1 0 universal", "creative commons cc0 licen[cs]e")),
    ("cc", 10, ("creative commons licen[cs]e", "creative commons", "creative commons public licen[cs]e")),
    ("odbl", 20, ("open database licen[cs]e", "open data commons open database licen[cs]e", "odc odbl licen[cs]e")),
    ("odc-by", 20, ("open data commons attribution licen[cs]e", "odc by licen[cs]e")),
    ("ogl", 20, ("open government licen[cs]e", r"open government licen[cs]e(?: version| v)? (?:v)?[123](?: 0)?")),
    ("openrail", 20, ("openrail licen[cs]e", "open rail m licen[cs]e", "creativeml open rail m licen[cs]e", "bigscience rail licen[cs]e")),
    ("proprietary", 5, ("end user licen[cs]e agreement", "commercial licen[cs]e agreement", "proprietary licen[cs]e", "all rights reserved under licen[cs]e")),
)
#: Attributes of the Creative Commons family in their order; each combination has versions 1.0 to 4.0.
CC = (("by", 26, "by", "attribution"), ("by-sa", 27, "by sa", "attribution share ?alike"), ("by-nd", 27, "by nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", 27, "by nc", "attribution non ?commercial"), ("by-nc-sa", 28, "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", 28, "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
GRANT = r"(?: (?:only|solely))? under(?: the)?(?: terms (?:and conditions )?of(?: the)?| conditions of(?: the)?)? "
GRANTS = tuple(verb + GRANT for verb in ("licen[cs]ed", "released", "distributed", "available"))
#: Stems of which every rule holds one; they gate rules, and texts by GATE.
KEYS = ("licen", "gpl", "creative commons", "cc", "public domain", "bsd", "wtfpl")
GATE = r"(?i)licen|gpl|creative|(?<![a-z0-9])cc(?:0|[^a-z0-9]+(?:by|zero))|public[^a-z0-9]+domain|(?<![a-z0-9])0?bsd|wtfpl"
CONFIDENCE = {"name": 0.8, "word": 0.6, "grant": 0.95}
_OPEN = re.compile(r"^[a-z0-9]+(?:\[cs\][a-z]+)?")


def _firsts(regex: str) -> list[str]:
    """The plain words that a rule may begin with."""
    first = _OPEN.match(regex).group()
    return [first.replace("[cs]", x) for x in "cs"] if "[cs]" in first else [first]


def _key(regex: str) -> str:
    """The stem that each match of a name holds: one outside its optional parts."""
    return next(k for k in KEYS if k in re.sub(r"\(\?:(?:[^()]|\([^()]*\)\??)*\)\?", "", regex))


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """(first word, key, regex, label, priority, confidence, whether a base phrase), by falling priority: the order in which matches are listed."""
    named = [(label, priority, n) for label, priority, names in NAMES for n in names]
    for label, priority, short, full in CC:
        named += [(f"cc-{label}", priority, f"cc {short}"), (f"cc-{label}", priority, f"creative commons {full}")]
        for v in (1, 2, 3, 4):
            for name in (f"cc {short}", f"creative commons {full}"):
                named.append((f"cc-{label}-{v}.0", priority + 10, rf"{name}(?: licen[cs]e)?(?: version| v)? {v} 0(?: international| unported)?"))
    out = [(w, "licen", phrase, label, 10, 0.8, True) for label, phrase in BASE for w in _firsts(phrase)]
    for label, priority, name in named:
        key = _key(name)
        out += [(w, key, name, label, priority, CONFIDENCE["name" if " " in name else "word"], False) for w in _firsts(name)]
    # One rule a verb and family: its names as alternatives after the grant, the longest first.
    families = {}
    for label, priority, name in named:
        families.setdefault((label, priority, _key(name)), []).append(name)
    for (label, priority, key), names in families.items():
        some = "|".join(sorted(names, key=len, reverse=True))
        out += [(w, key, f"{grant}(?:{some})", label, priority + 1, CONFIDENCE["grant"], False) for grant in GRANTS for w in _firsts(grant)]
    return sorted(out, key=lambda r: (-r[4], r[3], r[2], r[0]))


RULES = rules()


def _longest(regex: str) -> int:
    """Words of the longest match: of alternatives the longest counts, and optional parts do."""
    open_groups = [[0]]
    for token in re.findall(r"\(\?:|\||\)|[^ ()|]+", regex.replace(")?", ")")):
        if token == "(?:":
            open_groups.append([0])
        elif token == "|":
            open_groups[-1].append(0)
        elif token == ")":
            inner = max(open_groups.pop())
            open_groups[-1][-1] += inner
        else:
            open_groups[-1][-1] += 1
    return max(open_groups[0])


SPAN = max(_longest(r[2]) for r in RULES)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and not where it is used."""
    return F.transform(F.array(value), body)[0]


def _table() -> Column:
    """The rules by first word, as one constant."""
    by_first: dict[str, list[dict]] = {}
    for first, *rule in RULES:
        by_first.setdefault(first, []).append(dict(zip(("key", "regex", "label", "priority", "confidence", "base"), rule, strict=True)))
    rule = "struct<key: string, regex: string, label: string, priority: int, confidence: double, base: boolean>"
    return F.from_json(F.lit(json.dumps([{"first": w, "rules": r} for w, r in by_first.items()])), f"array<struct<first: string, rules: array<{rule}>>>")


def _matches(words: Column) -> Column:
    """Per place that has any: place (from 0) and the rules that match there with the number of their words."""
    table = _table()
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(sorted({r[0] for r in RULES})), i)), lambda i: i.isNotNull())

    def at(i: Column) -> Column:
        def tried(text: Column) -> Column:
            gated = F.filter(F.filter(table, lambda t: t["first"] == words[i])[0]["rules"], lambda r: F.contains(text, r["key"]))
            size = lambda r: F.length(F.regexp_replace(F.regexp_substr(text, F.concat(F.lit("^(?:"), r["regex"], F.lit(") "))), "[^ ]+", ""))
            found = F.transform(gated, lambda r: F.struct(r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["base"].alias("base"), i.cast("long").alias("first"), (i + size(r) - 1).cast("long").alias("last")))
            return F.filter(found, lambda m: m["last"].isNotNull())

        return _bound(F.concat(F.array_join(F.slice(words, i + 1, F.lit(SPAN)), " "), F.lit(" ")), tried)

    return F.filter(F.transform(places, lambda i: F.struct(i.alias("place"), at(i).alias("found"))), lambda p: F.size(p["found"]) > 0)


def _unsuppressed(places: Column) -> Column:
    """The matches that lie in none of higher priority, nor in a longer one of the same."""

    def left(p: Column, k: Column) -> Column:
        before = F.slice(places, F.greatest(k - SPAN, F.lit(0)) + 1, F.least(k, F.lit(SPAN)) + 1)

        def survives(others: Column) -> Column:
            size = lambda m: m["last"] - m["first"]
            covers = lambda m, o: (o["first"] <= m["first"]) & (o["last"] >= m["last"]) & ((o["priority"] > m["priority"]) | ((o["priority"] == m["priority"]) & (size(o) > size(m))))
            return F.filter(p["found"], lambda m: ~F.exists(others, lambda o: covers(m, o)))

        return _bound(F.flatten(F.transform(before, lambda b: b["found"])), survives)

    return F.flatten(F.transform(places, left))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all (every match of a rule) and kept (those not suppressed) of each row of ``docs``: arrays of label, priority, confidence, base, first, last (words from 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = "array<struct<label: string, priority: int, confidence: double, base: boolean, first: bigint, last: bigint>>"
    of_words = lambda words: _bound(_matches(words), lambda places: F.struct(F.flatten(F.transform(places, lambda p: p["found"])).cast(kind).alias("all"), _unsuppressed(places).cast(kind).alias("kept")))
    found = F.when(text.rlike(GATE), _bound(F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)), of_words)).otherwise(F.from_json(F.lit('{"all": [], "kept": []}'), f"all {kind}, kept {kind}"))
    return docs.select("doc_id", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), found.alias("found")).select("doc_id", "n_words", "found.all", "found.kept")


def op13(spark, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("all", lambda m: m["base"])
    labels = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["first"])
    both = found.withColumn("base", base).withColumn("told", F.concat("base", "kept"))
    return both.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("told")).alias("labels"), F.coalesce(F.array_max(F.transform("told", lambda m: m["confidence"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The rules as a table; words that may begin one, with the words that follow, are matched rule by rule."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()
    values = ", ".join("(" + ", ".join(quoted(v) for v in (w, k, r, label, p, c, b)) + ")" for w, k, r, label, p, c, b in RULES)
    return rf"""
WITH r(first, key, regex, label, priority, confidence, base) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT d, unnest(w) AS first, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT x.d, first, i, array_to_string(w[i:i + {SPAN - 1}], ' ') || ' ' AS t FROM x JOIN d USING (d) WHERE first IN (SELECT first FROM r)),
m AS (SELECT d, i - 1 AS a, regexp_extract(t, '^(?:' || regex || ') ') AS hit, label, priority, confidence::DOUBLE AS confidence, base FROM t JOIN r USING (first) WHERE contains(t, key)),
f AS (SELECT *, a + len(string_split(hit, ' ')) - 2 AS z FROM m WHERE hit <> ''),
k AS (SELECT *, base OR NOT EXISTS (SELECT 1 FROM f g WHERE g.d = f.d AND g.a <= f.a AND g.z >= f.z AND (g.priority > f.priority OR (g.priority = f.priority AND g.z - g.a > f.z - f.a))) AS told FROM f),
s AS (SELECT d, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (told) AS labels, max(confidence) FILTER (told) AS score FROM k GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (d)
"""


OP13_SQL = _sql()
