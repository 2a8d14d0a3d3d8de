"""Text functions as column expressions: normalising, tokens, patterns, HTML and headline forms.

Patterns use ASCII word edges: next to an accented letter, a word ends. All functions give null or empty results on null or empty text, never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.lists import SIGNATURE_STOP

#: Words that tokens leave out.
STOP = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "has", "have", "will")
EDGE_LEFT, EDGE_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
BLANKS = r"[ \t\n\r\f\x0B]+"


def norm(c: Column) -> Column:
    """Lower case, straight quotes and hyphens, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "‘’“”–—", "''\"\"--"), BLANKS, " "))


def tokens(c: Column, stop: tuple = STOP) -> Column:
    """Distinct words of more than two Latin or Telugu letters or digits, in order of appearance."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9à-ɏఀ-౿]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*stop)))


def raw_tokens(c: Column) -> Column:
    """What ``tokens`` chooses from; with ``is_token`` on exploded rows it gives the same without a lambda."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9à-ɏఀ-౿]+", " "), " "))


def is_token(t: Column, stop: tuple = STOP) -> Column:
    return (F.length(t) > 2) & ~t.isin(*stop)


def invariants(c: Column, out: tuple = ("THE", "AND", "FOR", "WITH", "THAT", "THIS", "FROM", "WILL", "SAID")) -> Column:
    """What survives translation: numbers with their magnitude, numbers of two digits or more, acronyms, and capitalised words in lower case."""
    money = F.regexp_extract_all(c, F.lit(r"(?i)([0-9,.]+[ \t\n]*(?:crore|lakh|billion|million|percent|per cent|%))"), 1)
    numbers = F.regexp_extract_all(c, F.lit(f"{EDGE_LEFT}([0-9]{{2,}}){EDGE_RIGHT}"), 1)
    acronyms = F.filter(F.regexp_extract_all(c, F.lit(f"{EDGE_LEFT}([A-Z]{{2,6}}){EDGE_RIGHT}"), 1), lambda x: ~x.isin(*out))
    names = F.transform(F.regexp_extract_all(c, F.lit(f"{EDGE_LEFT}([A-Z][a-z]{{3,}}){EDGE_RIGHT}"), 1), lambda x: F.lower(x))
    return F.array_distinct(F.concat(F.transform(money, lambda x: F.regexp_replace(F.lower(x), r"[,. \t\n]", "")), numbers, acronyms, names))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty. Each set is made once, as the one element that is transformed."""
    share = lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])))
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), share), F.lit(0))


def headline(text: Column) -> Column:
    """The first line."""
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def upper_each(c: Column) -> Column:
    """Upper case letter by letter: one that would become several, as ß does, stays as it is."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(x)), "")


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def js_round(c: Column) -> Column:
    """Halves go up."""
    return F.floor(c + 0.5)


def clamp(c: Column, least: float, most: float, fallback: float) -> Column:
    """Null, NaN and non-positive numbers become the fallback."""
    bad = c.isNull() | F.isnan(c.cast("double")) | (c <= 0)
    return F.when(bad, F.lit(fallback)).otherwise(F.least(F.greatest(c, F.lit(least)), F.lit(most)))


def local_day(ts: Column, minutes: int = 330) -> Column:
    """The calendar day at a fixed offset from UTC."""
    return F.to_date(ts + F.make_dt_interval(mins=F.lit(minutes)))


def like_literal(term: str, escape: str = "~") -> str:
    """``term`` as a LIKE pattern for "contains", its wildcards escaped."""
    return "%" + re.sub(rf"([%_{re.escape(escape)}])", rf"{escape}\1", term) + "%"


def alias_body(alias: str, strict: bool = False) -> str:
    """The pattern of an alias without its word edges. Plural forms count unless it is strict, short, foreign or all capitals."""
    body = re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", alias if strict else alias.lower())
    if strict and len(alias) >= 4 and not alias.endswith("s") and alias.isascii():
        return body + "s?"
    if strict or len(alias) < 4 or not alias.isascii() or alias == alias.upper():
        return body
    if re.search("[^aeiou]y$", body):
        return body[:-1] + "(?:y|ies)"
    return body + "(?:e?s)?"


def alias_pattern(alias: str, strict: bool = False) -> str:
    return alias_body(alias, strict) if not alias.isascii() else EDGE_LEFT + alias_body(alias, strict) + EDGE_RIGHT


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found in ``c``."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def first_rule(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first rule (label, pattern) that is found; null if none is."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or comments; blocks become lines, cells are dotted; lines of more than two words or with a digit stay."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/article)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]>", " · ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    lines = F.transform(F.split(entities(t), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (F.size(F.split(x, " ")) > 2) | x.rlike("[0-9]")), "\n")


def entities(c: Column) -> Column:
    """The common character references decoded; the ampersand last, so that nothing is decoded twice."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1))


def page_headline(html: Column, generic: tuple[str, ...] = ("home", "index", "press release")) -> Column:
    """The title unless it is generic or empty; else the first line of 26 to 219 characters."""
    title = page_title(html)
    line = F.get(F.filter(F.split(html_text(html), "\n"), lambda x: F.length(x).between(26, 219)), F.lit(0))
    return F.when((title != "") & ~F.lower(title).isin(*generic), title).otherwise(F.coalesce(line, F.lit("")))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://([^/:?#]+)", 1))


def question_hash(c: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of the words alone."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return F.substring(F.sha2(plain.cast("binary"), 256), 1, 32)


def headline_signature(c: Column) -> Column:
    """Words of more than two letters that are not common ones: those with a digit in order, then the first six others in order. Empty if there are none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9₹%]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin(*SIGNATURE_STOP))
    numbers, others = F.filter(words, lambda w: w.rlike("[0-9]")), F.filter(words, lambda w: ~w.rlike("[0-9]"))
    return F.array_join(F.concat(F.array_sort(numbers), F.array_sort(F.slice(others, 1, 6))), "|")


def stem(c: Column) -> Column:
    """A crude stem: a final s, es, ed or ing goes."""
    return F.regexp_replace(F.lower(c), "(?:ings?|ed|es|s)$", "")


def repaired_ligatures(c: Column, marker: str, follow: dict[str, tuple[str, ...]]) -> Column:
    """``marker`` before one of follow[ligature] becomes that ligature ("fl", "ffi", ...); elsewhere "fi". Capital words get capitals."""
    for ligature, after in follow.items():
        c = F.regexp_replace(c, f"(?<=[A-Z]){marker}(?=(?i:{'|'.join(after)}))", ligature.upper())
        c = F.regexp_replace(c, f"{marker}(?=(?i:{'|'.join(after)}))", ligature)
    return F.regexp_replace(F.regexp_replace(c, f"(?<=[A-Z]){marker}", "FI"), marker, "fi")


def dehyphenated(c: Column) -> Column:
    """Words broken at line ends are joined, blanks become single ones."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z])-[ \t]*\n[ \t]*([a-z])", "$1$2")
    return F.trim(F.regexp_replace(joined, BLANKS, " "))


def dateline(c: Column) -> Column:
    """A place in capitals at the end of a byline, of 4 to 40 characters; empty if there is none."""
    place = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"(?:^|[^A-Za-z0-9_])([A-Z]{3,}(?:[ -][A-Z]{2,})*)\s*$", 1)
    return F.when(F.length(place).between(4, 40), place).otherwise("")


def without_dateline(c: Column) -> Column:
    """The byline without its place and the comma or dash before it; one that is nothing but a place stays."""
    text = F.trim(F.coalesce(c, F.lit("")))
    place = dateline(c)
    bare = F.regexp_replace(F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(place))), r"[,;–—-]\s*$", "")
    return F.when((place == "") | (bare == ""), text).otherwise(bare)
