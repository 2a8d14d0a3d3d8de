"""Queries over articles, pages, questions and conversations.

The test texts are invented prose, so vocabularies and rules here are its own frequent words; the operators take any.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import markdown as MD
from lectern.functions import text as X
from lectern.functions.lists import SIGNATURE_STOP
from lectern.operators import aliases as A
from lectern.operators import dedup as D
from lectern.operators import matching as M
from lectern.operators import quality as Q
from lectern.operators import relational as R
from lectern.sources import readers, rebuild, sinks
from lectern.sources.shared import kept, shared_dir
from lectern.plans.roles import articles, attempts, day_text, days, item_units, items, mcqs, query, table

VOCABULARY = [("joiners", "the"), ("joiners", "of the"), ("joiners", "und"), ("endings", "tion"), ("endings", "ing"), ("places", "de la"), ("places", "les"), ("verbs", "edou"), ("verbs", "reed"), ("spanish", "que"), ("german", "der"), ("rarities", "query"), ("rarities", "thing")]
WEAK, ALONE = ["the", "les", "que"], ["of the", "und"]
TERMS = ["tion", "ring", "ouer", "then", "lung", "ment", "ción", "heit", "anst", "wher", "eaux", "dora"]
FOREIGN, HOME = "(?:de|la|les|une|un)", "(?:the|of|and|to)"

_NORM = "trim(regexp_replace(translate(lower(coalesce({0}, '')), '‘’“”–—', '''''\"\"--'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9à-ɏఀ-౿]+', ' ', 'g'), ' '), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{s}'" for s in X.STOP) + ")))"
#: Strict aliases, as they are printed, and words that make a name of the alias beside them.
STRICT = [("acronyms", "SECRET"), ("acronyms", "The"), ("acronyms", "MIT")]
NOUNS = ("that", "was", "tion", "les", "de")
_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}', {}, '{}', '{}', {})".format(t, a, k, "\\b" + X.alias_body(a, s) + "\\b", "\\b" + (a if s else a.lower()) + "\\b", s) for k, (t, a, s) in enumerate([*[(t, a, False) for t, a in VOCABULARY], *[(t, a, True) for t, a in STRICT]])) + ") v(topic, alias, ord, pattern, plain_pattern, strict))"
_LINKED = "CASE WHEN {0} IN ('of', 'for', 'and', 'the') THEN {1} ELSE {0} END IN (" + ", ".join(f"'{n}'" for n in NOUNS) + ")"
_AFTER, _BEFORE = "'^[ \\t\\n\\r\\f\\v]*([A-Za-z][A-Za-z.''-]*)'", "'([A-Za-z][A-Za-z.''-]*)[ \\t\\n\\r\\f\\v]*$'"
# Every occurrence between chr(1) and chr(2); its neighbours are read off the 60 characters on either side.
_SPANS = f"""
{{hits}} AS (SELECT doc_id, topic, alias, ord, len(regexp_extract_all(t, pattern))::BIGINT AS hits, len(regexp_extract_all(t, plain_pattern))::BIGINT AS plain, regexp_matches(h, pattern) AS in_headline, regexp_matches(h, plain_pattern) AS plain_headline FROM {{found}}),
{{spans}} AS (SELECT doc_id, ord, w, parts, unnest(generate_series(2, len(parts))) AS k FROM (SELECT doc_id, ord, w, string_split(regexp_replace(x, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM (SELECT doc_id, ord, pattern, 'body' AS w, t AS x FROM {{found}} UNION ALL SELECT doc_id, ord, pattern, 'head', h FROM {{found}}))),
{{sides}} AS (SELECT doc_id, ord, w, right(replace(array_to_string(parts[greatest(k - 30, 1):k - 1], ''), chr(2), ''), 60) AS l, left(string_split(parts[k], chr(2))[2] || replace(array_to_string(parts[k + 1:k + 30], ''), chr(2), ''), 60) AS r FROM {{spans}}),
{{names}} AS (SELECT doc_id, ord, w, starts_with(r, '+') OR {_LINKED.format("lower(regexp_extract(left(r, 40), " + _AFTER + ", 1))", "lower(regexp_extract(substr(r, length(regexp_extract(left(r, 40), " + _AFTER + ")) + 1), " + _AFTER + ", 1))")}
  OR {_LINKED.format("lower(regexp_extract(right(l, 40), " + _BEFORE + ", 1))", "lower(regexp_extract(left(l, length(l) - length(regexp_extract(right(l, 40), " + _BEFORE + "))), " + _BEFORE + ", 1))")} AS name FROM {{sides}}),
{{clean}} AS (SELECT doc_id, topic, alias, {{hits}}.ord, count(*) FILTER (w = 'body' AND NOT name)::BIGINT AS hits, coalesce(bool_or(NOT name) FILTER (w = 'head'), false) AS in_headline FROM {{hits}} JOIN {{names}} USING (doc_id, ord) GROUP BY ALL HAVING count(*) FILTER (w = 'body' AND NOT name) > 0)"""
_MORE = lambda **names: _SPANS.format(**({k: k for k in ("hits", "spans", "sides", "names", "clean", "found")} | names))
_HITS = f"""{{articles}}, {_ALIASES},
d AS (SELECT doc_id, {_NORM.format("text")} AS body, {_NORM.format("headline")} AS head FROM articles),
found AS (SELECT doc_id, topic, alias, ord, pattern, plain_pattern, body AS t, head AS h FROM d CROSS JOIN aliases WHERE NOT strict AND regexp_matches(body, pattern)),{_MORE()},
plain AS (SELECT doc_id, topic, alias, ord, plain AS hits, plain_headline AS in_headline FROM hits WHERE plain > 0)"""


def _words(c: str) -> str:
    return f"'\\b{c}\\b'"


_NORM_BODY = lambda: X.norm(F.coalesce("text", F.lit("")))


def _hits(spark, sf):
    return A.alias_hits(articles(spark, sf), VOCABULARY, NOUNS)


@query("doc_normalise", f"WITH {{articles}} SELECT doc_id, length({_NORM.format('text')})::BIGINT AS chars, sha256({_NORM.format('text')}) AS digest FROM articles")
def doc_normalise(spark, sf):
    return articles(spark, sf).select("doc_id", _NORM_BODY().alias("n")).select("doc_id", F.length("n").cast("long").alias("chars"), F.sha2(F.col("n").cast("binary"), 256).alias("digest"))


@query("doc_tokens_topk", f"""
WITH {{articles}}, t AS (SELECT edition, unnest({_TOKENS.format("text")}) AS token FROM articles), c AS (SELECT edition, token, count(*) AS docs FROM t GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY docs DESC, token) AS place FROM c)
SELECT edition, token, docs::BIGINT AS docs, place::INT AS place FROM p WHERE place <= 10""")
def doc_tokens_topk(spark, sf):
    """The ten tokens of most articles in each edition."""
    t = articles(spark, sf).select("edition", F.explode(X.raw_tokens(F.col("text"))).alias("token")).filter(X.is_token(F.col("token")))
    return R.first_k(t.groupBy("edition", "token").agg(F.count("*").alias("docs")), ["edition"], [F.col("docs").desc(), F.col("token")], 10)


@query("alias_topic_match", f"""
WITH {_HITS}
SELECT doc_id, topic, sum(hits)::BIGINT AS hits, bool_or(in_headline) AS in_headline, first(alias ORDER BY NOT in_headline, ord) AS matched FROM plain GROUP BY doc_id, topic HAVING bool_or(in_headline) OR sum(hits) >= 2""")
def alias_topic_match(spark, sf):
    """Topics of each article, by aliases as they are."""
    return M.kept_topics(M.topic_match(A.plain_hits(_hits(spark, sf))))


@query("strict_aliases", f"""
WITH {{articles}}, {_ALIASES}, found AS (SELECT doc_id, topic, alias, ord, pattern, plain_pattern, coalesce(text, '') AS t, headline AS h FROM articles CROSS JOIN aliases WHERE strict AND regexp_matches(coalesce(text, ''), pattern)),{_MORE()}
SELECT doc_id, hits.alias, hits.hits, hits.in_headline, coalesce(clean.hits, 0) AS clean FROM hits LEFT JOIN clean USING (doc_id, ord)""")
def strict_aliases(spark, sf):
    """Short and printed forms, by the letters as they stand."""
    hits = A.alias_hits(articles(spark, sf), [(t, a, True) for t, a in STRICT], NOUNS)
    return hits.select("doc_id", "alias", "hits", "in_headline", "clean")


_TOPIC_UNITS = f"""{_HITS}, ti AS (SELECT edition, doc_id, topic, sum(hits)::BIGINT AS hits FROM plain JOIN articles USING (doc_id) GROUP BY ALL HAVING bool_or(in_headline) OR sum(hits) >= 2),
un AS (SELECT doc_id, topic AS unit FROM hits GROUP BY doc_id, topic HAVING count(DISTINCT alias) >= 2)"""


@query("derived_rebuild", f"""
WITH {_TOPIC_UNITS} SELECT topic, unit, count(DISTINCT doc_id)::BIGINT AS weight, 'derived' AS source FROM ti JOIN un USING (doc_id) WHERE NOT (topic = 'joiners' AND unit = 'endings') GROUP BY topic, unit
UNION ALL SELECT 'joiners', 'endings', 1, 'manual'""")
def derived_rebuild(spark, sf):
    """Topics of articles and, from them, units of topics, staged and published together; a pair made by hand stays and is not derived."""
    store = f"{shared_dir(spark)}/lectern/store-{uuid.uuid4().hex}"
    hits = kept(_hits(spark, sf))
    found = articles(spark, sf).select("doc_id", "edition").join(M.kept_topics(M.topic_match(A.plain_hits(hits))), "doc_id").select("edition", "doc_id", "topic", "hits")
    has = hits.groupBy("doc_id", F.col("topic").alias("unit")).agg(F.countDistinct("alias").alias("n")).filter("n >= 2").drop("n")
    rebuild.rebuild(store, {"topic_items": found, "item_units": articles(spark, sf).select("doc_id", "edition").join(has, "doc_id")}, "edition")
    by_hand = spark.createDataFrame([("joiners", "endings", 1, "manual")], "topic string, unit string, weight long, source string")
    derived = rebuild.read(spark, store, "topic_items").join(rebuild.read(spark, store, "item_units").drop("edition"), "doc_id").groupBy("topic", "unit").agg(F.countDistinct("doc_id").alias("weight")).withColumn("source", F.lit("derived"))
    rebuild.rebuild(store, {"topic_units": derived.join(by_hand, ["topic", "unit"], "left_anti").unionByName(by_hand)})
    return rebuild.read(spark, store, "topic_units")


@query("topic_unmatched", f"WITH {_HITS} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM plain)")
def topic_unmatched(spark, sf):
    return articles(spark, sf).select("doc_id").join(A.plain_hits(_hits(spark, sf)).select("doc_id").distinct(), "doc_id", "left_anti")


_EVIDENCE = f"""
f AS (SELECT *, alias IN ({", ".join(f"'{w}'" for w in WEAK)}) AS weak, alias IN ({", ".join(f"'{w}'" for w in ALONE)}) AS alone, NOT contains(alias, ' ') AS single FROM clean),
e AS (SELECT doc_id, topic AS unit, count(DISTINCT alias) AS terms, count(*) FILTER (NOT weak) AS strong, bool_or(alone) AS alone, bool_or(in_headline AND NOT weak AND (NOT single OR hits > 1)) AS hs, bool_or(in_headline AND weak) AS hw FROM f GROUP BY ALL),
w AS (SELECT *, CASE WHEN alone THEN 'standalone' WHEN hs THEN 'headline' WHEN hw AND strong > 0 THEN 'weak headline' WHEN terms >= 2 AND strong > 0 THEN 'two terms' END AS why FROM e)"""


@query("unit_evidence_filter", f"WITH {_HITS}, {_EVIDENCE} SELECT doc_id, unit, terms::BIGINT AS terms, why, hs OR (hw AND strong > 0) AS in_headline FROM w WHERE why IS NOT NULL")
def unit_evidence_filter(spark, sf):
    """Units with evidence outside of proper names."""
    return M.unit_evidence(A.clean_hits(_hits(spark, sf)), WEAK, ALONE)


@query("unit_backfill", f"""
WITH {_HITS}, n AS (SELECT doc_id, topic, count(DISTINCT alias) AS n, count(DISTINCT alias) FILTER (alias NOT IN ({", ".join(f"'{w}'" for w in WEAK)})) AS strong FROM hits GROUP BY ALL),
p AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w = n AND lead(strong) OVER w = strong AS tie FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, strong DESC, topic))
SELECT doc_id, CASE WHEN tie THEN NULL ELSE topic END AS unit, CASE WHEN tie THEN 'tie' ELSE 'found' END AS verdict FROM p WHERE k = 1""")
def unit_backfill(spark, sf):
    return M.unit_backfill(_hits(spark, sf), WEAK)


_LOW = "lower(headline || chr(10) || substr(coalesce(text, ''), 1, 1400))"


@query("keyword_first_k", f"""
WITH {{articles}} SELECT doc_id, array_to_string(list_slice(list_filter([{", ".join(f"'{t}'" for t in TERMS)}], lambda t: contains({_LOW}, t)), 1, 8), ',') AS keywords FROM articles""")
def keyword_first_k(spark, sf):
    """The first eight vocabulary terms that stand in the headline or the first 1,400 characters."""
    return M.first_keywords(articles(spark, sf), TERMS).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query("vocabulary_expand", """
WITH v AS (SELECT p_partkey AS ord, trim(unnest(string_split(replace(p_type || '/' || p_brand || '|' || p_name, '|', '/'), '/'))) AS term FROM part)
SELECT lower(term) AS term, min(ord) AS ord FROM v WHERE length(term) >= 4 GROUP BY ALL""")
def vocabulary_expand(spark, sf):
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat("p_type", F.lit("/"), "p_brand", F.lit("|"), "p_name").alias("keyword"))
    return M.expanded(v)


@query("foreign_heavy_guard", f"""
WITH {{articles}}, d AS (SELECT doc_id, lang, {_NORM.format("text")} AS body, {_NORM.format("headline")} AS head FROM articles)
SELECT doc_id, lang, regexp_matches(head, {_words(FOREIGN)}) AND len(regexp_extract_all(body, {_words(FOREIGN)})) > 1.5 * len(regexp_extract_all(body, {_words(HOME)})) AS foreign_heavy FROM d""")
def foreign_heavy_guard(spark, sf):
    edge = lambda p: X.EDGE_LEFT + p + X.EDGE_RIGHT
    return articles(spark, sf).select("doc_id", "lang", M.foreign_heavy(X.norm(F.col("headline")), _NORM_BODY(), edge(FOREIGN), edge(HOME)).alias("foreign_heavy"))


@query("foreign_unit_guard", f"""
WITH {_HITS}, {_EVIDENCE}, g AS (SELECT doc_id, regexp_matches(head, {_words(FOREIGN)}) AND len(regexp_extract_all(body, {_words(FOREIGN)})) > 1.5 * len(regexp_extract_all(body, {_words(HOME)})) AS heavy FROM d)
SELECT doc_id, unit, why FROM w JOIN g USING (doc_id) WHERE why IS NOT NULL AND (NOT heavy OR unit = 'places')""")
def foreign_unit_guard(spark, sf):
    """Units of articles; those about another country keep the one unit that is about such."""
    u = M.unit_evidence(A.clean_hits(_hits(spark, sf)), WEAK, ALONE).select("doc_id", "unit", "why")
    return M.guarded_units(u, foreign_heavy_guard(spark, sf).select("doc_id", "foreign_heavy"), ["places"])


_BUCKET = "CASE WHEN lang = 'en' AND contains(text, 'ouer') THEN 'local' WHEN regexp_matches(text, 'ción|heit') AND len(regexp_extract_all(text, 'ción|heit')) > len(regexp_extract_all(text, 'ment|anst')) THEN 'international' WHEN regexp_matches(text, 'lung|eaux') AND NOT regexp_matches(text, 'ment|anst') THEN 'dynamic' ELSE 'national' END"


@query("bucket_classifier", f"WITH {{articles}} SELECT doc_id, {_BUCKET} AS bucket FROM articles")
def bucket_classifier(spark, sf):
    local = (F.col("lang") == "en") & F.col("text").contains("ouer")
    return articles(spark, sf).select("doc_id", M.bucket_of(F.col("text"), local, "ción|heit", "ment|anst", "lung|eaux").alias("bucket"))


RULES = (("licence", r"(?i)licen[cs]e|copyright"), ("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+"), ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("shouting", "!!"), ("figure", r"[0-9]{4}"))


@query("veto_label", f"""
SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(substr(coalesce(text, ''), 1, 900), '{p}') THEN '{n}'" for n, p in RULES)} END AS label, regexp_matches(split_part(coalesce(text, ''), chr(10), 1), '!!|[0-9]{{3}}') AS noise FROM documents""")
def veto_label(spark, sf):
    """The first veto rule that the first 900 characters meet; whether the headline is noise."""
    return articles(spark, sf).select("doc_id", X.first_rule(F.substring(F.coalesce("text", F.lit("")), 1, 900), RULES).alias("label"), X.any_of(F.col("headline"), ("!!", "[0-9]{3}")).alias("noise"))


INSTRUMENTS = ((3, "menta"), (3, "tionth"), (2, "ouer"), (2, "anst"), (1, "[0-9]+"))


TOPIC_PAPERS = {"joiners": 6, "endings": 4, "places": 3, "verbs": 2, "spanish": 5, "german": 1, "rarities": 2}
ASKED = ("tion", "ment", "then")


@query("relevance_score", f"""
WITH {_HITS}, {_EVIDENCE},
t AS (SELECT doc_id, topic, bool_or(in_headline) AS h FROM plain GROUP BY doc_id, topic HAVING bool_or(in_headline) OR sum(hits) >= 2),
m AS (SELECT doc_id, count(*) FILTER (h) AS head_topics, count(*) AS topics, bool_or(topic = 'rarities') AS tier1, bool_or(topic = 'places') AS local_topic, max(CASE topic {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TOPIC_PAPERS.items())} END) AS papers FROM t GROUP BY doc_id),
un AS (SELECT doc_id, bool_or(hs OR (hw AND strong > 0)) AS head_unit FROM w WHERE why IS NOT NULL GROUP BY doc_id),
fx AS (SELECT a.doc_id, regexp_matches(a.text, 'SECRET|!!') AS veto, coalesce(head_topics, 0) AS head_topics, coalesce(topics, 0) AS topics, coalesce((contains(text, 'ment'))::INT + (contains(text, 'lung'))::INT + (contains(text, 'ción'))::INT, 0) AS subjects, coalesce(tier1, false) AS tier1, coalesce(papers, 0) AS papers,
  coalesce(head_unit, false) AS head_unit, head_unit IS NOT NULL AS any_unit, list_slice(list_filter([{", ".join(f"'{t}'" for t in TERMS)}], lambda t: contains({_LOW}, t)), 1, 8) AS kw, contains(text, 'ouer') AS loc, coalesce(local_topic, false) AS lt, lower(headline) AS low,
  NOT contains(text, 'ouer') AND regexp_matches(d.head, {_words(FOREIGN)}) AND NOT regexp_matches(d.body, {_words(HOME)}) AS foreign_,
  {" + ".join(f"{w} * regexp_matches(text, '{p}')::INT" for w, p in INSTRUMENTS)} AS instruments FROM articles a JOIN d USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN un USING (doc_id)),
gx AS (SELECT *, CASE WHEN subjects >= 2 THEN 12 WHEN subjects = 1 THEN 7 ELSE 0 END AS territory, len(list_filter(kw, lambda x: x IN ({", ".join(f"'{t}'" for t in ASKED)}))) AS asked, len(list_filter(kw, lambda x: contains(low, x))) > 0 AS hk, len(kw) > 0 AS k FROM fx),
bx AS (SELECT *, CASE WHEN foreign_ THEN territory WHEN tier1 OR head_topics > 0 THEN 30 WHEN topics > 0 THEN 18 ELSE territory END AS base FROM gx),
sx AS (SELECT *, CASE WHEN veto THEN 0 WHEN NOT foreign_ AND any_unit THEN greatest(base, CASE WHEN head_unit THEN 18 ELSE 12 END) ELSE base END AS syllabus,
  CASE WHEN veto THEN 0 WHEN asked > 0 THEN least(20, 8 + 4 * asked) WHEN hk THEN 8 WHEN k THEN 4 ELSE 0 END AS past, CASE WHEN veto THEN 0 WHEN loc THEN 20 WHEN lt THEN 10 ELSE 0 END AS place,
  CASE WHEN veto THEN 0 ELSE least(15, floor(2.5 * instruments + 0.5)) END AS importance, CASE WHEN veto THEN 0 WHEN papers >= 6 THEN 15 WHEN papers >= 4 THEN 12 WHEN papers = 3 THEN 8 WHEN papers = 2 THEN 4 ELSE 0 END AS reuse FROM bx),
x AS (SELECT *, syllabus + past + place + importance + reuse AS score FROM sx)
SELECT doc_id, score::BIGINT AS score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS band, syllabus::BIGINT AS syllabus, past::BIGINT AS past, place::BIGINT AS place, importance::BIGINT AS importance, reuse::BIGINT AS reuse,
  CASE WHEN veto THEN 'discarded' WHEN score >= 40 THEN 'relevant' ELSE 'new' END AS status FROM x""")
def relevance_score(spark, sf):
    """Score, band, parts and status of each article."""
    hits = kept(_hits(spark, sf))
    t = M.kept_topics(M.topic_match(A.plain_hits(hits)))
    papers = F.create_map(*[F.lit(x) for kv in TOPIC_PAPERS.items() for x in kv])
    m = t.groupBy("doc_id").agg(F.count_if("in_headline").alias("head_topics"), F.count("*").alias("topics"), F.max(F.col("topic") == "rarities").alias("tier1"), F.max(F.col("topic") == "places").alias("local_topic"), F.max(papers[F.col("topic")]).alias("papers"))
    u = M.unit_evidence(A.clean_hits(hits), WEAK, ALONE).groupBy("doc_id").agg(F.max("in_headline").alias("head_unit"))
    a = articles(spark, sf)
    has = lambda w: F.col("text").contains(w)
    edge = lambda p: X.EDGE_LEFT + p + X.EDGE_RIGHT
    text, head = F.col("text"), F.col("headline")
    weight = sum((F.when(text.rlike(p), w).otherwise(0) for w, p in INSTRUMENTS), F.lit(0))
    keywords = M.first_keywords(a, TERMS).select("doc_id", "keywords")
    foreign = ~has("ouer") & X.norm(head).rlike(edge(FOREIGN)) & ~_NORM_BODY().rlike(edge(HOME))
    f = a.select("doc_id", text.rlike("SECRET|!!").alias("veto"), F.coalesce(has("ment").cast("int") + has("lung").cast("int") + has("ción").cast("int"), F.lit(0)).alias("subjects"), has("ouer").alias("loc"), F.lower(head).alias("low"), foreign.alias("foreign"), weight.alias("instruments"))
    j = f.join(m, "doc_id", "left").join(u, "doc_id", "left").join(keywords, "doc_id").withColumn("any_unit", F.col("head_unit").isNotNull()).fillna(0, ["head_topics", "topics", "papers"]).fillna(False, ["tier1", "local_topic", "head_unit"])
    asked, hk = F.size(F.array_intersect("keywords", F.array(*[F.lit(x) for x in ASKED]))), F.exists("keywords", lambda x: F.col("low").contains(x))
    r = M.relevance(*[F.col(c) for c in ("veto", "foreign", "head_topics", "topics", "subjects", "tier1", "head_unit", "any_unit")], asked, hk, F.size("keywords") > 0, *[F.col(c) for c in ("loc", "local_topic", "instruments", "papers")])
    return j.select("doc_id", "veto", r.alias("r")).select("doc_id", "r.*", M.status_of(F.lit("new"), F.col("veto"), F.col("r.band")).alias("status"))


PATTERNS = {"name": "([A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})+)", "mail": "([A-Za-z0-9._]+@[A-Za-z0-9.-]+)", "number": "([0-9]{3,})"}


@query("entity_extract", f"""
WITH e AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS name FROM documents" for k, p in PATTERNS.items())})
SELECT doc_id, kind, name, count(*)::BIGINT AS mentions FROM e WHERE length(name) BETWEEN 3 AND 70 AND name NOT IN ('100', '200') GROUP BY ALL""")
def entity_extract(spark, sf):
    return M.entities(articles(spark, sf), PATTERNS, ("100", "200"))


_ASKED = """q AS (SELECT item_id, text AS stem, CASE WHEN item_id % 5 = 0 THEN [] WHEN item_id % 5 = 1 THEN ['both 1 and 2', '1 and 2 only', 'x', 'y'] WHEN item_id % 5 = 2 THEN ['Assertion (A)', 'b', 'c', 'd'] WHEN item_id % 5 = 3 THEN ['codes given below', 'x'] ELSE ['one', 'two', 'three', 'four'] END AS options FROM benchmark)"""


def _sql_format() -> str:
    whens = " ".join(f"WHEN regexp_matches({'stem' if name == 'negative_statement' else 'text_'}, '{pattern}') THEN '{name}'" for name, pattern in Q.FORMATS)
    return f"CASE WHEN len(options) < 2 THEN 'descriptive' {whens} ELSE 'direct_recall' END"


@query("format_classifier", f"""
WITH {_ASKED}, t AS (SELECT *, concat_ws(' ' || chr(10) || ' ', stem, nullif(array_to_string(options, ' ' || chr(10) || ' '), '')) AS text_ FROM q) SELECT item_id, {_sql_format()} AS format FROM t""")
def format_classifier(spark, sf):
    """Formats of the benchmark's items, with options of five kinds."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    k = F.pmod("item_id", F.lit(5))
    options = F.when(k == 0, lit([])).when(k == 1, lit(["both 1 and 2", "1 and 2 only", "x", "y"])).when(k == 2, lit(["Assertion (A)", "b", "c", "d"])).when(k == 3, lit(["codes given below", "x"])).otherwise(lit(["one", "two", "three", "four"]))
    return table(spark, sf, "benchmark").select("item_id", Q.question_format(F.col("text"), options).alias("format"))


@query("corrections_guard", """
WITH c AS (SELECT * FROM (VALUES (1, 'tionth'), (1, 'ouer'), (2, 'eaux'), (3, '@')) v(correction, term)),
h AS (SELECT doc_id, correction, count(*) AS terms FROM documents JOIN c ON contains(lower(text), term) GROUP BY ALL)
SELECT doc_id, correction, terms::BIGINT AS terms, CASE WHEN regexp_matches(text, '[0-9]{4}|!!') THEN 'high' ELSE 'low' END AS severity FROM h JOIN documents USING (doc_id)""")
def corrections_guard(spark, sf):
    """Corrections that an article touches, and how badly. Their terms are a bounded list, tested in the row."""
    terms = ((1, "tionth"), (1, "ouer"), (2, "eaux"), (3, "@"))
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("correction"), F.lit(t).alias("term")) for k, t in terms]), lambda c: F.lower("text").contains(c["term"]))
    severity = F.when(F.col("text").rlike("[0-9]{4}|!!"), "high").otherwise("low")
    e = articles(spark, sf).select("doc_id", severity.alias("severity"), F.explode(found).alias("c"))
    return e.groupBy("doc_id", F.col("c.correction").alias("correction"), "severity").agg(F.count("*").alias("terms"))


@query("question_hash_dedup", """
WITH h AS (SELECT doc_id, substr(sha256(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))), 1, 32) AS hash FROM documents) SELECT hash, min(doc_id) AS doc_id FROM h GROUP BY ALL""")
def question_hash_dedup(spark, sf):
    return D.first_of_hash(articles(spark, sf).select("doc_id", "text"), "text", "doc_id").select("hash", "doc_id")


_WORDS = "list_filter(string_split(regexp_replace(lower(headline), '[^a-z0-9₹%]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in SIGNATURE_STOP) + "))"


@query("headline_signature_dedup", f"""
WITH {{articles}}, w AS (SELECT doc_id, edition, doc_id % 3 AS day, (doc_id % 4 = 0)::INT * 100 + (doc_id % 7 = 0)::INT * 20 + (doc_id % 6 = 0)::INT * 10 - (doc_id % 5 = 0)::INT * 5 AS rank, {_WORDS} AS w FROM articles),
s AS (SELECT *, array_to_string(list_concat(list_sort(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))), list_sort(list_slice(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]')), 1, 6))), '|') AS signature FROM w),
b AS (SELECT day, signature, first(doc_id ORDER BY rank DESC, doc_id) AS doc_id, first(edition ORDER BY rank DESC, doc_id) AS best, count(*) AS copies, list(DISTINCT edition) AS editions FROM s WHERE signature <> '' GROUP BY ALL)
SELECT day, signature, doc_id, copies::BIGINT AS copies, array_to_string(list_sort(list_filter(editions, lambda x: x <> best)), ',') AS also_in FROM b""")
def headline_signature_dedup(spark, sf):
    """One copy of each story of a day: primary sources first, then those of the area, opinions last; and where else it ran."""
    k = F.col("doc_id")
    a = articles(spark, sf).withColumn("day", k % 3).withColumn("rank", D.copy_rank(k % 4 == 0, k % 7 == 0, k % 6 == 0, k % 5 == 0))
    d = D.by_signature(a, "day", "text", "rank", "edition", "doc_id")
    return d.select("day", "signature", "doc_id", "copies", F.array_join("also_in", ",").alias("also_in"))


def _pairs(body: str) -> str:
    return f"""{{articles}}, s AS (SELECT edition, doc_id, list_sort({_TOKENS.format("headline")}) AS h, list_sort({_TOKENS.format(body)}) AS t FROM articles),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY edition, h, t) AS rep FROM s WHERE len(h) > 0), c AS (SELECT * FROM k WHERE doc_id = rep),
o AS (SELECT x.edition, x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.h, y.h)) AS hs, len(x.h) + len(y.h) - len(list_intersect(x.h, y.h)) AS ha, len(list_intersect(x.t, y.t)) AS bs, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)) AS ba FROM c x JOIN c y ON x.edition = y.edition AND x.doc_id < y.doc_id),
pairs AS (SELECT edition, a, b, hs AS head_shared, ha AS head_all, bs AS body_shared, ba AS body_all FROM o WHERE 60 * hs * greatest(ba, 1) + 40 * bs * ha >= 42 * ha * greatest(ba, 1) UNION ALL SELECT edition, rep, doc_id, len(h), len(h), len(t), len(t) FROM k WHERE doc_id <> rep)"""


_OPENING, _WHOLE = "substr(coalesce(text, ''), 1, 1200)", "text"


@query("near_dup_jaccard", f"WITH {_pairs(_OPENING)} SELECT edition, a, b, head_shared::BIGINT AS head_shared, head_all::BIGINT AS head_all, body_shared::BIGINT AS body_shared, body_all::BIGINT AS body_all FROM pairs")
def near_dup_jaccard(spark, sf):
    """Stories of an edition that are the same by .6 of their headlines and .4 of their openings; equal ones tied to the first of them."""
    return D.similar_pairs(articles(spark, sf), "edition")


def _groups(body: str) -> str:
    return f"""{_pairs(body)}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), g AS (SELECT node, min(other) AS leader FROM r GROUP BY node)"""


@query("dup_components", f"WITH RECURSIVE {_groups(_WHOLE)} SELECT node, leader FROM g")
def dup_components(spark, sf):
    """Groups of stories of an edition that are the same by .6 of their headlines and .4 of their whole texts."""
    return D.similar_groups(articles(spark, sf), "edition")


#: Articles as an edition prints them: a publication and a page of their own, a prominence, and whether they are of the area.
_PRINTED = """printed AS (SELECT doc_id, edition, headline, substr(coalesce(text, ''), length(headline) + 2) AS body, lang AS publication, (doc_id % 8)::INT AS page, (doc_id % 9)::INT AS prominence, contains(lower(headline || ' ' || coalesce(text, '')), 'thethe') AS area FROM articles)"""


def _merged_sql(body: str) -> str:
    return f"""{_groups(body)}, {_PRINTED}, tied AS (SELECT p.*, coalesce(leader, doc_id) AS leader FROM printed p LEFT JOIN g ON node = doc_id),
bodies AS (SELECT leader, body, min(doc_id) AS doc_id, count(*) AS copies, max(prominence) AS prominence, bool_or(area) AS area, list(DISTINCT page) AS pages, list(DISTINCT publication) AS publications FROM tied GROUP BY leader, body),
parts AS (SELECT b.*, p.edition, p.headline, p.page, p.publication, row_number() OVER (PARTITION BY leader ORDER BY length(b.body) DESC, doc_id) AS k FROM bodies b JOIN printed p USING (doc_id)),
merged AS (SELECT leader, max(doc_id) FILTER (k = 1) AS lead, max(edition) FILTER (k = 1) AS edition, max(headline) FILTER (k = 1) AS headline, string_agg(CASE WHEN k = 1 THEN parts.body ELSE chr(10) || chr(10) || '[Also reported in ' || coalesce(publication, 'another edition') || CASE WHEN page > 0 THEN ', p' || page ELSE '' END || ']' || chr(10) || parts.body END, '' ORDER BY k) AS text,
  sum(copies)::BIGINT AS copies, max(prominence) AS prominence, bool_or(area) AS area, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, array_to_string(list_sort(list_distinct(flatten(list(publications)))), ',') AS publications FROM parts GROUP BY leader)"""


def _merged(spark, sf, opening=None):
    a = articles(spark, sf)
    body = F.substring(F.coalesce("text", F.lit("")), F.length("headline") + 2, F.length(F.coalesce("text", F.lit(""))))
    printed = a.select("edition", "doc_id", "headline", body.alias("body"), F.col("lang").alias("publication"), (F.col("doc_id") % 8).cast("int").alias("page"), (F.col("doc_id") % 9).cast("int").alias("prominence"), F.lower(F.concat_ws(" ", "headline", "text")).contains("thethe").alias("area"))
    return D.merged_stories(printed, D.similar_groups(a, "edition", body=opening))


@query("dup_collapsed", f"""
WITH RECURSIVE {_merged_sql(_WHOLE)} SELECT leader, lead, copies, length(text)::BIGINT AS chars, sha256(text) AS digest, prominence, pages, publications FROM merged""")
def dup_collapsed(spark, sf):
    """Each event as one story: the longest text leads, others follow under where they stood."""
    out = _merged(spark, sf).select("leader", "lead", "copies", "chars", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), "prominence", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("publications", ",").alias("publications"))
    return out


_INVARIANTS = r"""list_distinct(list_concat(list_transform(regexp_extract_all(t, '(?i)([0-9,.]+[ \t\n]*(?:crore|lakh|billion|million|percent|per cent|%))', 1), lambda x: regexp_replace(lower(x), '[,. \t\n]', '', 'g')), list_concat(regexp_extract_all(t, '\b([0-9]{2,})\b', 1), list_concat(list_filter(regexp_extract_all(t, '\b([A-Z]{2,6})\b', 1), lambda x: x NOT IN ('THE', 'AND', 'FOR', 'WITH', 'THAT', 'THIS', 'FROM', 'WILL', 'SAID')), list_transform(regexp_extract_all(t, '\b([A-Z][a-z]{3,})\b', 1), lambda x: lower(x))))))"""


@query("cross_script_pairs", f"""
WITH s AS (SELECT doc_id % 20 AS edition, doc_id, lang, {_INVARIANTS} AS t FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)), k AS (SELECT * FROM s WHERE len(t) >= 3),
c AS (SELECT x.edition, x.doc_id AS a, y.doc_id AS b, len(list_intersect(x.t, y.t)) AS shared, least(len(x.t), len(y.t)) AS smaller FROM k x JOIN k y ON x.edition = y.edition AND x.lang <> y.lang AND x.doc_id < y.doc_id)
SELECT edition, a, b, shared::BIGINT AS shared, smaller::BIGINT AS smaller FROM c WHERE 100 * shared >= 5 * smaller""")
def cross_script_pairs(spark, sf):
    """Stories in two languages that share numbers and names (5 % here, where the prose is invented): proposals for a reader."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 20).alias("edition"))
    return D.cross_pairs(d, "edition", "lang", percent=5)


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/article)\b[^>]*>', chr(10), 'g'), '(?i)</t[dh]>', ' · ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) > 2 OR regexp_matches(x, '[0-9]')) AS l FROM c)
SELECT page_id, len(l)::BIGINT AS lines, array_to_string(l, chr(10)) AS text FROM l""")
def html_to_text(spark, sf):
    t = table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))
    return t.select("page_id", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("lines"), "text")


@query("page_titles", r"""
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title,
  CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '(^|\.)example\.org$') THEN 'Org Press' WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '(^|\.)example\.com$') THEN 'Com Wire' ELSE lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) END AS publisher,
  regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '(^|\.)example\.org$') AS is_primary FROM pages""")
def page_titles(spark, sf):
    p = readers.publishers(table(spark, sf, "pages"), [("example.org", "Org Press", True), ("example.com", "Com Wire", False)])
    return p.select("page_id", X.url_host(F.col("url")).alias("host"), X.page_title(F.col("html")).alias("title"), "publisher", "is_primary")


@query("press_index", r"""
WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<h3\b[^>]*>.*?</h3>|<a\b[^>]*>.*?</a>)', 1)) AS x, generate_subscripts(regexp_extract_all(html, '(?is)(<h3\b[^>]*>.*?</h3>|<a\b[^>]*>.*?</a>)', 1), 1) - 1 AS pos FROM pages),
c AS (SELECT *, last_value(CASE WHEN regexp_matches(x, '(?i)^<h3') THEN trim(regexp_replace(x, '<[^>]*>', '', 'g')) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS ministry FROM x)
SELECT page_id, pos::INT AS pos, ministry, regexp_extract(x, '(?i)href=["'']([^"'']*)', 1) AS link, trim(regexp_replace(x, '<[^>]*>', '', 'g')) AS title FROM c WHERE NOT regexp_matches(x, '(?i)^<h3')""")
def press_index(spark, sf):
    """Links of each page under the last third-level heading before them."""
    return readers.press_index(table(spark, sf, "pages").select("page_id", "html"))


@query("interview_turns", """
WITH c AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (before IS NOT NULL AND before <> role)::BIGINT AS switches, count(*) FILTER (contains(text, '?'))::BIGINT AS questions,
  CASE WHEN count(*) FILTER (before IS NOT NULL AND before <> role) >= 3 AND count(*) FILTER (contains(text, '?')) > 0 THEN 'interview' ELSE 'report' END AS genre FROM c GROUP BY conv_id""")
def interview_turns(spark, sf):
    """Conversations that read as interviews: three switches of speaker or more, and a question."""
    c = table(spark, sf, "conversations").withColumn("before", F.lag("role").over(W.Window.partitionBy("conv_id").orderBy("turn")))
    g = R.count_by(c, ["conv_id"], switches=F.col("before") != F.col("role"), questions=F.col("text").contains("?")).withColumnRenamed("n", "turns")
    return g.withColumn("genre", F.when((F.col("switches") >= 3) & (F.col("questions") > 0), "interview").otherwise("report"))


_ASK = "mcq AS (SELECT doc_id AS n, coalesce(split_part(text, chr(10), 1), '') || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END AS question, substr(text, 1, 12) AS a, substr(text, 1 + (doc_id % 4)::INT, 12) AS b, 'None of the above' AS c, 'four 4' AS d FROM documents)"


def _mcqs(spark, sf):
    t = F.col("text")
    return articles(spark, sf).select(
        F.col("doc_id").alias("n"), F.concat("headline", F.when(F.col("doc_id") % 3 == 0, "?").otherwise("")).alias("question"), F.substring(t, 1, 12).alias("option_a"), F.substring(t, (1 + F.col("doc_id") % 4).cast("int"), F.lit(12)).alias("option_b"),
        F.when(F.col("doc_id") % 2 == 0, "None of the above").otherwise("three").alias("option_c"), F.lit("four 4").alias("option_d"), F.lit("a").alias("correct_option"), F.lit("direct_recall").alias("format"), F.lit("because").alias("explanation"), F.lit("2024-01-01").alias("fact_as_of"),
    )


@query("mcq_inspect_flags", f"""
WITH {_ASK}, p AS (SELECT n, question, a, b, CASE WHEN n % 2 = 0 THEN c ELSE 'three' END AS c, d, trim(regexp_replace(lower(coalesce(a, '')), '[^a-z0-9]+', ' ', 'g')) AS na, trim(regexp_replace(lower(coalesce(b, '')), '[^a-z0-9]+', ' ', 'g')) AS nb FROM mcq)
SELECT n, regexp_matches(question, '{Q.ASKS}') AS asks, regexp_matches(c, '{Q.OTHERS}') OR regexp_matches(a, '{Q.OTHERS}') OR regexp_matches(b, '{Q.OTHERS}') AS others, na <> '' AND na = nb AS equal FROM p""")
def mcq_inspect_flags(spark, sf):
    """Which fatal findings each question has."""
    f = Q.inspected(_mcqs(spark, sf))
    has = lambda x: F.array_contains("fatal", x)
    return f.select("n", (~has("asks nothing")).alias("asks"), has("option about options").alias("others"), has("equal options").alias("equal"))


@query("second_reading_applied", f"""
WITH {_ASK}, p AS (SELECT n, CASE WHEN n % 2 = 0 THEN c ELSE 'three' END AS c, a, b, trim(regexp_replace(lower(coalesce(a, '')), '[^a-z0-9]+', ' ', 'g')) AS na, trim(regexp_replace(lower(coalesce(b, '')), '[^a-z0-9]+', ' ', 'g')) AS nb FROM mcq),
r AS (SELECT doc_id AS n, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'rewrite' ELSE 'keep' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'Which is generally so?' ELSE 'Which one is it?' END AS q FROM labels)
SELECT p.n, coalesce(verdict, 'keep') AS verdict FROM p LEFT JOIN r USING (n) WHERE coalesce(verdict, 'keep') <> 'reject' AND NOT (coalesce(verdict, 'keep') = 'rewrite'
  AND (regexp_matches(q, '{Q.HEDGES}') OR coalesce(regexp_matches(c, '{Q.OTHERS}') OR regexp_matches(a, '{Q.OTHERS}') OR regexp_matches(b, '{Q.OTHERS}'), false) OR (na <> '' AND na = nb)))""")
def second_reading_applied(spark, sf):
    """Questions after a second reading: rejected ones go, rewritten ones are inspected again, unread ones stay."""
    l = table(spark, sf, "labels")
    verdict = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "rewrite").otherwise("keep")
    r = l.select(F.col("doc_id").alias("n"), verdict.alias("verdict"), F.when(F.col("doc_id") % 3 == 0, "Which is generally so?").otherwise("Which one is it?").alias("new_question"))
    return Q.second_reading(_mcqs(spark, sf), r).select("n", "verdict")


CODES = tuple(f"Brand#{k}" for k in range(1, 26))


@query("canonical_codes", f"""
WITH r AS (SELECT p_partkey AS unit, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' [' || p_type || ']' WHEN 2 THEN p_brand || ' — ' || p_name WHEN 3 THEN 'see ' || p_brand || ' first' ELSE p_name END AS raw, p_brand FROM part),
i AS (SELECT *, list_filter([{", ".join(f"'{c}'" for c in CODES)}], lambda c: contains(raw, c)) AS inside FROM r)
SELECT unit, raw, CASE WHEN unit % 5 IN (0, 1, 2) THEN p_brand WHEN len(inside) = 1 THEN inside[1] END AS code FROM i""")
def canonical_codes(spark, sf):
    """Codes as a model writes them, resolved to known ones."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.col("p_brand")).when(k == 1, F.concat("p_brand", F.lit(" ["), "p_type", F.lit("]"))).when(k == 2, F.concat("p_brand", F.lit(" — "), "p_name")).when(k == 3, F.concat(F.lit("see "), "p_brand", F.lit(" first"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), raw.alias("raw")).withColumn("code", Q.canonical_code(F.col("raw"), list(CODES)))


@query("question_plan", f"""
WITH {{items}}, {{item_units}}, n AS (SELECT item_id, count(*) AS units FROM item_units GROUP BY ALL),
i AS (SELECT item_id, row_number() OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY item_id) - 1 AS index, least(10, 4 + 2 * greatest(0, coalesce(units, 0) - 1)) AS n FROM items LEFT JOIN n USING (item_id)), q AS (SELECT *, unnest(range(n::BIGINT)) AS k FROM i)
SELECT item_id, (k + 1)::INT AS k, [{", ".join(f"'{f}'" for f in Q.FORMAT_CYCLE)}][((index * n + k) % 10 + 1)::INT] AS format FROM q""")
def question_plan(spark, sf):
    """How many questions each item gets, and of which formats."""
    n = item_units(spark, sf).groupBy("item_id").agg(F.count("*").alias("units"))
    i = items(spark, sf).join(n, "item_id", "left").fillna(0, ["units"])
    place = F.row_number().over(W.Window.partitionBy(F.date_format("day", "yyyy-MM")).orderBy("item_id")) - 1
    return Q.planned_formats(i.withColumn("index", place)).select("item_id", "k", "format")


@query("datelines", r"""
WITH b AS (SELECT doc_id, 'By ' || source || CASE doc_id % 4 WHEN 0 THEN ', NEW DELHI' WHEN 1 THEN ' — SRI CITY-EAST ' WHEN 2 THEN ' PTI' ELSE '' END AS byline FROM documents UNION ALL SELECT -1, 'VIJAYAWADA')
SELECT doc_id, CASE WHEN doc_id = -1 THEN 'VIJAYAWADA' WHEN doc_id % 4 = 0 THEN 'NEW DELHI' WHEN doc_id % 4 = 1 THEN 'SRI CITY-EAST' ELSE '' END AS place, CASE WHEN doc_id = -1 THEN 'VIJAYAWADA' WHEN doc_id % 4 < 2 THEN split_part(split_part(byline, ',', 1), ' —', 1) || CASE WHEN doc_id % 4 = 1 THEN ' ' ELSE '' END ELSE trim(byline) END AS author FROM b""")
def datelines(spark, sf):
    """Places at the end of bylines, and the bylines without them."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    b = d.select("doc_id", F.concat(F.lit("By "), "source", F.when(k == 0, ", NEW DELHI").when(k == 1, " — SRI CITY-EAST ").when(k == 2, " PTI").otherwise("")).alias("byline")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("VIJAYAWADA")))
    return b.select("doc_id", X.dateline(F.col("byline")).alias("place"), X.without_dateline(F.col("byline")).alias("author"))


@query("page_headlines", r"""
WITH {html}, h AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title, l FROM lines JOIN pages USING (page_id))
SELECT page_id, CASE WHEN title <> '' AND page_id % 3 <> 0 THEN title ELSE coalesce(list_filter(l, lambda x: length(x) BETWEEN 26 AND 219)[1], '') END AS headline FROM h""".replace("{html}", r"""g AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?is)<title[^>]*>[^<]*', '<title>Home') ELSE html END AS html FROM pages),
a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)>|<!--.*?-->', ' ', 'g') AS t FROM g),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/article)\b[^>]*>', chr(10), 'g'), '(?i)</t[dh]>', ' · ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
lines AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) > 2 OR regexp_matches(x, '[0-9]')) AS l FROM c)"""))
def page_headlines(spark, sf):
    """Titles of pages; a third of them are made generic here, and take the first line of fitting length."""
    generic = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", r"(?is)<title[^>]*>[^<]*", "<title>Home")).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", X.page_headline(generic).alias("headline"))


@query("verdict_parse", """
WITH s AS (SELECT doc_id AS id, (doc_id % 7)::INT AS batch, 0 AS ord, CASE WHEN toxic = 1 THEN 'Reject' WHEN quality = 1 THEN ' HIGH' ELSE 'maybe' END AS class, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 300 - 50)::INT END AS score FROM labels
  UNION ALL SELECT doc_id, ((doc_id + 3) % 7)::INT, 1, 'drop', 5 FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT -1, 0, 0, 'high', 90),
f AS (SELECT *, CASE lower(trim(class)) WHEN 'reject' THEN 'drop' WHEN 'drop' THEN 'drop' WHEN 'high' THEN 'high' WHEN 'maybe' THEN 'partial' END AS c, row_number() OVER (PARTITION BY id ORDER BY batch, ord) AS k FROM s WHERE id IN (SELECT doc_id FROM documents))
SELECT d.doc_id AS id, c AS class, CASE WHEN c IS NOT NULL THEN least(100, greatest(0, coalesce(score, CASE c WHEN 'high' THEN 70 WHEN 'partial' THEN 45 ELSE 10 END))) END::BIGINT AS score, c IS NULL AS missing FROM documents d LEFT JOIN f ON f.id = d.doc_id AND k = 1""")
def verdict_parse(spark, sf):
    """Verdicts checked: unknown ids go, the first of an id counts, scores are cut, missing ones are told."""
    l = table(spark, sf, "labels")
    a = l.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).cast("int").alias("batch"), F.lit(0).alias("ord"), F.when(F.col("toxic") == 1, "Reject").when(F.col("quality") == 1, " HIGH").otherwise("maybe").alias("class"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 300 - 50).cast("int").alias("score"), F.lit("").alias("reason"))
    b = l.filter("doc_id % 3 = 0").select("doc_id", ((F.col("doc_id") + 3) % 7).cast("int"), F.lit(1), F.lit("drop"), F.lit(5), F.lit(""))
    c = spark.range(1).select(F.lit(-1).cast("long"), F.lit(0), F.lit(0), F.lit("high"), F.lit(90), F.lit(""))
    return Q.verdicts(a.union(b).union(c), table(spark, sf, "documents").select(F.col("doc_id").alias("id"))).select("id", "class", "score", "missing")


@query("vocab_prefix_truncation", f"""
WITH w AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS word FROM documents), a AS (SELECT DISTINCT substr(word, 1, 6) AS alias FROM w WHERE length(word) >= 8),
u AS (SELECT alias FROM a WHERE alias NOT IN (SELECT word FROM w))
SELECT alias, alias AS last, first(word ORDER BY length(word), word) AS completion FROM u JOIN w ON starts_with(word, alias) AND length(word) > length(alias) GROUP BY ALL""")
def vocab_prefix_truncation(spark, sf):
    """Cut-off words, and the shortest word that each may have been."""
    t = articles(spark, sf).select(F.explode(X.raw_tokens(F.col("text"))).alias("word"))
    w = kept(t.filter(X.is_token(F.col("word"))).distinct())
    return M.truncated_aliases(w.filter("length(word) >= 8").select(F.substring("word", 1, 6).alias("alias")).distinct(), w)


@query("term_suppression", f"""
WITH {_HITS} SELECT doc_id, hits.alias, hits.hits, coalesce(clean.hits, 0) AS clean, coalesce(clean.in_headline, false) AS clean_headline FROM hits LEFT JOIN clean USING (doc_id, ord)""")
def term_suppression(spark, sf):
    """Occurrences of each alias, and how many are not part of a longer name."""
    return _hits(spark, sf).select("doc_id", "alias", "hits", "clean", "clean_headline")


@query("text_repairs", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '([a-z])-[ \t]*\n[ \t]*([a-z])', '\1\2', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS joined, regexp_replace(lower(split_part(text, chr(10), 1)), '(?:ings?|ed|es|s)$', '') AS stem FROM documents""")
def text_repairs(spark, sf):
    """Texts with their broken words joined; headlines stemmed."""
    return articles(spark, sf).select("doc_id", F.sha2(X.dehyphenated(F.col("text")).cast("binary"), 256).alias("joined"), X.stem(F.col("headline")).alias("stem"))


@query("compendium_json", """
WITH {items}, {attempts}, i AS (SELECT strftime(day, '%Y-%m-%d') AS day, bucket AS section, item_id, row_number() OVER (PARTITION BY day ORDER BY bucket, item_id) AS n FROM items WHERE status = 'published'),
q AS (SELECT mcq AS item_id, string_agg('{"q":' || attempt_id || ',"stem":"' || event_type || '","answer":"' || ok::VARCHAR || '"}', ',' ORDER BY attempt_id) AS q FROM attempts GROUP BY ALL),
t AS (SELECT day, section, string_agg('{"n":' || n || ',"title":"Item ' || i.item_id || '","questions":[' || coalesce(q, '') || ']}', ',' ORDER BY n) AS t FROM i LEFT JOIN q ON q.item_id = i.item_id GROUP BY ALL)
SELECT day, '{"sections":[' || string_agg('{"section":"' || section || '","topics":[' || t || ']}', ',' ORDER BY section) || ']}' AS document FROM t GROUP BY day""")
def compendium_json(spark, sf):
    """One JSON document a day: its sections, numbered topics and their questions."""
    i = R.visible(items(spark, sf)).select(day_text(F.col("day")).alias("day"), F.col("bucket").alias("section"), "item_id", F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"))
    a = attempts(spark, sf).select(F.col("mcq").alias("item_id"), F.col("attempt_id").cast("int").alias("q"), F.col("event_type").alias("stem"), F.col("ok").cast("string").alias("answer"))
    return sinks.compendium(i, a)


@query("markdown_digest", """
WITH {items}, b AS (SELECT strftime(day, '%Y-%m-%d') AS day, bucket, string_agg('### Item ' || item_id || chr(10) || chr(10) || 'Score ' || score || chr(10), chr(10) ORDER BY item_id) AS t, count(*) AS n FROM items WHERE status = 'published' GROUP BY ALL)
SELECT day, '---' || chr(10) || 'date: ' || day || chr(10) || 'items: ' || sum(n)::BIGINT || chr(10) || '---' || chr(10) || chr(10) || string_agg('## ' || bucket || chr(10) || chr(10) || t, chr(10) ORDER BY bucket) AS markdown FROM b GROUP BY day""")
def markdown_digest(spark, sf):
    i = R.visible(items(spark, sf)).select(day_text(F.col("day")).alias("day"), "bucket", "item_id", F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("headline"), F.concat(F.lit("Score "), F.col("score").cast("string")).alias("body"))
    return sinks.markdown_digest(i)


_N2 = "chr(10) || chr(10)"
_DIGEST = f"""{{items}}, {{days}}, {{shown}}, {{mcqs}}, it AS (SELECT strftime(day, '%Y-%m-%d') AS day, bucket, item_id, score % 9 = 0 AS salvaged, score % 7 = 0 AS verify, score % 4 = 0 AS noted, score % 3 = 0 AS facted, score, CASE WHEN score % 9 = 0 THEN 9 ELSE left(bucket, 1)::INT END AS place FROM shown WHERE bucket <> '3-MEDIUM' OR score % 9 = 0),
nm AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY place, item_id) AS n FROM it),
qs AS (SELECT m.*, day, n, row_number() OVER (PARTITION BY day ORDER BY n, mcq) AS number FROM mcqs m JOIN nm USING (item_id) WHERE m.status = 'published'),
ask AS (SELECT item_id, string_agg('**Q' || number || '.** _(' || CASE format {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sinks.FORMAT_LABELS.items())} ELSE 'Direct recall' END || ')_' || {_N2} || 'Which is' || chr(10) || CASE WHEN unit % 2 = 0 THEN chr(10) ELSE '' END || 'unit ' || unit || '?' || {_N2} || '- (a) w' || chr(10) || '- (b) x' || chr(10) || '- (c) y' || chr(10) || '- (d) z' || chr(10), chr(10) ORDER BY number) AS asked FROM qs GROUP BY item_id)"""
_DIGEST = _DIGEST.replace("'Which is' || chr(10) || CASE WHEN unit % 2 = 0 THEN chr(10) ELSE '' END", "'Which is' || CASE WHEN unit % 2 = 0 THEN chr(10) || chr(10) ELSE '  ' || chr(10) END")


@query("full_digest", f"""
WITH {_DIGEST}, b AS (SELECT nm.*, '### ' || n || '. Item ' || nm.item_id || {_N2} || CASE WHEN verify THEN '> ⚠ **Verify:** ' || CASE WHEN score % 14 = 0 THEN 'A figure or name in this item is unconfirmed.' ELSE 'Look ' || score || ' up.' END || {_N2} ELSE '' END || CASE WHEN noted THEN '#### Note ' || score || chr(10) || 'text' || chr(10) || '##### More' || {_N2} ELSE '' END
  || CASE WHEN facted THEN '#### Facts' || {_N2} || '- one' || chr(10) || '- two ' || score || {_N2} ELSE '' END || CASE WHEN asked IS NOT NULL THEN '#### Questions' || {_N2} || asked || {_N2} ELSE '' END AS body FROM nm LEFT JOIN ask USING (item_id)),
u AS (SELECT day, place, CASE WHEN place = 9 THEN 'Miscellaneous' ELSE 'Of ' || any_value(bucket) END AS heading, string_agg(body, '' ORDER BY n) AS t FROM b GROUP BY day, place),
a AS (SELECT day, string_agg('## ' || heading || {_N2} || t, '' ORDER BY place) AS t FROM u GROUP BY day), c AS (SELECT day, count(*) AS items FROM nm GROUP BY day),
k AS (SELECT day, count(*) AS n, string_agg('**Q' || number || '** — **(' || correct || ')**  _(item ' || n || ')_' || chr(10) || CASE WHEN unit % 3 = 0 THEN chr(10) || 'For unit ' || unit || chr(10) ELSE '' END, chr(10) ORDER BY number) AS t FROM qs GROUP BY day)
SELECT day, '---' || chr(10) || 'title: "Current Affairs — ' || strftime(day::DATE, '%A, %-d %B %Y') || '"' || chr(10) || 'date: ' || day || chr(10) || 'source: "Test"' || chr(10) || 'items: ' || items || chr(10) || 'questions: ' || coalesce(k.n, 0) || chr(10) || '---' || {_N2} || '# Current Affairs — ' || strftime(day::DATE, '%A, %-d %B %Y') || {_N2}
  || 'Test · ' || items || ' item' || CASE WHEN items = 1 THEN '' ELSE 's' END || ' · ' || coalesce(k.n, 0) || ' question' || CASE WHEN coalesce(k.n, 0) = 1 THEN '' ELSE 's' END || {_N2} || a.t || CASE WHEN k.n > 0 THEN '---' || {_N2} || '## Answer key' || {_N2} || k.t || chr(10) ELSE '' END AS markdown FROM a JOIN c USING (day) LEFT JOIN k USING (day)""")
def full_digest(spark, sf):
    """A day as Markdown with notes, facts, questions and their key."""
    s, u = F.col("score"), F.col("unit")
    text = lambda before, c, after="": F.concat(F.lit(before), c.cast("string"), F.lit(after))
    i = R.visible(items(spark, sf), days(spark, sf)).select(
        day_text(F.col("day")).alias("day"), "bucket", "item_id", text("Item ", F.col("item_id")).alias("headline"), (s % 9 == 0).alias("salvaged"), F.when(s % 14 == 0, " ").when(s % 7 == 0, text("Look ", s, " up.")).alias("verify_note"),
        F.when(s % 4 == 0, text("## Note ", s, "  \ntext\n\n### More".replace("\n\n", "\n"))).alias("notes"), F.when(s % 3 == 0, text("* one\n\ntwo ", s)).alias("facts"),
    )
    q = mcqs(spark, sf).filter("status = 'published'").select(
        "item_id", F.col("mcq").alias("q"), "format", F.concat(F.lit("Which is\n"), F.when(u % 2 == 0, "\n").otherwise(""), text("unit ", u, "?")).alias("question"), *[F.lit(v).alias(f"option_{k}") for k, v in zip("abcd", "wxyz", strict=True)], "correct", F.when(u % 3 == 0, text("For unit ", u)).alias("explanation"),
    )
    return sinks.full_digest(i, q, [(b, f"Of {b}") for b in ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW")], "Test")


@query("angle_lists", r"""
WITH RECURSIVE l AS (SELECT p_partkey AS unit, p_name || ' (' || p_brand || ', ' || p_type || ' [a, b]), ' || p_name || ')' || CASE WHEN p_size % 2 = 0 THEN ', [' || p_size || ', c' ELSE ',, d' END AS t FROM part),
s(unit, t, i, depth, part, parts) AS (SELECT unit, t, 0, 0, '', []::VARCHAR[] FROM l
  UNION ALL SELECT unit, t, i + 1, CASE WHEN c IN ('(', '[') THEN depth + 1 WHEN c IN (')', ']') THEN greatest(depth - 1, 0) ELSE depth END, CASE WHEN c = ',' AND depth = 0 THEN '' ELSE part || c END, CASE WHEN c = ',' AND depth = 0 THEN list_append(parts, part) ELSE parts END FROM (SELECT *, substr(t, i + 1, 1) AS c FROM s WHERE i < length(t)))
SELECT unit, array_to_string(list_filter(list_transform(list_append(parts, part), lambda x: trim(x)), lambda x: x <> ''), '|') AS angles FROM s WHERE i = length(t)""")
def angle_lists(spark, sf):
    """Angles between commas outside of brackets, however deep."""
    p = table(spark, sf, "part")
    end = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(", ["), F.col("p_size").cast("string"), F.lit(", c"))).otherwise(",, d")
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(", "), "p_type", F.lit(" [a, b]), "), "p_name", F.lit(")"), end)
    return p.select(F.col("p_partkey").alias("unit"), F.array_join(MD.split_angles(text), "|").alias("angles"))


@query("compendium_topics", """
WITH {items}, i AS (SELECT item_id, score, item_id % 977 AS n FROM items WHERE status = 'published')
SELECT item_id, 'What it is' || CASE WHEN score % 2 = 0 THEN '|Key facts' ELSE '' END || CASE WHEN score % 3 = 0 THEN '|The provisions that get asked' ELSE '' END AS titles,
  'p' || CASE WHEN score % 2 = 0 THEN '|table' ELSE '' END || CASE WHEN score % 3 = 0 THEN CASE WHEN score % 9 = 0 THEN '|p' ELSE '|list' END ELSE '' END AS types,
  'It is unit ' || n || '. So it goes.|More of it.' || CASE WHEN score % 2 = 0 THEN '|beside ' || n ELSE '' END || CASE WHEN score % 9 = 0 THEN '|* only' WHEN score % 3 = 0 THEN '|x ' || n || '|y' ELSE '' END AS items,
  CASE WHEN score % 2 = 0 THEN 'a:' || n || ' · z' ELSE '' END AS cells, CASE WHEN score % 5 = 0 THEN '' ELSE 'Outlay = Rs ' || n || ' crore' END AS hook,
  CASE WHEN score % 7 = 0 THEN '' ELSE 'It is unit ' || n || '.|' || CASE WHEN score % 5 = 0 THEN 'short — 1' ELSE 'Outlay (new) — Rs ' || n || ' crore; nothing' END || '|Art. ' || n END AS recap FROM i""")
def compendium_topics(spark, sf):
    """Topics of the compendium: sections of their notes, a hook and a recap."""
    s, n = F.col("score"), (F.col("item_id") % 977).cast("string")
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    note = of("lead\n## What it is\nIt is unit ", n, ".\nSo it goes.\n\nMore of it.", F.when(s % 2 == 0, of("\n## key facts\n| k | v | w |\n|---|---|---|\n| a | ", n, " | z |\nbeside ", n)).otherwise(""), F.when(s % 9 == 0, "\n## Provisions\n* only").when(s % 3 == 0, of("\n## Provisions\n- x ", n, "\n- y")).otherwise(""), "\n## Else\nlost")
    facts = F.when(s % 5 == 0, "short — 1").otherwise(of("**Outlay** (new) — Rs ", n, " crore\n\n nothing "))
    i = items(spark, sf).filter("status = 'published'").select("item_id", note.alias("note"), facts.alias("facts"), F.when(s % 7 != 0, of("**Art. ", n, "**")).alias("link"))
    t = sinks.compendium_topics(i)
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    cells = F.flatten(F.transform("sections", lambda x: F.transform(F.coalesce(x["rows"], F.array().cast("array<array<string>>")), lambda r: F.array_join(r, ":"))))
    return t.select("item_id", joined("sections", lambda x: x["title"]).alias("titles"), joined("sections", lambda x: x["type"]).alias("types"), joined("sections", lambda x: F.array_join(x["items"], "|")).alias("items"), F.array_join(cells, "|").alias("cells"), "hook", F.coalesce(F.array_join("recap", "|"), F.lit("")).alias("recap"))
