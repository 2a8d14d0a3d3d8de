"""Queries of the desk: gates, tags, provenance, plans, maintenance and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.functions import lists as L
from lectern.functions import text as X
from lectern.operators import desk as D
from lectern.operators import genre as N
from lectern.operators import ranking as K
from lectern.operators import relational as R
from lectern.operators.aliases import alias_hits
from lectern.plans import relational as P
from lectern.sources import readers as R_
from lectern.plans.roles import answers, articles, attempts, item_units, items, mcqs, query, reviewed, shown, table, units
from lectern.plans.texts import _HITS, _OPENING, _TOKENS, ALONE, TERMS, VOCABULARY, _merged, _merged_sql
from lectern.sources.shared import dealt

_Q = lambda p: p.replace("'", "''")
_ANY = lambda c, ps: " OR ".join(f"regexp_matches({c}, '{_Q(p)}')" for p in ps)


def _strings(xs) -> str:
    return ", ".join(f"'{_Q(x)}'" for x in xs)


@query("subject_tags", f"""
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '{_Q(p)}') THEN '{n}' END" for n, p in L.SUBJECTS)}], lambda x: x IS NOT NULL), ',') AS subjects FROM documents""")
def subject_tags(spark, sf):
    """Subjects that an article hints at."""
    return articles(spark, sf).select("doc_id", F.array_join(D.tags_of(F.col("text"), L.SUBJECTS), ",").alias("subjects"))


@query("area_flag", f"WITH {{articles}} SELECT doc_id, regexp_matches(lower(headline || ' ' || coalesce(text, '')), '{L.any_term((*L.AREA_TERMS, 'thethe'))}') AS area FROM articles")
def area_flag(spark, sf):
    """Whether an article is of the area that an exam asks for (one term of the test's own prose is added)."""
    return articles(spark, sf).select("doc_id", D.names_area(F.concat_ws(" ", "headline", "text"), (*L.AREA_TERMS, "thethe")).alias("area"))


@query("noise_headlines", f"WITH {{articles}} SELECT doc_id, {_ANY('lower(headline)', ['(?i)' + p for p in L.NOISE])} AS noise FROM articles")
def noise_headlines(spark, sf):
    """Headlines that are dropped unread."""
    return articles(spark, sf).select("doc_id", X.any_of(F.lower("headline"), tuple(L.edged(f"(?i){p}") for p in L.NOISE)).alias("noise"))


_TEXT = "(headline || ' ' || coalesce(text, ''))"
#: One mark of the test's own prose is added to the labels of a page.
_MARKERS = (*L.MARKERS, ("archive", "test", r"\bTo of\b"))
_VETO = (
    f"CASE WHEN regexp_matches({_TEXT}, '{L.MARKERS[0][2]}') THEN 'letters to the editor' WHEN regexp_matches({_TEXT}, '{L.MARKERS[1][2]}') OR NOT regexp_matches({_TEXT}, '{L.MARKERS[2][2]}|{L.MARKERS[3][2]}') AND regexp_matches({_TEXT}, '{_MARKERS[4][2]}') THEN 'from the archives' WHEN regexp_matches({_TEXT}, '{_Q(L.SPORT_REPORT)}') AND NOT regexp_matches({_TEXT}, '{_Q(L.SPORT_EXEMPT)}') THEN 'sport match report' WHEN regexp_matches(headline, '{_Q(L.SPORT_EVENT)}') AND NOT regexp_matches({_TEXT}, '{_Q(L.SPORT_EXEMPT)}') THEN 'sports event announcement' "
    + " ".join(f"WHEN regexp_matches(headline, '{_Q(p)}') OR regexp_matches(substr(coalesce(text, ''), 1, 900), '{_Q(p)}') THEN '{_Q(n)}'" for n, p in (*L.VETO, ("test", "!!")))
    + " END"
)


def _veto():
    nothing, body = F.lit(None).cast("string"), F.coalesce("text", F.lit(""))
    genre = N.genre_of(body, F.concat_ws(" ", "headline", "text"), nothing, nothing, nothing, nothing, _MARKERS)["genre"]
    return D.vetoed(F.col("headline"), body, (*L.VETO, ("test", "!!")), L.SPORT_REPORT, L.SPORT_EXEMPT, L.SPORT_EVENT, genre=genre)


@query("veto_chain", f"WITH {{articles}} SELECT doc_id, {_VETO} AS veto FROM articles")
def veto_chain(spark, sf):
    """Why an article is out, by the whole chain of rules, its genre first (one rule and one label of the test's own prose are added)."""
    return articles(spark, sf).select("doc_id", _veto().alias("veto"))


_LIST = "[" + _strings(TERMS) + "]"


def _gated(source: str, ties: str) -> str:
    """CTEs of the gate over ``source`` (doc_id, edition, headline, text, area, prominence)."""
    return f"""gf AS (SELECT doc_id, edition, {_VETO} AS veto, area, prominence, {" + ".join(f"{w} * coalesce(regexp_matches({_TEXT}, '{_Q(p)}'), false)::INT" for w, p, _ in L.INSTRUMENTS)} AS instruments,
  list_slice(list_filter({_LIST}, lambda t: contains(lower(headline), t) OR contains(lower(substr(coalesce(text, ''), 1, 1400)), t)), 1, 8) AS found, lower(headline) AS low FROM {source}),
gh AS (SELECT *, len(list_filter(found, lambda t: contains(low, t))) AS heads, len(found) AS n FROM gf),
gp AS (SELECT *, CASE WHEN area THEN 4 ELSE 0 END + least(instruments, 6) + least(heads * 1.5::DOUBLE + (n - heads) * 0.4::DOUBLE, 6.0::DOUBLE) + least(prominence, 6) * 0.5::DOUBLE AS points FROM gh),
gs AS (SELECT doc_id, edition, veto, area, prominence, CASE WHEN veto IS NULL THEN floor(points * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS score, veto IS NULL AND points >= 6 AS pass FROM gp),
gk AS (SELECT *, row_number() OVER (PARTITION BY edition, pass ORDER BY score DESC, {ties}) AS place FROM gs),
gated AS (SELECT doc_id, edition, area, score::DOUBLE AS score, pass AND (place <= 12 OR area) AS keep FROM gk)"""


def _points(events, *more):
    """``events`` (doc_id, edition, headline, text, area, prominence) with the veto and the points of the gate."""
    head, body = F.col("headline"), F.coalesce("text", F.lit(""))
    text = F.concat(head, F.lit(" "), body)
    weight = sum((F.when(text.rlike(L.edged(p)), w).otherwise(0) for w, p, _ in L.INSTRUMENTS), F.lit(0))
    heads, others = D.angle_terms(head, body, TERMS)
    a = events.select("doc_id", "edition", _veto().alias("veto"), "area", weight.alias("instruments"), heads.alias("heads"), others.alias("others"), "prominence", *more)
    return a.withColumn("points", D.gate_points(F.col("area"), F.col("instruments"), F.col("heads"), F.col("others"), F.col("prominence")))


@query("rule_gate", f"""
WITH {{articles}}, marked AS (SELECT *, contains(lower({_TEXT}), 'thethe') AS area, doc_id % 9 AS prominence FROM articles), {_gated("marked", "doc_id")} SELECT * FROM gated""")
def rule_gate(spark, sf):
    """Points of each article, and the twelve of an edition that are kept, with all of the area."""
    text = F.concat("headline", F.lit(" "), F.coalesce("text", F.lit("")))
    a = articles(spark, sf).withColumn("area", D.names_area(text, ("thethe",))).withColumn("prominence", F.col("doc_id") % 9)
    return D.gate(_points(a), "edition", "doc_id").select("doc_id", "edition", "area", "score", "keep")


@query("paper_lane", f"""
WITH RECURSIVE {_merged_sql(_OPENING)}, events AS (SELECT lead AS doc_id, edition, headline, text, area, prominence FROM merged), {_gated("events", "NOT area, prominence DESC, doc_id")}
SELECT gated.edition, doc_id, '{{{{"doc_id":' || doc_id || ',"copies":' || copies || ',"score":' || score || ',"pages":"' || pages || '","chars":' || length(text) || '}}}}' AS candidate FROM gated JOIN merged ON lead = doc_id WHERE keep""".replace("{{", "{").replace("}}", "}"))
def paper_lane(spark, sf):
    """From articles to candidates: copies of a story are merged first, and the merged stories pass the gate, those of the area and the prominent ones first among equals."""
    stories = _merged(spark, sf, 1200).withColumnsRenamed({"lead": "doc_id", "body": "text"})
    more = ("copies", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "chars")
    kept = D.gate(_points(stories, *more), "edition", ~F.col("area"), F.col("prominence").desc(), "doc_id").filter("keep")
    return kept.select("edition", "doc_id", F.to_json(F.struct("doc_id", "copies", "score", "pages", "chars")).alias("candidate"))


_FIVE = ("the", "of", "and", "that", "thing", "reed", "inly", "erst", "those", "tion")


@query("keyword_tags", f"""
SELECT item_id, array_to_string(list_slice(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '(?i){chr(92)}b{t}{chr(92)}b') THEN '{t}' END" for t in _FIVE)}], lambda x: x IS NOT NULL), 1, 5), ',') AS keywords FROM benchmark""")
def keyword_tags(spark, sf):
    """The first five keywords of each question, as whole words."""
    rules = tuple((t, rf"(?i)\b{t}\b") for t in _FIVE)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(D.tags_of(F.col("text"), rules), 1, 5), ",").alias("keywords"))


@query("angle_merge", f"""
WITH {{articles}}, t AS (SELECT edition, doc_id, unnest({_TOKENS.format("headline")}) AS word FROM articles), w AS (SELECT edition, word, count(*) AS docs, min(doc_id) AS first FROM t GROUP BY ALL),
s AS (SELECT *, regexp_replace(regexp_replace(word, '(?:ions|ion|ing|ies|ed|es|s)$', ''), 'e$', '') AS stem FROM w)
SELECT edition, stem, first(word ORDER BY docs DESC, length(word), first, word) AS word, count(*)::BIGINT AS spellings FROM s WHERE stem <> '' GROUP BY ALL""")
def angle_merge(spark, sf):
    """Words of an edition's headlines, one a stem: the commonest spelling, then the shortest."""
    t = articles(spark, sf).select("edition", "doc_id", F.explode(X.tokens(F.col("headline"))).alias("word"))
    w = t.groupBy("edition", "word").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    return D.merged_angles(w, "edition", "word", "docs", "first")


@query("bleed_suspects", f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{_Q(L.CREDIT)}|!!') AS suspect FROM documents")
def bleed_suspects(spark, sf):
    """Bodies with a contributor's credit inside: two stories run together (one mark of the test's own prose is added)."""
    return articles(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).rlike(f"{L.CREDIT}|!!").alias("suspect"))


@query("named_entities", f"""
WITH e AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, trim(regexp_replace(unnest(regexp_extract_all(text, '{_Q(p)}', 1)), '[ {chr(92)}t{chr(92)}n{chr(92)}r{chr(92)}f{chr(92)}v]+', ' ', 'g')) AS name FROM documents" for k, p in L.NAMES.items())})
SELECT doc_id, CASE kind WHEN 'acronym' THEN 'organisation' ELSE kind END AS kind, name, count(*)::BIGINT AS mentions FROM e WHERE length(name) BETWEEN 3 AND 70 AND NOT (kind = 'acronym' AND name IN ({_strings(L.ACRONYMS_OUT)})) GROUP BY ALL""")
def named_entities(spark, sf):
    """Organisations, schemes and persons, with their mentions; acronyms count as organisations."""
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_replace(x, X.BLANKS, " ")).alias("name"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(L.edged(p)), 1), named(k)) for k, p in L.NAMES.items()]))
    e = articles(spark, sf).select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.*").filter(F.length("name").between(3, 70) & ~((F.col("kind") == "acronym") & F.col("name").isin(*L.ACRONYMS_OUT)))
    return e.groupBy("doc_id", F.when(F.col("kind") == "acronym", "organisation").otherwise(F.col("kind")).alias("kind"), "name").agg(F.count("*").alias("mentions"))


_BLOCKED, _WEAK, _EXTRA = ("small ring", "red", "blue bolt"), ("small", "large"), ("green",)


@query("alias_standing", f"""
WITH a AS (SELECT p_partkey AS unit, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS alias, p_size % 6 = 0 AS strict, CASE p_size % 10 WHEN 0 THEN true WHEN 1 THEN false END AS decided FROM part)
SELECT unit, alias, coalesce(decided, CASE WHEN lower(alias) IN ({_strings(_BLOCKED)}) THEN false WHEN strict OR lower(alias) IN ({_strings(_EXTRA)}) THEN true ELSE contains(alias, ' ') END) AS standalone, lower(alias) IN ({_strings(_WEAK)}) AS weak FROM a""")
def alias_standing(spark, sf):
    """Which aliases may stand alone, and which are weak."""
    alias = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    decided = F.when(F.col("p_size") % 10 == 0, True).when(F.col("p_size") % 10 == 1, False)
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("unit"), alias.alias("alias"), (F.col("p_size") % 6 == 0).alias("strict"), decided.alias("decided"))
    return D.alias_standing(a, _BLOCKED, _WEAK, _EXTRA).select("unit", "alias", "standalone", "weak")


@query("shortlist_apply", """
WITH i AS (SELECT source AS list, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id % 6 = 0 AS area, doc_id % 4 = 0 AS is_primary FROM documents),
v AS (SELECT list, n, quality = 1 AS keep, CASE WHEN doc_id % 13 = 0 THEN 1 END AS duplicate_of, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS why, doc_id % 10 = 0 AS says_area FROM i JOIN labels USING (doc_id)),
j AS (SELECT i.list, i.n, i.area OR coalesce(says_area, false) AS area, is_primary, coalesce(keep AND duplicate_of IS NULL, false) AS kept, duplicate_of, why FROM i LEFT JOIN v ON v.list = i.list AND v.n = i.n)
SELECT list, n::INT AS n, area, is_primary, kept, CASE WHEN NOT kept THEN CASE WHEN duplicate_of IS NOT NULL THEN 'Duplicate of item ' || duplicate_of || '.' ELSE coalesce(nullif(why, ''), 'Not shortlisted.') END END AS why,
  CASE WHEN kept THEN row_number() OVER (PARTITION BY list, kept ORDER BY NOT area, NOT is_primary, n) END::INT AS place FROM j""")
def shortlist_apply(spark, sf):
    """A reader's verdicts, by number, applied to the list they were given; of two verdicts on one number, the first counts."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("list"))
    i = d.withColumn("n", F.row_number().over(W.Window.partitionBy("list").orderBy("doc_id"))).withColumn("area", F.col("doc_id") % 6 == 0).withColumn("is_primary", F.col("doc_id") % 4 == 0)
    l = table(spark, sf, "labels").join(i.select("doc_id", "list", "n"), "doc_id")
    v = l.select("list", "n", (F.col("quality") == 1).alias("keep"), F.when(F.col("doc_id") % 13 == 0, 1).alias("duplicate_of"), F.when(F.col("toxic") == 1, "toxic").otherwise("").alias("why"), (F.col("doc_id") % 10 == 0).alias("says_area"), F.lit(0).alias("ord"))
    late = v.filter("n % 2 = 0").withColumn("keep", ~F.col("keep")).withColumn("ord", F.lit(1))
    return D.shortlisted(i.drop("doc_id"), v.union(late)).select("list", "n", "area", "is_primary", "kept", "why", "place")


_CODED = "q AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN chr(10) || chr(10) || 'Codes:' || chr(10) || '(a) one' || chr(10) || '(b) Two   parts' || chr(10) || '(C) three ' || chr(10) || '(d) four' || chr(10) WHEN 1 THEN chr(10) || '(a) one' || chr(10) || '(b) two parts' || chr(10) || '(c) three' || chr(10) || '(d) five' ELSE '' END AS question FROM benchmark)"


@query("option_codes", rf"""
WITH {_CODED}, x AS (SELECT *, [lower(regexp_replace(trim(regexp_extract(question, '{_Q(D.CODES)}', 1)), '\s+', ' ', 'g')), lower(regexp_replace(trim(regexp_extract(question, '{_Q(D.CODES)}', 2)), '\s+', ' ', 'g')), lower(regexp_replace(trim(regexp_extract(question, '{_Q(D.CODES)}', 3)), '\s+', ' ', 'g')), lower(regexp_replace(trim(regexp_extract(question, '{_Q(D.CODES)}', 4)), '\s+', ' ', 'g'))] AS o FROM q)
SELECT item_id, CASE WHEN o = ['one', 'two parts', 'three', 'four'] THEN regexp_replace(regexp_replace(question, '{_Q(D.CODES)}', ''), '\s+$', '') ELSE question END AS question FROM x""")
def option_codes(spark, sf):
    """Questions without the list of their own options at the end."""
    tail = F.when(F.col("item_id") % 3 == 0, "\n\nCodes:\n(a) one\n(b) Two   parts\n(C) three \n(d) four\n").when(F.col("item_id") % 3 == 1, "\n(a) one\n(b) two parts\n(c) three\n(d) five").otherwise("")
    q = table(spark, sf, "benchmark").select("item_id", F.concat("text", tail).alias("question"))
    return q.select("item_id", D.without_codes(F.col("question"), [F.lit(x) for x in ("one", "two parts", " three", "four")]).alias("question"))


@query("call_batches", "SELECT source, doc_id, ((row_number() OVER w - 1) // 12 + 1)::INT AS batch, ((row_number() OVER w - 1) // 4 + 1)::INT AS retry FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def call_batches(spark, sf):
    """Articles in the batches of their calls."""
    return D.batched(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query("json_salvage", r"""
WITH q AS (SELECT item_id AS key, length(regexp_replace(text, '["\\]', '', 'g')) AS n, [3, 2, 0][item_id % 3 + 1] AS objects FROM benchmark) SELECT key, objects::BIGINT AS objects, (objects * n)::BIGINT AS chars FROM q""")
def json_salvage(spark, sf):
    """Replies of a model read as far as they go: fenced, with line breaks inside strings, cut off in the third object, or without any list."""
    text = F.regexp_replace("text", r'["\\]', "")
    one = lambda n: F.concat(F.lit(f'{{"n": {n}, "q": "'), text, F.lit('", "o": ["{", "}"]}'))
    two = F.concat(F.lit("```json\n["), one(1), F.lit(",\n"), one(2), F.lit(",\n"))
    k = F.col("item_id") % 3
    reply = F.when(k == 0, F.concat(two, one(3), F.lit("]\n```"))).when(k == 1, F.concat(two, F.lit('{"n": 3, "q": "cut'))).otherwise(F.concat(F.lit("No list: "), text))
    got = D.salvaged(table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), reply.alias("reply")))
    chars = F.aggregate(F.transform("objects", lambda x: F.length(F.get_json_object(x, "$.q"))), F.lit(0), lambda a, b: a + b)
    return got.select("key", F.size("objects").cast("long").alias("objects"), chars.cast("long").alias("chars"))


@query("unit_gate", """
WITH {item_units}, {mcqs}, q AS (SELECT mcq, item_id, CASE WHEN mcq % 5 = 0 THEN NULL ELSE unit + mcq % 2 END AS unit FROM mcqs)
SELECT mcq, q.item_id, iu.unit, q.unit IS NOT NULL AND iu.unit IS NULL AS dropped FROM q LEFT JOIN item_units iu ON iu.item_id = q.item_id AND iu.unit = q.unit""")
def unit_gate(spark, sf):
    """A question keeps a unit that its item has."""
    q = mcqs(spark, sf).select("mcq", "item_id", F.when(F.col("mcq") % 5 != 0, F.col("unit") + F.col("mcq") % 2).alias("unit"))
    return D.gated_units(q, item_units(spark, sf))


_GENRES = ("report", "editorial", "oped", "interview")


@query("opinion_provenance", """
WITH g AS (SELECT doc_id, ['report', 'editorial', 'oped', 'interview'][doc_id % 4 + 1] AS genre, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source || ' |  | ' || lang || '|' END AS bylines FROM documents)
SELECT doc_id, genre, CASE WHEN genre = 'editorial' THEN 'The Paper' WHEN bylines IS NULL THEN '' ELSE split_part(bylines, ' |  | ', 1) || ', ' || rtrim(split_part(bylines, ' |  | ', 2), '|') END AS author, genre IN ('editorial', 'oped') AS needs_verify FROM g""")
def opinion_provenance(spark, sf):
    """Who speaks in each article, and whether it has to be verified."""
    genre = F.get(F.array(*[F.lit(g) for g in _GENRES]), (F.col("doc_id") % 4).cast("int"))
    a = table(spark, sf, "documents").select("doc_id", genre.alias("genre"), F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(" |  | "), "lang", F.lit("|"))).alias("bylines"), F.lit("The Paper").alias("publication"))
    return D.provenance(a, ("editorial", "oped")).select("doc_id", "genre", "author", "needs_verify")


@query("requestion_plan", """
WITH {items}, {item_units}, {units}, {mcqs}, {answers}, u AS (SELECT DISTINCT mcq FROM answers), q AS (SELECT item_id, count(*) AS have, count(*) FILTER (mcq % 3 <> 0) AS tagged, count(*) FILTER (u.mcq IS NOT NULL) AS keep FROM mcqs LEFT JOIN u USING (mcq) GROUP BY item_id),
n AS (SELECT item_id, count(*) AS n FROM item_units JOIN units USING (unit) WHERE NOT broad GROUP BY ALL),
j AS (SELECT i.item_id, coalesce(have, 0) AS have, coalesce(tagged, 0) AS tagged, coalesce(keep, 0) AS keep, coalesce(n, 0) AS n, least(10, 4 + 2 * greatest(0, coalesce(n, 0) - 1)) AS target FROM items i LEFT JOIN q USING (item_id) LEFT JOIN n USING (item_id)),
w AS (SELECT *, have < target OR (n > 0 AND tagged < have) AS worth FROM j)
SELECT item_id, have::BIGINT AS have, tagged::BIGINT AS tagged, keep::BIGINT AS keep, target::BIGINT AS target, CASE WHEN worth THEN greatest(0, target - keep) ELSE 0 END::BIGINT AS want, NOT worth AS skipped FROM w""")
def requestion_plan(spark, sf):
    """What asking again would bring each item."""
    used = answers(spark, sf).select("mcq").distinct().withColumn("used", F.lit(True))
    q = mcqs(spark, sf).join(used, "mcq", "left").select("item_id", F.when(F.col("mcq") % 3 != 0, F.col("unit")).alias("unit"), F.coalesce("used", F.lit(False)).alias("used"))
    n = item_units(spark, sf).join(units(spark, sf).filter("not broad").select("unit"), "unit", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))
    return D.requestion_plan(items(spark, sf), q, n)


@query("redraft_supersession", """
WITH {items} SELECT item_id, CASE WHEN item_id % 5 = 0 AND status = 'draft' THEN 'discarded' ELSE status END AS status, CASE WHEN item_id % 5 = 0 AND status = 'published' THEN item_id + 1000000 END AS successor FROM items""")
def redraft_supersession(spark, sf):
    """Items after some were drafted anew."""
    i = items(spark, sf)
    return D.superseded(i.select("item_id", "status"), i.filter("item_id % 5 = 0").select("item_id", (F.col("item_id") + 1000000).alias("new_id")))


def _flagged(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "n_chars", (F.col("doc_id") % 30).alias("day"), (F.col("doc_id") % 4 == 0).alias("is_primary"), (F.col("doc_id") % 6 == 0).alias("area"), (F.col("doc_id") % 5 == 0).alias("opinion"))


@query("feed_order", "SELECT doc_id, doc_id % 30 AS day, row_number() OVER (PARTITION BY doc_id % 30 ORDER BY doc_id % 4 <> 0, doc_id % 6 <> 0, doc_id % 5 = 0, doc_id)::INT AS place FROM documents")
def feed_order(spark, sf):
    """Articles of a day as a feed shows them."""
    return D.feed_order(_flagged(spark, sf), "day", "doc_id").select("doc_id", "day", "place")


_PAGED = """j AS (SELECT d.doc_id, d.source, d.text, d.doc_id % 9 = 0 AS duplicate, CASE WHEN l.toxic = 1 THEN 'drop' WHEN l.quality = 1 THEN 'high' WHEN l.doc_id IS NOT NULL THEN 'partial' ELSE '' END AS class, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id % 50 END AS triage_score, d.n_chars % 101 AS score, d.doc_id % 6 = 0 AS area, d.doc_id % 8 AS page FROM documents d LEFT JOIN labels l USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY duplicate, CASE class WHEN 'high' THEN 0 WHEN 'partial' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END, triage_score DESC NULLS LAST, score DESC, area DESC, page, doc_id) AS place FROM j)"""


def _paged(spark, sf):
    l = table(spark, sf, "labels").withColumn("seen", F.lit(True))
    kind = F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "high").when(F.col("seen"), "partial").otherwise("")
    d = table(spark, sf, "documents").join(l, "doc_id", "left")
    rows = d.select(
        "doc_id", "source", "text", (F.col("doc_id") % 9 == 0).alias("duplicate"), kind.alias("class"), F.when(F.col("seen"), F.col("doc_id") % 50).alias("triage_score"), (F.col("n_chars") % 101).alias("score"), (F.col("doc_id") % 6 == 0).alias("area"), (F.col("doc_id") % 8).alias("page")
    )
    return D.page_order(rows, "source", "doc_id")


@query("page_order", f"WITH {_PAGED} SELECT doc_id, source, place::INT AS place FROM o")
def page_order(spark, sf):
    """Articles of an edition as the desk reads them."""
    return _paged(spark, sf).select("doc_id", "source", "place")


@query("edition_detail", f"""
WITH {{item_units}}, {_PAGED}, u AS (SELECT item_id AS doc_id, string_agg(unit::VARCHAR, ',' ORDER BY hits < 48, unit) AS units FROM item_units GROUP BY ALL)
SELECT doc_id, source, place::INT AS place, class, substr(coalesce(text, ''), 1, 400) AS excerpt, coalesce(units, '') AS units FROM o LEFT JOIN u USING (doc_id)""")
def edition_detail(spark, sf):
    """An edition's articles with excerpts and units, those of the headline first."""
    u = R.listed(item_units(spark, sf).select(F.col("item_id").alias("doc_id"), "unit", (F.col("hits") < 48).alias("late")), ["doc_id"], ["late", "unit"], F.col("unit"), "units")
    p = _paged(spark, sf).select("doc_id", "source", "place", "class", F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("excerpt"))
    return p.join(u, "doc_id", "left").fillna("", ["units"])


@query("triage_status", f"""
WITH {{item_units}}, {{units}}, {{attempts}}, {_PAGED}, f AS (SELECT DISTINCT item_id AS doc_id FROM item_units JOIN units USING (unit) WHERE NOT broad AND exam = 'ECONOMY'),
c AS (SELECT source, count(*) AS articles, count(*) FILTER (class = 'high') AS high, count(*) FILTER (class = 'partial') AS partial, count(*) FILTER (class = 'drop') AS drops, count(*) FILTER (class = '') AS untriaged, count(*) FILTER (class = 'high' AND f.doc_id IS NULL) AS gaps FROM j LEFT JOIN f USING (doc_id) WHERE NOT duplicate GROUP BY source),
r AS (SELECT 'src' || mcq AS source, max(attempt_id) AS run, max_by(event_type, attempt_id) AS state FROM attempts GROUP BY ALL)
SELECT c.source, articles::BIGINT AS articles, high::BIGINT AS high, partial::BIGINT AS partial, drops::BIGINT AS drops, untriaged::BIGINT AS untriaged, gaps::BIGINT AS gaps, run, coalesce(state = 'click', false) AS running FROM c LEFT JOIN r USING (source)""")
def triage_status(spark, sf):
    """Where the triage of each edition stands: counts, those read as high that feed no unit, and the latest run."""
    fed = item_units(spark, sf).join(units(spark, sf).filter("not broad and exam = 'ECONOMY'").select("unit"), "unit", "left_semi").select(F.col("item_id").alias("doc_id")).distinct().withColumn("fed", F.lit(True))
    j = _paged(spark, sf).filter("not duplicate").select("doc_id", "source", "class").join(fed, "doc_id", "left")
    c = j.groupBy("source").agg(F.count("*").alias("articles"), *[F.count_if(F.col("class") == k).alias(n) for k, n in (("high", "high"), ("partial", "partial"), ("drop", "drops"), ("", "untriaged"))], F.count_if((F.col("class") == "high") & F.col("fed").isNull()).alias("gaps"))
    a = attempts(spark, sf).select(F.concat(F.lit("src"), F.col("mcq").cast("string")).alias("source"), F.col("attempt_id").alias("run"), F.col("event_type").alias("state"))
    return c.join(R.latest(a, ["source"], "run"), "source", "left").select("source", "articles", "high", "partial", "drops", "untriaged", "gaps", "run", F.coalesce(F.col("state") == "click", F.lit(False)).alias("running"))


@query("draft_plan", f"""
WITH {P._BANDED}, {{units}}, r AS (SELECT *, floor(0.55::DOUBLE * leverage + 0.45::DOUBLE * score + 0.5)::BIGINT AS rank FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY rank DESC, score DESC, item_id) AS place, row_number() OVER (PARTITION BY edition, bucket ORDER BY rank DESC, score DESC, item_id) AS inside FROM r),
w AS (SELECT *, CASE WHEN score >= 32 AND rank >= 45 AND place <= 35 THEN 'band' WHEN place <= 12 THEN 'floor' WHEN inside <= {P._case("bucket", P.FLOORS)} THEN 'bucket' END AS why FROM p),
v AS (SELECT item_id, edition, CASE WHEN why IS NOT NULL THEN 'picked' WHEN n = 0 AND score >= 45 THEN 'unmatched' WHEN n > 0 THEN 'below' END AS verdict FROM w),
a AS (SELECT p_name AS keyword, count(*) FILTER (p_size <= 5) AS n FROM part GROUP BY ALL), k AS (SELECT item_id, label AS keyword, max(hits) >= 48 AS head FROM item_units JOIN units USING (unit) GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY head DESC, n DESC, keyword) AS place FROM k JOIN a USING (keyword)),
t AS (SELECT item_id, string_agg(keyword, ',' ORDER BY place) FILTER (place <= 6) AS keywords, count(*) FILTER (n > 0) AS backed FROM s GROUP BY item_id)
SELECT v.item_id, edition, verdict, CASE WHEN verdict = 'picked' THEN coalesce(keywords, '') ELSE '' END AS keywords, CASE WHEN verdict = 'picked' THEN coalesce(backed, 0) ELSE 0 END::BIGINT AS backed FROM v LEFT JOIN t USING (item_id) WHERE verdict IS NOT NULL""")
def draft_plan(spark, sf):
    """What is to be drafted of each month with its six first keywords and how many were asked before; what scores well without a unit; what is below the bar."""
    banded = P._banded(spark, sf, F.coalesce("n", F.lit(0)).alias("n"))
    picked = K.selection_band(banded, "edition", "bucket", "score", "leverage", "item_id", P.FLOORS).select("item_id", F.lit(True).alias("_in"))
    verdict = F.when(F.col("_in"), "picked").when((F.col("n") == 0) & (F.col("score") >= 45), "unmatched").when(F.col("n") > 0, "below")
    v = banded.join(picked, "item_id", "left").select("item_id", "edition", verdict.alias("verdict")).filter("verdict is not null")
    asked = table(spark, sf, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.count_if(F.col("p_size") <= 5).alias("asked"))
    k = item_units(spark, sf).join(units(spark, sf).select("unit", F.col("label").alias("keyword")), "unit").groupBy("item_id", "keyword").agg((F.max("hits") >= 48).alias("head"))
    s = k.join(v.filter("verdict = 'picked'").select("item_id"), "item_id", "left_semi").join(asked, "keyword")
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.col("head").desc(), F.col("asked").desc(), "keyword"))
    s = s.withColumn("place", place)
    t = R.listed(s.filter("place <= 6"), ["item_id"], ["place"], F.col("keyword"), "keywords").join(s.groupBy("item_id").agg(F.count_if(F.col("asked") > 0).alias("backed")), "item_id")
    return v.join(t, "item_id", "left").fillna("", ["keywords"]).fillna(0, ["backed"])


@query("run_account", """
WITH g AS (SELECT source, count(*) AS processed, count(*) FILTER (quality = 1) AS drafted, count(*) FILTER (quality <> 1 AND toxic = 1) AS discarded FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, processed::BIGINT AS processed, drafted::BIGINT AS drafted, discarded::BIGINT AS discarded, floor(discarded * 100::DOUBLE / processed + 0.5)::BIGINT AS rate, processed >= 5 AND floor(discarded * 100::DOUBLE / processed + 0.5) < 20 AS warning FROM g""")
def run_account(spark, sf):
    """What a run made of what it was given, and whether it discards suspiciously little."""
    outcome = F.when(F.col("quality") == 1, "drafted").when(F.col("toxic") == 1, "discarded").otherwise("left")
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").select("source", outcome.alias("outcome"))
    return D.run_account(rows, "source", 5, 20)


@query("tag_precision", """
WITH {items}, {shown}, {item_units}, {units}, t AS (SELECT item_id, unit, paper, hits FROM item_units JOIN shown USING (item_id) JOIN units USING (unit)), j AS (SELECT paper, hits % 5 <> 0 AS ok, unit % 4 = 0 AS deferred FROM t WHERE (item_id + unit) % 7 = 0)
SELECT paper, count(*)::BIGINT AS pool, count(*) FILTER (ok)::BIGINT AS "right", count(*) FILTER (NOT deferred)::BIGINT AS settled, count(*) FILTER (ok AND NOT deferred)::BIGINT AS settled_right, floor(count(*) FILTER (ok) * 1000::DOUBLE / count(*) + 0.5) / 10 AS percent,
  CASE WHEN count(*) FILTER (NOT deferred) > 0 THEN floor(count(*) FILTER (ok AND NOT deferred) * 1000::DOUBLE / count(*) FILTER (NOT deferred) + 0.5) / 10 END AS settled_percent FROM j GROUP BY paper""")
def tag_precision(spark, sf):
    """How many judged tags that are still alive are right, by paper."""
    t = item_units(spark, sf).join(shown(spark, sf).select("item_id"), "item_id", "left_semi").join(units(spark, sf).select("unit", "paper"), "unit")
    judged = item_units(spark, sf).filter("(item_id + unit) % 7 = 0").select("item_id", "unit", (F.col("hits") % 5 != 0).alias("ok"), (F.col("unit") % 4 == 0).alias("deferred"))
    return D.precision(t.select("item_id", "unit", "paper"), judged, "paper")


@query("blank_split", f"""
WITH {_HITS}, u AS (SELECT doc_id, topic, count(DISTINCT alias) >= 2 OR bool_or(in_headline) OR bool_or(alias IN ({_strings(ALONE)})) AS kept FROM hits GROUP BY ALL), k AS (SELECT doc_id, bool_or(kept) AS kept FROM u GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN kept THEN 'recovered' WHEN kept IS NOT NULL THEN 'weak' ELSE 'nothing' END AS kind FROM documents b LEFT JOIN k USING (doc_id) WHERE lang <> 'en'""")
def blank_split(spark, sf):
    """Why items have no unit."""
    return D.blank_kinds(articles(spark, sf).filter("lang <> 'en'").select("doc_id"), alias_hits(articles(spark, sf), VOCABULARY), ALONE)


@query("seeded_sample", """
WITH {item_units}, {units}, p AS (SELECT paper, item_id * 100000 + unit AS tag, row_number() OVER (PARTITION BY paper ORDER BY sha256('audit:' || (item_id * 100000 + unit))) AS place FROM item_units JOIN units USING (unit) WHERE NOT broad) SELECT paper, tag, place::INT AS place FROM p WHERE place <= 40""")
def seeded_sample(spark, sf):
    """Forty tags of each paper for a person to judge, the same in every run."""
    tags = dealt(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("unit")), "item_id", "unit").distinct()
    t = tags.join(units(spark, sf).filter("not broad").select("unit", "paper"), "unit").select("paper", (F.col("item_id") * 100000 + F.col("unit")).alias("tag"))
    return D.seeded_sample(t, "paper", "tag", 40, "audit")


@query("unit_reconcile", """
WITH {item_units}, w AS (SELECT item_id, unit FROM item_units WHERE hits >= 10), e AS (SELECT item_id, unit FROM item_units WHERE hits <= 45)
SELECT item_id, count(*) FILTER (e.unit IS NULL)::BIGINT AS added, count(*) FILTER (w.unit IS NULL)::BIGINT AS dropped, count(*) FILTER (w.unit IS NOT NULL AND e.unit IS NOT NULL)::BIGINT AS kept FROM w FULL JOIN e USING (item_id, unit) GROUP BY item_id""")
def unit_reconcile(spark, sf):
    """What bringing an item's tags into line with its article's changes."""
    return D.unit_changes(item_units(spark, sf), F.col("hits") >= 10, F.col("hits") <= 45)


@query("byline_backfill", """
SELECT doc_id, 'By ' || source || ' NEW DELHI ' AS was, 'By ' || source AS byline FROM documents WHERE doc_id % 2 = 0""")
def byline_backfill(spark, sf):
    """Bylines that carry a dateline, without it."""
    b = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("By "), "source", F.when(F.col("doc_id") % 2 == 0, " NEW DELHI ").otherwise("")).alias("b"))
    return D.cleaned_bylines(b, "doc_id", "b")


@query("verify_flags", """
WITH {items} SELECT item_id, score > 50 AND bucket IN ('1-URGENT', '3-MEDIUM') AS needs_verify, score > 50 AND bucket NOT IN ('1-URGENT', '3-MEDIUM') AS cleared FROM items""")
def verify_flags(spark, sf):
    """Flags stay on opinion and go from plain reports."""
    opinion, flagged = F.col("bucket").isin("1-URGENT", "3-MEDIUM"), F.col("score") > 50
    return items(spark, sf).select("item_id", (flagged & opinion).alias("needs_verify"), (flagged & ~opinion).alias("cleared"))


@query("layer_drop", """
WITH {item_units}, {units}, {mcqs}, g AS (SELECT unit FROM units WHERE exam = 'ECONOMY')
SELECT 'units' AS "table", count(*) FILTER (unit IN (SELECT unit FROM g))::BIGINT AS removed, count(*) FILTER (unit NOT IN (SELECT unit FROM g))::BIGINT AS "left" FROM units
UNION ALL SELECT 'item_units', count(*) FILTER (unit IN (SELECT unit FROM g)), count(*) FILTER (unit NOT IN (SELECT unit FROM g)) FROM item_units UNION ALL SELECT 'mcqs', count(*) FILTER (unit IN (SELECT unit FROM g)), count(*) FILTER (unit NOT IN (SELECT unit FROM g)) FROM mcqs""")
def layer_drop(spark, sf):
    """What goes with the units of one exam, and what stays."""
    u = units(spark, sf)
    return D.layer_dropped({"units": (u, "unit"), "item_units": (item_units(spark, sf), "unit"), "mcqs": (mcqs(spark, sf), "unit")}, u.filter("exam = 'ECONOMY'").select("unit"))


@query("vocabulary_seed", """
WITH o AS (SELECT p_partkey AS unit, p_name AS label FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS unit, CASE WHEN p_size > 25 THEN p_name ELSE p_type END AS label FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(n.unit, o.unit) AS unit, coalesce(n.label, o.label) AS label, CASE WHEN n.unit IS NULL THEN 'pruned' WHEN o.unit IS NULL THEN 'new' WHEN n.label = o.label THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON n.unit = o.unit""")
def vocabulary_seed(spark, sf):
    """A vocabulary seeded again: new, changed and unchanged rows, and those that the seed no longer has."""
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("was"))
    new = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("unit"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_type")).alias("label"))
    change = F.when(F.col("label").isNull(), "pruned").when(F.col("was").isNull(), "new").when(F.col("label") == F.col("was"), "same").otherwise("updated")
    return old.join(new, "unit", "full").select("unit", F.coalesce("label", "was").alias("label"), change.alias("change"))


@query("ocr_english_lines", r"""
WITH b AS (SELECT conv_id AS page, text AS t, (conv_id * 7 + turn * 13) % 100 AS conf, (turn % 3) * 200 AS x, turn * 50 AS y FROM conversations),
s AS (SELECT *, CASE WHEN length(trim(t)) = 0 OR length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace(t, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(t) * (length(array_to_string(regexp_extract_all(t, '([A-Za-z]{2,}|[0-9]+)', 1), ''))::DOUBLE / length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))) END AS e FROM b),
k AS (SELECT *, coalesce(conf, 0) >= 60 AND e >= 0.35 AS kept FROM s)
SELECT page, coalesce(string_agg(t, chr(10) ORDER BY floor(x / 240 + 0.5), y, t) FILTER (kept), '') AS lines, avg(conf) FILTER (kept AND conf >= 75) AS conf, count(*) FILTER (NOT kept)::BIGINT AS dropped FROM k GROUP BY page""")
def ocr_english_lines(spark, sf):
    """English lines of a page read by machine, column by column."""
    b = table(spark, sf, "conversations").select(F.col("conv_id").alias("page"), "text", ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100).alias("conf"), ((F.col("turn") % 3) * 200).alias("x0"), (F.col("turn") * 50).alias("y0"))
    return D.english_lines(b, "page")


@query("glyph_reference", """
WITH w AS (SELECT l_returnflag AS font, l_linenumber AS size, (l_quantity + 10) / 50 AS width FROM lineitem), g AS (SELECT *, count(*) OVER p AS n, max(width) OVER p AS widest, row_number() OVER (PARTITION BY font, size ORDER BY width) AS k FROM w WINDOW p AS (PARTITION BY font, size)),
h AS (SELECT *, count(*) OVER p AS n, max(width) OVER p AS widest, row_number() OVER (PARTITION BY font ORDER BY width) AS k FROM w WINDOW p AS (PARTITION BY font))
SELECT font, size, width AS reference, n::BIGINT AS n FROM g WHERE n >= 12 AND k = floor(n * 0.05) + 1 AND width > 0 AND widest / width >= 1.35 UNION ALL SELECT font, NULL, width, n::BIGINT FROM h WHERE n >= 12 AND k = floor(n * 0.05) + 1 AND width > 0 AND widest / width >= 1.35""")
def glyph_reference(spark, sf):
    """The plain width of a glyph by font and size, and by font alone."""
    w = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("font"), F.col("l_linenumber").alias("size"), ((F.col("l_quantity") + 10) / 50).alias("width"))
    by_font = D.glyph_reference(w.select("font", "width"), ["font"]).select("font", F.lit(None).cast("int").alias("size"), "reference", "n")
    return D.glyph_reference(w, ["font", "size"]).select("font", F.col("size").cast("int").alias("size"), "reference", "n").union(by_font)


@query("review_counts", """
WITH {items}, {shown}, {mcqs}, {reviewed} SELECT format, count(*)::BIGINT AS questions, count(DISTINCT item_id)::BIGINT AS items FROM reviewed GROUP BY ALL""")
def review_counts(spark, sf):
    """Questions that may be asked, by format, and the items that have them."""
    r = reviewed(spark, sf).groupBy("format", "item_id").agg(F.count("*").alias("n"))
    return r.groupBy("format").agg(F.sum("n").alias("questions"), F.count("*").alias("items"))


#: Lines of banks that stand for questions: headings, sources and rows by the unit.
_BANK_LINES = (
    (29, "# Screening Test 20{y}"), (31, "## Section: Mains 20{y} Paper – II"), (43, "# Mains Paper 3 of 20{y}"), (17, "## Topic {u}"), (19, "## Duplicate of {u}"), (23, "### Part {u}"), (37, "*Source: `f{y}.pdf`*"),
    (7, "| {q} | What is {u}? | **a{u}**, b *(old)*, | Direct Recall (multi-select) |"), (5, "| {q} | Why {u}? | c | Negative Match |"), (1, "| {q} | How? | _d_, e{u} | Unheard of |"),
)
_BANK = f"""{{mcqs}}, lines AS (SELECT item_id // 200 AS file, mcq AS line_no, replace(replace(replace(CASE {" ".join(f"WHEN unit % {n} = 0 THEN '{t}'" for n, t in _BANK_LINES)} END, '{{y}}', (19 + unit % 3)::VARCHAR), '{{u}}', unit::VARCHAR), '{{q}}', (mcq % 150)::VARCHAR) AS value FROM mcqs),
hd AS (SELECT *, CASE WHEN regexp_matches(value, '{R_.BANK_PAPER}') THEN trim(regexp_extract(value, '{R_.BANK_PAPER}', 1)) WHEN regexp_matches(value, '{R_.BANK_TITLE}') THEN trim(regexp_extract(value, '{R_.BANK_TITLE}', 1)) END AS head FROM lines),
ev AS (SELECT *, count(head) OVER w AS block, last_value(head IGNORE NULLS) OVER w AS title,
  last_value(CASE WHEN head IS NOT NULL THEN '' WHEN NOT regexp_matches(value, '{R_.BANK_IGNORED}') AND regexp_matches(value, '{R_.BANK_SECTION}') THEN trim(regexp_extract(value, '{R_.BANK_SECTION}', 1)) WHEN regexp_matches(value, '{R_.BANK_PART}') THEN trim(regexp_extract(value, '{R_.BANK_PART}', 1)) END IGNORE NULLS) OVER w AS section,
  last_value(CASE WHEN head IS NOT NULL THEN false WHEN regexp_matches(value, '{R_.BANK_SECTION}') THEN regexp_matches(value, '{R_.BANK_IGNORED}') END IGNORE NULLS) OVER w AS ignored FROM hd WINDOW w AS (PARTITION BY file ORDER BY line_no)),
src AS (SELECT file, block, first(regexp_extract(value, '{R_.BANK_SOURCE}', 1) ORDER BY line_no) AS source FROM ev WHERE regexp_matches(value, '{R_.BANK_SOURCE}') GROUP BY file, block),
bank AS (SELECT file, line_no, title, section, source, 'g2-' || regexp_extract(title, '20[0-9]+') || CASE WHEN contains(title, 'Mains') THEN '-mains-paper-' || CASE WHEN contains(title, 'II') THEN 2 ELSE 3 END ELSE '-prelims-screening' END || '-bank' AS slug, regexp_extract(value, '{R_.BANK_ROW}', 1)::INT AS q_no, trim(regexp_extract(value, '{R_.BANK_ROW}', 2)) AS gloss,
  CASE WHEN contains(value, 'Direct') THEN 'a' || regexp_extract(value, 'a([0-9]+)[*][*]', 1) || ',b' WHEN contains(value, 'Negative') THEN 'c' ELSE 'd,' || regexp_extract(value, 'e[0-9]+') END AS keywords, CASE WHEN contains(value, 'Direct') THEN 'direct_recall' WHEN contains(value, 'Negative') THEN 'negative_statement' END AS format
  FROM ev LEFT JOIN src USING (file, block) WHERE block > 0 AND NOT ignored AND regexp_matches(value, '{R_.BANK_ROW}'))"""


def _bank(spark, sf):
    u = F.col("unit")
    value = F.lit(None).cast("string")
    for n, t in reversed(_BANK_LINES):
        value = F.when(u % n == 0, t).otherwise(value)
    for mark, c in (("{y}", 19 + u % 3), ("{u}", u), ("{q}", F.col("mcq") % 150)):
        value = F.replace(value, F.lit(mark), c.cast("string"))
    return R_.question_bank(mcqs(spark, sf).select(F.floor(F.col("item_id") / 200).alias("file"), F.col("mcq").alias("line_no"), value.alias("value")))


@query("bank_questions", f"WITH {_BANK}, k AS (SELECT *, row_number() OVER (PARTITION BY slug, q_no ORDER BY file, line_no) AS k FROM bank) SELECT slug, q_no, title, section, source, gloss, keywords, format FROM k WHERE k = 1")
def bank_questions(spark, sf):
    """Questions of Markdown banks under their papers, the first of each number."""
    b = R_.bank_questions(_bank(spark, sf))
    return b.select("slug", "q_no", "title", "section", "source", "gloss", F.array_join("keywords", ",").alias("keywords"), "format")


@query("bank_papers", f"""
WITH {_BANK}, n AS (SELECT slug, q_no, count(*) AS n FROM bank GROUP BY ALL), t AS (SELECT slug, string_agg(DISTINCT title, '|' ORDER BY title) AS titles, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM bank GROUP BY slug)
SELECT slug, sum(n)::BIGINT AS n, min(q_no) AS first_q, max(q_no) AS last_q, any_value(titles) AS titles, coalesce(any_value(sources), '') AS sources, count(*) FILTER (n > 1) AS twice FROM n JOIN t USING (slug) GROUP BY slug""")
def bank_papers(spark, sf):
    """Papers by their identity, whatever their headings, and how many of their numbers occur twice."""
    p = R_.bank_papers(_bank(spark, sf))
    return p.select("slug", "n", "first_q", "last_q", F.array_join("titles", "|").alias("titles"), F.array_join("sources", ",").alias("sources"), F.size("twice").cast("long").alias("twice"))
