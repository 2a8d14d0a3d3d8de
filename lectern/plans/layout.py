"""Queries over printed pages: questions stand for their blocks, with a place and a size made of their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lists as L
from lectern.operators import desk as D
from lectern.operators import genre as N
from lectern.operators import layout as G
from lectern.operators import segmentation as S
from lectern.plans.roles import mcqs, query

_BLOCKS = """{mcqs}, blocks AS (SELECT item_id // 20 AS doc, mcq % 10 AS page, mcq AS block, (unit % 12 * 50)::DOUBLE AS x0, (unit % 12 * 50 + 100 + unit % 3 * 60)::DOUBLE AS x1, (item_id % 20 * 40)::DOUBLE AS y0, (item_id % 20 * 40 + 20 + unit % 15)::DOUBLE AS y1,
  CASE WHEN unit % 5 = 0 THEN 18.0::DOUBLE WHEN unit % 11 = 0 THEN 7.0::DOUBLE ELSE 9.2::DOUBLE END AS size, CASE WHEN unit % 13 = 0 THEN '' WHEN unit % 17 = 0 THEN 'By someone' WHEN unit % 19 = 0 THEN 'Page of the day' WHEN unit % 23 = 0 THEN 'A' ELSE repeat('word ' || unit || ' ', (unit % 9 + 1)::INT) END AS text, unit FROM mcqs),
bs AS (SELECT doc, first(size ORDER BY chars DESC, size) AS body_size FROM (SELECT doc, floor(size * 2 + 0.5) / 2 AS size, sum(length(text)) AS chars FROM blocks GROUP BY doc, floor(size * 2 + 0.5) / 2) GROUP BY doc),
roles AS (SELECT b.*, CASE WHEN length(trim(text)) = 0 THEN 'noise' WHEN regexp_matches(text, '^Page of') THEN 'furniture' WHEN y0 <= 0 OR y0 >= 760 THEN 'furniture' WHEN length(text) <= 2 AND size / body_size >= 1.8 THEN 'dropcap' WHEN size / body_size >= 1.35 AND NOT regexp_matches(text, '[.!?]$') THEN 'headline'
  WHEN size / body_size >= 1.35 THEN 'secondary' WHEN regexp_matches(text, '^(?i:by )') THEN 'byline' WHEN size / body_size < 0.85 THEN 'caption' ELSE 'body' END AS role FROM blocks b JOIN bs USING (doc))"""

_OWNED = f"""{_BLOCKS},
h AS (SELECT doc, page, block AS owner, x0 AS hx0, x1 AS hx1, y1 AS hy FROM roles WHERE role = 'headline'), o AS (SELECT * FROM roles WHERE role NOT IN ('headline', 'noise', 'furniture')),
best AS (SELECT o.block, first(h.owner ORDER BY hy DESC, h.owner DESC) AS owner FROM o JOIN h ON h.doc = o.doc AND h.page = o.page AND hy <= y0 AND (x0 + x1) / 2 BETWEEN hx0 AND hx1 GROUP BY o.block),
owned AS (SELECT o.doc, o.page, o.block, best.owner FROM o LEFT JOIN best USING (block)),
c AS (SELECT o.doc, o.page, o.block, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, owned.owner FROM o JOIN owned USING (block)),
near AS (SELECT x.block, first(y.owner ORDER BY (x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy), y.owner) AS near FROM c x JOIN c y ON x.doc = y.doc AND x.page = y.page AND x.owner IS NULL AND y.owner IS NOT NULL AND (x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy) <= 140 * 140 GROUP BY x.block),
adopted AS (SELECT owned.doc, owned.page, owned.block, coalesce(owner, near) AS owner FROM owned LEFT JOIN near USING (block))"""


def _blocks(spark, sf):
    u, i = F.col("unit"), F.col("item_id")
    size = F.when(u % 5 == 0, 18.0).when(u % 11 == 0, 7.0).otherwise(9.2)
    text = F.when(u % 13 == 0, "").when(u % 17 == 0, "By someone").when(u % 19 == 0, "Page of the day").when(u % 23 == 0, "A").otherwise(F.repeat(F.concat(F.lit("word "), u.cast("string"), F.lit(" ")), (u % 9 + 1).cast("int")))
    d = lambda c: c.cast("double")
    return mcqs(spark, sf).select(F.floor(i / 20).alias("doc"), (F.col("mcq") % 10).alias("page"), F.col("mcq").alias("block"), d(u % 12 * 50).alias("x0"), d(u % 12 * 50 + 100 + u % 3 * 60).alias("x1"), d(i % 20 * 40).alias("y0"), d(i % 20 * 40 + 20 + u % 15).alias("y1"), size.alias("size"), text.alias("text"), "unit")


def _roles(spark, sf):
    return G.roles(_blocks(spark, sf), running=("^Page of",), strips=(0, 760))


def _owned(spark, sf):
    return G.owners(_roles(spark, sf).filter("role not in ('noise', 'furniture')"))


@query("layout_statistics", f"""
WITH {_BLOCKS}, w AS (SELECT doc, first(width ORDER BY n DESC, width DESC) AS column_width FROM (SELECT doc, floor((x1 - x0) / 5 + 0.5) * 5 AS width, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY doc)
SELECT doc, body_size, column_width::BIGINT AS column_width FROM bs JOIN w USING (doc)""")
def layout_statistics(spark, sf):
    """The body's font size and the commonest column width of each document."""
    b = _blocks(spark, sf)
    return G.body_size(b).join(G.column_width(b), "doc").select("doc", "body_size", F.col("column_width").cast("long").alias("column_width"))


@query("block_roles", f"WITH {_BLOCKS} SELECT doc, page, block, role FROM roles")
def block_roles(spark, sf):
    """What each block of a page is."""
    return _roles(spark, sf).select("doc", "page", "block", "role")


@query("block_owners", f"WITH {_OWNED} SELECT doc, page, block, owner FROM owned")
def block_owners(spark, sf):
    """The headline that each block stands under."""
    return _owned(spark, sf)


@query("orphans_adopted", f"WITH {_OWNED} SELECT doc, page, block, owner FROM adopted")
def orphans_adopted(spark, sf):
    """Blocks under no headline go with the nearest one that is."""
    return G.adopted(_roles(spark, sf), _owned(spark, sf))


@query("page_articles", f"""
WITH {_OWNED}, t AS (SELECT a.doc, a.page, a.owner, string_agg(text, chr(10) ORDER BY floor(x0 / 240), y0, a.block) AS text FROM adopted a JOIN roles USING (block) WHERE a.owner IS NOT NULL GROUP BY ALL) SELECT doc, page, owner, text FROM t WHERE length(text) >= 140""")
def page_articles(spark, sf):
    """Articles of a page, column by column."""
    return G.page_articles(_roles(spark, sf).filter("role not in ('noise', 'furniture')"))


@query("jump_links", f"""
WITH {_BLOCKS}, h AS (SELECT doc, page, block AS id, ['w' || unit % 4, 'v' || unit % 3, 'u' || unit % 5] AS words, CASE WHEN unit % 3 = 0 THEN (page + 1) % 10 END AS to_page FROM roles WHERE role = 'headline'),
s AS (SELECT a.id, b.id AS next, row_number() OVER (PARTITION BY a.id ORDER BY len(list_intersect(a.words, b.words)) DESC, b.id) AS k FROM h a JOIN h b ON a.doc = b.doc AND a.to_page = b.page AND a.id <> b.id WHERE len(list_intersect(a.words, b.words)) >= 2) SELECT id, next FROM s WHERE k = 1""")
def jump_links(spark, sf):
    """Where an article goes on: the headline of the named page that shares most words with its own."""
    part = lambda x, n: F.concat(F.lit(x), (F.col("unit") % n).cast("string"))
    h = _roles(spark, sf).filter("role = 'headline'").select("doc", "page", F.col("block").alias("id"), F.array(part("w", 4), part("v", 3), part("u", 5)).alias("words"), F.when(F.col("unit") % 3 == 0, (F.col("page") + 1) % 10).alias("to_page"))
    return G.jumps(h)


_Q = lambda p: p.replace("'", "''")
#: What some blocks of the test's pages print: running heads, labels, turns and disclaimers.
_PRINTED = (
    (31, "FROM THE ARCHIVES"), (37, "LETTERS TO THE EDITOR"), (41, "PARLEY"), (43, "NOTEBOOK"), (47, "So it is. The views expressed are personal."), (53, "BC: Why? AS: So. BC: It is. Buddha Chandrasekhar: End."), (59, "Won by 5 runs"),
    (3, "THE HINDU 6 Friday, August 21, 2026 Vijayawada Editorial"), (4, "7 Vijayawada Business & Trade"), (10, "Chennai Opinion"), (14, "Vijayawada Municipal Corporation said on 5 May"),
)
_TOLD = f"""{_OWNED},
told AS (SELECT * REPLACE (CASE {" ".join(f"WHEN unit % {n} = 0{' AND y0 <= 160' if len(t) > 20 and n < 20 else ''} THEN '{t}'" for n, t in _PRINTED)} ELSE text END AS text) FROM roles),
sec AS (SELECT doc, page, first(s ORDER BY length(s), block) AS section FROM (SELECT doc, page, block, trim(regexp_replace(bare, '{_Q(L.EDITION_CITY)}', '')) AS s FROM (SELECT *, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '{_Q(L.HEAD_PREFIX)}', '') AS bare FROM told WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 90 AND y0 <= 130) WHERE regexp_matches(bare, '{_Q(L.EDITION_CITY)}'))
  WHERE length(s) <= 28 AND regexp_matches(s, '{_Q(L.SECTION_NAME)}') GROUP BY doc, page),
art AS (SELECT h.doc, h.page, h.block AS id, h.x0, h.y0, h.x1, h.text AS headline, string_agg(o.text, ' ' ORDER BY o.y0, o.block) FILTER (o.role = 'body') AS body, string_agg(o.text, ' ' ORDER BY o.y0, o.block) FILTER (o.role IN ('caption', 'secondary')) AS other, max(o.text) FILTER (o.role = 'byline') AS byline
  FROM told h LEFT JOIN owned w ON w.owner = h.block LEFT JOIN told o ON o.block = w.block WHERE h.role = 'headline' GROUP BY h.doc, h.page, h.block, h.x0, h.y0, h.x1, h.text),
mk AS (SELECT * FROM (SELECT doc, page, block, x0, x1, y1, CASE {" ".join(f"WHEN regexp_matches(text, '{p}') THEN '{g}|{n}'" for g, n, p in L.MARKERS)} END AS mark FROM told WHERE length(text) <= 70) WHERE mark IS NOT NULL),
lab AS (SELECT id, first(mark ORDER BY art.y0 - mk.y1, mk.block) AS mark FROM art JOIN mk ON art.doc = mk.doc AND art.page = mk.page AND art.y0 - mk.y1 BETWEEN -4 AND 40 AND NOT mk.x0 > art.x1 + 12 AND NOT mk.x1 < art.x0 - 12 GROUP BY id),
g0 AS (SELECT art.*, section, mark, coalesce(headline, '') || ' ' || coalesce(other, '') || ' ' || coalesce(body, '') AS whole FROM art LEFT JOIN sec USING (doc, page) LEFT JOIN lab USING (id)),
g1 AS (SELECT *, coalesce(mark, CASE {" ".join(f"WHEN regexp_matches(whole, '{p}') THEN '{g}|{n}'" for g, n, p in L.MARKERS)} END) AS named FROM g0),
genres AS (SELECT doc, page, id, headline, body, section, CASE WHEN named IS NOT NULL THEN split_part(named, '|', 1) WHEN len(regexp_extract_all(coalesce(body, ''), '{_Q(L.TURN)}')) >= 3 AND contains(body, '?') THEN 'interview' WHEN regexp_matches(coalesce(body, ''), '{_Q(L.PERSONAL_VIEWS)}') THEN 'oped' WHEN regexp_matches(coalesce(section, ''), '{_Q(L.OPINION_SECTION)}') THEN CASE WHEN byline <> '' THEN 'oped' ELSE 'editorial' END ELSE 'report' END AS genre,
  CASE WHEN named IS NOT NULL THEN 'page label ' || split_part(named, '|', 2) WHEN len(regexp_extract_all(coalesce(body, ''), '{_Q(L.TURN)}')) >= 3 AND contains(body, '?') THEN 'question-and-answer transcript' WHEN regexp_matches(coalesce(body, ''), '{_Q(L.PERSONAL_VIEWS)}') THEN 'carries the paper’s "views expressed are personal" line' WHEN regexp_matches(coalesce(section, ''), '{_Q(L.OPINION_SECTION)}') THEN CASE WHEN byline <> '' THEN 'signed' ELSE 'unsigned' END || ' piece on the ' || section || ' page' WHEN section <> '' THEN section || ' page' ELSE 'no contrary signal' END AS why FROM g1)"""


def _told(spark, sf):
    u, text = F.col("unit"), F.col("text")
    for n, t in reversed(_PRINTED):
        at = (u % n == 0) & (F.col("y0") <= 160) if len(t) > 20 and n < 20 else u % n == 0
        text = F.when(at, t).otherwise(text)
    return _roles(spark, sf).withColumn("text", text)


def _genres(spark, sf):
    told = _told(spark, sf)
    parts = told.join(_owned(spark, sf).filter("owner is not null"), ["doc", "page", "block"])
    joined = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(role, F.struct("y0", "block", "text")))), lambda x: x["text"]), " ")
    role = F.col("role")
    bodies = parts.groupBy(F.col("owner").alias("id")).agg(joined(role == "body").alias("body"), joined(role.isin("caption", "secondary")).alias("other"), F.max(F.when(role == "byline", F.col("text"))).alias("byline"))
    heads = told.filter("role = 'headline'").select("doc", "page", F.col("block").alias("id"), "x0", "y0", "x1", F.col("text").alias("headline"))
    a = N.labelled(heads, told).join(bodies, "id", "left").join(N.sections(told), ["doc", "page"], "left")
    whole = F.concat_ws(" ", "headline", "other", "body")
    return a.withColumn("g", N.genre_of(F.col("body"), whole, F.col("byline"), F.col("section"), F.col("marker"), F.col("label"))).select("doc", "page", "id", "headline", "body", "section", "g.genre", "g.why")


@query("page_genres", f"WITH {_TOLD} SELECT doc, page, id, section, genre, why FROM genres")
def page_genres(spark, sf):
    """What kind of piece each article of a page is, and why."""
    return _genres(spark, sf).select("doc", "page", "id", "section", "genre", "why")


@query("genre_veto", f"""
WITH {_TOLD} SELECT id, genre, CASE WHEN genre = 'letters' THEN 'letters to the editor' WHEN genre = 'archive' THEN 'from the archives' WHEN regexp_matches(coalesce(headline, '') || ' ' || coalesce(body, ''), '{_Q(L.SPORT_REPORT)}') THEN 'sport match report' END AS veto, genre IN ('editorial', 'oped', 'interview', 'column') AS opinion, length(regexp_replace(coalesce(body, ''), '{_Q(L.DISCLAIMER)}', '', 'g')) AS chars FROM genres""")
def genre_veto(spark, sf):
    """The veto of each article of a page, its genre first; whether it is opinion, and its length without the paper's disclaimer."""
    head, body = F.col("headline"), F.coalesce("body", F.lit(""))
    veto = D.vetoed(head, body, (), L.SPORT_REPORT, L.SPORT_EXEMPT, L.SPORT_EVENT, genre=F.col("genre"))
    return _genres(spark, sf).select("id", "genre", veto.alias("veto"), N.is_opinion(F.col("genre")).alias("opinion"), F.length(N.without_disclaimer(body)).cast("long").alias("chars"))


_PROFILE = S.Profile(top=0.0, bottom=760.0, running=("^Page of",), noise=("^Advert",), classified=("^To let",), titles=("^In the news",))
_CLEAN = "trim(regexp_replace(regexp_replace(translate(replace(coalesce({0}, ''), '­', ''), '‘’“”', '''''\"\"'), '([a-z])-[ \\t]*\\n[ \\t]*([a-z])', '\\1\\2', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_FRAGMENT = "regexp_matches({0}, '^[a-z]') AND NOT regexp_matches({0}, '^[a-z]{{2,}}\\s+[A-Z]')"
_JUMP = _Q(S.JUMP_ONLY)
#: What the blocks of the test's pages print when stories are told apart: headlines, quotations, fragments, single letters, pointers.
_LARGE = ("Story of the unit {} in words", "A quoted line of {}.", "and the rest of {}", "Short {}", "A", "In the news of {} all", "eBay opens {} shops, it says", "and so on {}")
_ODD = ((47, "CONTINUED ON » PAGE 7"), (53, "It is so. BUDGET DAY » PAGE 4 CONTINUED ON » PAGE 5"), (37, "By a Writer AMARAVATI"), (41, "inter-\nnational “word” of a sto­ry"), (43, "Advert of the day"), (59, "To let: a house"))
_SEGMENTS = f"""{_BLOCKS},
seg AS (SELECT doc, page, block, x0, y0, x1, y1, size, CASE {" ".join(f"WHEN unit % {n} = 0 AND size < 10 THEN '{t}'" for n, t in _ODD)} WHEN unit % 5 = 0 THEN replace([{", ".join(f"'{t}'" for t in _LARGE)}][unit // 5 % {len(_LARGE)} + 1], '{{}}', unit::VARCHAR) ELSE text END AS text FROM blocks),
c0 AS (SELECT * REPLACE ({_CLEAN.format("text")} AS text) FROM seg),
c1 AS (SELECT * FROM c0 WHERE text <> ''),
z AS (SELECT doc, page, first(v ORDER BY n DESC, f) AS body_size FROM (SELECT doc, page, floor(size * 2 + 0.5) / 2 AS v, sum(length(text)) AS n, min(block) AS f FROM c1 GROUP BY ALL) GROUP BY doc, page),
c2 AS (SELECT *, CASE WHEN regexp_matches(text, '^Advert') THEN 'noise' WHEN regexp_matches(text, '^Page of') THEN 'furniture' WHEN regexp_matches(text, '^To let') THEN 'classified' WHEN y0 <= 0 OR y0 >= 760 THEN 'furniture' WHEN size / body_size >= 1.35 THEN CASE WHEN length(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')) <= 2 AND size / body_size >= 1.8 THEN 'dropcap' WHEN regexp_matches(text, '^In the news') THEN 'pagetitle'
  WHEN size >= 13 AND length(text) BETWEEN 12 AND 220 AND NOT ({_FRAGMENT.format("text")}) AND NOT regexp_matches(text, '[.!?]$') THEN 'headline' ELSE 'secondary' END WHEN regexp_matches(text, '^(?i:by )') THEN 'byline' WHEN size / body_size < 0.85 THEN 'caption' ELSE 'body' END AS first_role FROM c1 JOIN z USING (doc, page)),
c3 AS (SELECT *, CASE WHEN first_role <> 'headline' AND regexp_matches(text, '{_JUMP}') THEN 'jumpline' ELSE first_role END AS role FROM c2),
free AS (SELECT b.*, row_number() OVER (PARTITION BY doc, page ORDER BY block) AS k FROM c3 b WHERE role = 'dropcap' AND NOT EXISTS (SELECT 1 FROM c3 h WHERE h.role = 'headline' AND h.doc = b.doc AND h.page = b.page AND h.y1 <= b.y0 + 4 AND (b.x0 + b.x1) / 2 BETWEEN h.x0 - 14 AND h.x1 + 14)),
lines AS (SELECT doc, page, list({{'y': -y0, 'block': block, 'y0': y0, 'x0': x0, 'x1': x1, 'text': text}} ORDER BY -y0, block) AS lines FROM c3 WHERE role = 'secondary' GROUP BY doc, page),
fold(doc, page, k, taken, heads) AS (SELECT doc, page, 0::BIGINT, []::BIGINT[], []::STRUCT(block BIGINT, told VARCHAR)[] FROM lines
  UNION ALL SELECT doc, page, k, CASE WHEN hit > 0 THEN list_concat(taken, list_transform(up[1:hit], lambda s: s.block)) ELSE taken END, CASE WHEN hit > 0 THEN list_append(heads, {{'block': up[hit].block, 'told': array_to_string(list_concat([up[hit].text], list_transform(list_reverse(up[1:hit - 1]), lambda s: s.text)), ' ')}}) ELSE heads END
  FROM (SELECT *, list_position(list_transform(up, lambda s: {_FRAGMENT.format("s.text")}), false) AS hit FROM (SELECT f.doc, f.page, c.k, f.taken, f.heads, list_filter(l.lines, lambda s: NOT list_contains(f.taken, s.block) AND s.y0 < c.y0 AND c.y0 - s.y0 <= 90 AND s.x0 < c.x1 + 14 AND s.x1 > c.x0 - 14) AS up FROM fold f JOIN free c ON c.doc = f.doc AND c.page = f.page AND c.k = f.k + 1 JOIN lines l ON l.doc = f.doc AND l.page = f.page))),
last AS (SELECT doc, page, arg_max(taken, k) AS taken, arg_max(heads, k) AS heads FROM fold GROUP BY doc, page),
up AS (SELECT b.* REPLACE (CASE WHEN list_contains(taken, block) THEN CASE WHEN len(list_filter(heads, lambda h: h.block = b.block)) > 0 THEN 'headline' ELSE 'noise' END ELSE role END AS role, coalesce(list_filter(heads, lambda h: h.block = b.block)[1].told, text) AS text) FROM c3 b LEFT JOIN last USING (doc, page)),
cw AS (SELECT doc, page, first(v ORDER BY n DESC, f) AS cw FROM (SELECT doc, page, floor((x1 - x0) / 5 + 0.5) * 5 AS v, count(*) AS n, min(block) AS f FROM up WHERE role = 'body' AND floor((x1 - x0) / 5 + 0.5) * 5 > 0 GROUP BY ALL) GROUP BY doc, page),
gd AS (SELECT up.* REPLACE (CASE WHEN role = 'body' AND coalesce(x1 - x0 > cw * 3, false) THEN 'merged' ELSE role END AS role) FROM up LEFT JOIN cw USING (doc, page)),
st AS (SELECT * FROM gd WHERE role NOT IN ('noise', 'furniture', 'pagetitle', 'classified', 'merged')),
ow AS (SELECT b.doc, b.page, b.block, first(h.block ORDER BY h.y1 DESC, h.y0, h.block) AS owner FROM st b LEFT JOIN st h ON h.role = 'headline' AND h.doc = b.doc AND h.page = b.page AND h.y1 <= b.y0 + 4 AND (b.x0 + b.x1) / 2 BETWEEN h.x0 - 14 AND h.x1 + 14 WHERE b.role <> 'headline' GROUP BY b.doc, b.page, b.block),
rg AS (SELECT doc, page, list({{'top': top, 'owner': owner, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY top, owner) AS regions FROM (SELECT p.doc, p.page, p.owner, max(p.top) AS top, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT doc, page, block AS owner, y0 AS top, x0, y0, x1, y1 FROM st WHERE role = 'headline' UNION ALL SELECT st.doc, st.page, owner, NULL, x0, y0, x1, y1 FROM st JOIN ow USING (doc, page, block) WHERE owner IS NOT NULL AND role = 'body') p GROUP BY ALL) GROUP BY doc, page),
orp AS (SELECT st.*, row_number() OVER (PARTITION BY doc, page ORDER BY block) AS k FROM st JOIN ow USING (doc, page, block) WHERE owner IS NULL),
join_(doc, page, k, regions, block, near) AS (SELECT doc, page, 0::BIGINT, regions, NULL::BIGINT, NULL::BIGINT FROM rg
  UNION ALL SELECT doc, page, k, CASE WHEN n.gap <= 140 AND role = 'body' THEN list_transform(regions, lambda r, i: CASE WHEN i = n.i THEN {{'top': r.top, 'owner': r.owner, 'x0': least(r.x0, x0), 'y0': least(r.y0, y0), 'x1': greatest(r.x1, x1), 'y1': greatest(r.y1, y1)}} ELSE r END) ELSE regions END, block, CASE WHEN n.gap <= 140 THEN regions[n.i].owner END
  FROM (SELECT o.doc, o.page, o.k, j.regions, o.block, o.role, o.x0, o.y0, o.x1, o.y1, list_sort(list_transform(j.regions, lambda r, i: {{'gap': sqrt(pow(greatest(0, r.x0 - o.x1, o.x0 - r.x1), 2) + pow(greatest(0, r.y0 - o.y1, o.y0 - r.y1), 2)), 'i': i}}))[1] AS n FROM join_ j JOIN orp o ON o.doc = j.doc AND o.page = j.page AND o.k = j.k + 1)),
fin AS (SELECT st.*, coalesce(ow.owner, near) AS owner, ow.owner IS NULL AS late FROM st JOIN ow USING (doc, page, block) LEFT JOIN (SELECT * FROM join_ WHERE block IS NOT NULL) j USING (doc, page, block)),
pt AS (SELECT f.doc, f.page, f.owner AS id, string_agg(f.text, ' ' ORDER BY floor(f.x0 / 24 + 0.5) * 24, f.y0, late, f.block) FILTER (f.role = 'body') AS body, list(f.text ORDER BY late, f.block) FILTER (f.role = 'jumpline') AS jumps, list(f.text ORDER BY f.y0, late, f.block) FILTER (f.role = 'byline') AS bylines, first(f.text ORDER BY late, f.block) FILTER (f.role = 'secondary' AND f.y0 - h.y1 BETWEEN 0 AND 60) AS standfirst,
  count(*) FILTER (f.role = 'dropcap') AS caps, count(*) FILTER (f.role = 'caption') AS captions, count(*) FILTER (f.role = 'body') AS n_blocks FROM fin f JOIN gd h ON h.block = f.owner AND h.doc = f.doc AND h.page = f.page WHERE f.owner IS NOT NULL GROUP BY ALL),
nt AS (SELECT *, regexp_replace(coalesce(body, ''), '{_Q(S.POINTER)}', ' ', 'g') AS t FROM pt),
parts AS (SELECT *, {_CLEAN.format("CASE WHEN caps > 0 AND regexp_matches(t, '^[a-z]') THEN 'A' || t ELSE t END")} AS told, list_concat(flatten(list_transform(coalesce(jumps, []), lambda x: regexp_extract_all(x, '{_Q(S.CONTINUATION)}', 1))), regexp_extract_all(coalesce(body, ''), '{_Q(S.CONTINUATION)}', 1))[1]::INT AS continues_on FROM nt),
art AS (SELECT p.doc, p.page, p.id, h.text AS headline, coalesce(standfirst, '') AS standfirst, coalesce(bylines[1], '') AS byline, told, n_blocks, captions, continues_on, floor(h.size / h.body_size * 100 + 0.5) / 100 AS prominence FROM parts p JOIN gd h ON h.block = p.id AND h.doc = p.doc AND h.page = p.page WHERE length(told) >= 140)"""


def _segment_blocks(spark, sf):
    u = F.col("unit")
    text = F.when(u % 5 == 0, F.replace(F.get(F.array(*[F.lit(t) for t in _LARGE]), (F.floor(u / 5) % len(_LARGE)).cast("int")), F.lit("{}"), u.cast("string"))).otherwise(F.col("text"))
    for n, t in reversed(_ODD):
        text = F.when((u % n == 0) & (F.col("size") < 10), t).otherwise(text)
    return _blocks(spark, sf).withColumn("text", text).drop("unit")


@query("page_segments", f"WITH RECURSIVE {_SEGMENTS} SELECT doc, page, block, role, text FROM gd")
def page_segments(spark, sf):
    """Roles once drop caps have made headlines of the lines above them and blocks over several columns are out."""
    return S.guarded(S.promoted(S.classified(_segment_blocks(spark, sf), _PROFILE))).select("doc", "page", "block", "role", "text")


@query("segmented_articles", f"WITH RECURSIVE {_SEGMENTS} SELECT doc, page, id, headline, standfirst, CASE byline WHEN 'By a Writer AMARAVATI' THEN 'By a Writer' ELSE byline END AS byline, CASE byline WHEN 'By a Writer AMARAVATI' THEN 'AMARAVATI' ELSE '' END AS dateline, sha256(told) AS body, length(told)::BIGINT AS chars, n_blocks, captions, continues_on, prominence FROM art")
def segmented_articles(spark, sf):
    """Articles of pages with all their parts."""
    a = S.segmented(_segment_blocks(spark, sf), _PROFILE)
    return a.select("doc", "page", "id", "headline", "standfirst", "byline", "dateline", F.sha2(F.col("body").cast("binary"), 256).alias("body"), "chars", "n_blocks", F.size("captions").cast("long").alias("captions"), "continues_on", "prominence")


_HEADED = f"""hd AS (SELECT doc, page, block, (page - CASE unit % 4 WHEN 0 THEN -1 WHEN 1 THEN 2 ELSE doc % 3 END)::INT AS n FROM blocks WHERE unit % 3 = 0),
vt AS (SELECT doc, page - n AS shift, count(*) AS votes, min(page) AS first_page FROM (SELECT doc, page, first(n ORDER BY block) AS n FROM hd WHERE n >= 0 GROUP BY doc, page) WHERE page - n >= 0 GROUP BY doc, page - n),
off AS (SELECT d.doc, CASE WHEN max(votes) >= 3 THEN first(shift ORDER BY votes DESC, first_page) ELSE 0 END::INT AS page_offset FROM (SELECT DISTINCT doc FROM blocks) d LEFT JOIN vt USING (doc) GROUP BY d.doc)"""


def _offsets(spark, sf):
    u, page = F.col("unit"), F.col("page")
    n = (page - F.when(u % 4 == 0, -1).when(u % 4 == 1, 2).otherwise(F.col("doc") % 3)).cast("int")
    head = F.when((u % 3 == 0) & (n >= 0), F.concat(F.lit("THE HINDU  "), n.cast("string"), F.lit(" Friday, August 21, 2026"))).otherwise(F.lit("none"))
    return S.page_offset(_blocks(spark, sf).select("doc", "page", "block", head.alias("text")))


@query("page_offsets", f"WITH {_BLOCKS}, {_HEADED} SELECT doc, page_offset FROM off")
def page_offsets(spark, sf):
    """By how much the pages of each document are numbered apart from what they print."""
    return _offsets(spark, sf)


@query("jump_targets", f"WITH RECURSIVE {_SEGMENTS}, {_HEADED} SELECT art.doc, art.page, id, (art.page - page_offset)::BIGINT AS printed_page, (continues_on + page_offset)::INT AS continues_on_file FROM art JOIN off USING (doc)")
def jump_targets(spark, sf):
    """Where articles are printed, and the page of the file on which they go on."""
    a = S.numbered(S.segmented(_segment_blocks(spark, sf), _PROFILE), _offsets(spark, sf))
    return a.select("doc", "page", "id", "printed_page", "continues_on_file")
