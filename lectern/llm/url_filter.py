"""URL filters with redirect equivalence.

Rules are matched by host suffix and path prefix, the longest winning. Pages that redirect to
one another, or name one another canonical, are one resource: connected components over
those links carry a block to the pages that no rule fits. An explicit allow takes
precedence: it holds for its own page, and for the unmatched aliases of a resource that has one.

A resource is a host, path and query; rules look at host and path alone. Links are resolved against the page's URL.

A null URL, or one without ://, has an empty host and path and no aliases, and is allowed; null html has no links;
repeated rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import connected_components

#: The rules of the contract, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The link patterns of the SQL form; they miss what ``targets`` also reads.
LINKS = (
    r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*\bhref\s*=\s*["']([^"']+)["']""",
    r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*\brel\s*=\s*["']?canonical""",
    r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*\burl\s*=\s*([^"'>\s;]+)""",
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as (rule, verdict); null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; '' if there is none."""
    at = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, at, k) for k in (1, 2, 3)]))


def targets(html: Column) -> Column:
    """Where a page says that it is another one: hrefs of canonical links and urls of refreshes, in any order of attributes."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*"), 0)
    canonical = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    url = r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s>]+))"""
    to = lambda t: F.concat(*[F.regexp_extract(_attribute(t, "content"), url, k) for k in (1, 2, 3)])
    found = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, to))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.trim(x), "(?i)&amp;", "&")))


def plain_path(path: Column) -> Column:
    """``path`` without . and .. segments."""
    parts = F.split(F.regexp_replace(path, r"^/|(?<=/)\.\.?$", ""), "/")
    up = F.when(path.rlike(r"/\.\.$"), F.lit("..")).otherwise(F.lit("."))
    # A last . or .. leaves the folder: its name goes and its slash stays.
    parts = F.when(path.rlike(r"/\.\.?$"), F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(up, F.lit("")))).otherwise(parts)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """The resource of a URL: host, path and query; '' for none."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]+)", 1), F.lit(""))
    return F.concat(host_of(url), plain_path(path_of(url)), query)


def resolved(url: Column, to: Column) -> Column:
    """``to`` as a URL, seen from ``url``; null for what is no web address."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    out = F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
    out = out.when(to.startswith("//"), F.concat(scheme, to)).when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path_of(url), to))
    return out.when((to == "") | to.startswith("#"), url).otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))


def links_of(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) between resources that pages declare in their html."""
    named = F.col("html").ilike("%canonical%") | F.col("html").ilike("%refresh%")
    found = pages.filter(named).filter(F.col("url").contains("://")).select("url", F.explode(targets(F.col("html"))).alias("to"))
    return found.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("url"), F.col("to"))).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").distinct()


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row; ``redirects``: more edges, as (from_url, to_url)."""
    edges = links_of(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")), node_of(F.col("to_url"))).filter("from_url is not null and to_url is not null"))
    aliases = connected_components(edges)
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.nullif(node_of(F.col("url")), F.lit("")).alias("node"))
    p = p.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # A resource is judged by the rules itself, whether or not it was fetched.
    bare = F.substring_index("node", "?", 1)
    node_host, node_path = F.substring_index(bare, "/", 1), F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)
    said = aliases.withColumn("said", rule_of(node_host, node_path, rules)["verdict"])
    decided = said.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    heard = aliases.join(decided, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("heard"))
    # Pages without a node hear of nothing: they are not dealt by their null.
    told = lambda df, heard: df.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", heard, F.lit("allow")).alias("verdict"))
    return told(p.filter("node is not null").join(heard, "node", "left"), F.col("heard")).union(told(p.filter("node is null"), F.lit(None).cast("string")))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _sql_rule(host: str, path: str, what: int) -> str:
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        at, slash, rest = rule.partition("/")
        whens.append(f"WHEN ({host} = '{at}' OR ends_with({host}, '.{at}')) AND starts_with({path}, '{slash}{rest}') THEN '{(rule, verdict)[what]}'")
    return f"CASE {' '.join(whens)} END"


_HOST, _PATH = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), '" + UPPER + "', '" + LOWER + "')", "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FOUND = " UNION ".join("SELECT url, unnest(regexp_extract_all(html, '" + p.replace("'", "''") + "', 1)) AS target FROM pages" for p in LINKS)
OP6_SQL = f"""
WITH RECURSIVE found AS ({_FOUND}),
links AS (SELECT {_HOST.format("url")} || {_PATH.format("url")} AS src,
  CASE WHEN contains(target, '://') THEN {_HOST.format("target")} || {_PATH.format("target")}
       WHEN starts_with(target, '/') THEN {_HOST.format("url")} || regexp_extract(target, '^([^?#]*)', 1) END AS dst FROM found),
edges AS (SELECT src, dst FROM links WHERE src <> '' AND dst <> '' UNION SELECT dst, src FROM links WHERE src <> '' AND dst <> ''),
reach(node, other) AS (SELECT src, src FROM edges UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON e.src = r.other),
said AS (SELECT node, {_sql_rule("split_part(other, '/', 1)", "substr(other, length(split_part(other, '/', 1)) + 1)", 1)} AS said FROM reach),
heard AS (SELECT node, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' ELSE 'allow' END AS heard FROM said GROUP BY node),
p AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages)
SELECT page_id, host, path, {_sql_rule("host", "path", 0)} AS rule, coalesce({_sql_rule("host", "path", 1)}, heard, 'allow') AS verdict
FROM p LEFT JOIN heard ON heard.node = p.host || p.path
"""
