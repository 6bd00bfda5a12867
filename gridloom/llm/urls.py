"""URL filters with redirect equivalence.

Rules name a host and a path. Urls that redirect to each other, or name each other as canonical,
are aliases: distributed connected components over these links carry block decisions to aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, let
from .graph import components

#: The rules of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: The parts of a reference as RFC 3986 has them (scheme, authority, path, query).
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
#: What is no markup, and the tags and attributes that name another url.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)"
CANONICAL = (r"(?is)<link\b[^>]*>", r"""(?is)[\s"'/]rel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)""", r"""(?is)[\s"'/]href\s*=\s*["']?([^"'\s>]+)""")
REFRESH = (r"(?is)<meta\b[^>]*>", r"""(?is)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""")


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def without_dots(path: Column) -> Column:
    """A path from the root without its . and .. segments, as RFC 3986 removes them."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    ends = F.when(path.rlike(r"/\.\.?\z"), "/").otherwise("")
    whole = let(kept, lambda a: F.concat(F.lit("/"), F.array_join(a, "/"), F.when(F.size(a) > 0, ends).otherwise("")))
    return F.when(F.contains(path, F.lit("/.")), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """The url as an alias is matched: scheme and host in lower case, no dot segments, no fragment."""
    path = _part(url, 3)
    path = F.when(path == "", "/").otherwise(without_dots(path))
    return F.when(F.locate("://", url) > 0, F.concat(F.lower(_part(url, 1)), F.lit("://"), F.translate(_part(url, 2), UPPER, LOWER), path, _part(url, 4)))


def resolved(base: Column, target: Column) -> Column:
    """What a reference names when it stands in a document at `base`."""
    path, folder = _part(target, 3), F.regexp_extract(_part(base, 3), r"(?s)^(.*/)", 1)
    merged = F.when(path == "", _part(base, 3)).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    query = F.when((path == "") & ~F.contains(target, F.lit("?")), _part(base, 4)).otherwise(_part(target, 4))
    within = F.concat(_part(base, 1), F.lit("://"), _part(base, 2), merged, query)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(_part(base, 1), F.lit(":"), target)).otherwise(within)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page's url, and the urls that it names as canonical or refreshes to.

    References are resolved by RFC 3986; comments, scripts and styles name none. A null url or html,
    or a url without ://, has no links.
    """
    h = F.col(html)
    named = pages.where(F.lower(h).contains("canonical") | F.lower(h).contains("refresh")).select(F.col(url).alias("__u"), F.regexp_replace(h, NO_MARKUP, " ").alias("__h"))
    of = lambda tag, test, value: F.transform(F.filter(F.regexp_extract_all("__h", F.lit(tag), F.lit(0)), lambda t: t.rlike(test)), lambda t: F.regexp_extract(t, value, 1))
    named = named.select("__u", F.explode(F.concat(of(*CANONICAL), of(*REFRESH))).alias("__t")).where("__t != ''")
    target = F.replace("__t", F.lit("&amp;"), F.lit("&"))
    return named.select(node_of(F.col("__u")).alias("a"), node_of(resolved(F.col("__u"), target)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, host, path)")


def matched(scratch: Scratch, urls: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """urls (with __host and __path) and __hit, the longest rule that fits, or null.

    Each distinct host is split into its suffixes once and meets the rules of the same host; urls
    then meet the rules of their host. The longest rule wins; of equally long ones, block.
    """
    one = rules.select(F.col("host").alias("__suffix"), F.struct((F.length("host") + F.length("path")).alias("size"), (F.col("action") == "block").alias("block"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), F.col("action").alias("action")).alias("__rule"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("__host").distinct().withColumn("__suffix", F.explode(suffixes))
    fits = hosts.join(one, "__suffix").groupBy("__host").agg(F.sort_array(F.collect_set("__rule"), asc=False).alias("__rules"))
    fits = scratch.table(fits, f"fits_{name}")
    hit = F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), F.lit(0))
    return urls.join(fits, "__host", "left").withColumn("__hit", hit).drop("__rules")


def judge(pages: DataFrame, edges: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A url's own rule decides. A url without a rule takes its aliases' decision: allow if a rule
    allows one of them, else block if a rule blocks one, else allow. `edges` (a, b) are pairs of
    node_of() values; they may name urls that are not in pages, whose rules count too. A null url,
    or one without ://, has an empty host and path and no alias, hence is allowed. Repeated rows
    are judged alike; columns named host, path, rule or verdict are replaced; empty tables are fine.
    """
    spark = pages.sparkSession
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    with Scratch(spark) as scratch:
        edges = scratch.table(edges.select("a", "b"), "links")
        roots = scratch.table(components(scratch, edges), "roots")
        nodes = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root")).distinct()
        nodes = scratch.table(nodes, "nodes")
        ruled = matched(scratch, nodes.withColumns({"__host": host_of(F.col("node")), "__path": path_of(F.col("node"))}), rules, "nodes")
        decided = ruled.groupBy("root").agg(F.max(F.col("__hit.action") == "allow").alias("allowed"), F.max(F.col("__hit.action") == "block").alias("blocked"))
        decided = scratch.table(decided, "decided")
        aliases = checkpointed(nodes.join(decided, "root").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("__alias")).where("__alias IS NOT NULL"))
        parts = pages.select(*rest).withColumns({"__host": host_of(F.col(url)), "__path": path_of(F.col(url)), "__node": node_of(F.col(url))})
        own = checkpointed(matched(scratch, parts, rules, "pages"))
    out = own.join(aliases, own["__node"] == aliases["node"], "left")
    verdict = F.coalesce("__hit.action", "__alias", F.lit("allow"))
    return out.select(*rest, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__hit.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge(pages.select("page_id", "url"), links(pages), rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


_UP, _LOW = f"'{UPPER}'", f"'{LOWER}'"


def _host_sql(u: str) -> str:
    return f"coalesce(translate(regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), {_UP}, {_LOW}), '')"


def _path_sql(u: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '')"


def _part_sql(u: str, k: int) -> str:
    return f"coalesce(regexp_extract({u}, '{PARTS}', {k}), '')"


def _node_sql(u: str) -> str:
    path = _part_sql(u, 3)
    segments = f"list_transform(string_split(substr({path}, 2), '/'), lambda s: [s])"
    kept = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), {segments}), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE a || s END)"
    whole = f"'/' || array_to_string({kept}, '/') || CASE WHEN len({kept}) > 0 AND regexp_matches({path}, '/\\.\\.?\\z') THEN '/' ELSE '' END"
    return f"""CASE WHEN strpos({u}, '://') > 0 THEN lower({_part_sql(u, 1)}) || '://' || translate({_part_sql(u, 2)}, {_UP}, {_LOW}) ||
  CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {whole} ELSE {path} END || {_part_sql(u, 4)} END"""


def _hit_sql(of: str, key: str) -> str:
    """The longest rule for each key of a relation with host and path; block wins a tie."""
    return f"SELECT k.{key}, arg_max(r, (length(r.host) + length(r.path), r.action = 'block')) AS hit FROM {of} k JOIN r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path) GROUP BY k.{key}"


_RULES_SQL = ", ".join(map(str, RULES))
_QUOTED = lambda p: p.replace("'", "''")
_NAMED = lambda tag, test, value: f"list_transform(list_filter(regexp_extract_all(h, '{tag}'), lambda t: regexp_matches(t, '{_QUOTED(test)}')), lambda t: regexp_extract(t, '{_QUOTED(value)}', 1))"
_FOLDER = f"regexp_extract({_part_sql('url', 3)}, '(?s)^(.*/)', 1)"
SQL = f"""
WITH RECURSIVE r(action, host, path) AS (VALUES {_RULES_SQL}),
u AS (SELECT DISTINCT url, {_host_sql("url")} AS host, {_path_sql("url")} AS path, {_node_sql("url")} AS node FROM pages WHERE url IS NOT NULL),
h AS (SELECT url, regexp_replace(html, '{NO_MARKUP}', ' ', 'g') AS h FROM pages WHERE url IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')),
t AS (SELECT url, replace(unnest(list_concat({_NAMED(*CANONICAL)}, {_NAMED(*REFRESH)})), '&amp;', '&') AS t FROM h),
g AS (SELECT url, t, {_part_sql("t", 3)} AS path, {_FOLDER} AS folder FROM t WHERE t <> ''),
f AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN {_part_sql("url", 1)} || ':' || t
  ELSE {_part_sql("url", 1)} || '://' || {_part_sql("url", 2)} || CASE WHEN path = '' THEN {_part_sql("url", 3)} WHEN starts_with(path, '/') THEN path ELSE CASE WHEN folder = '' THEN '/' ELSE folder END || path END
  || CASE WHEN path = '' AND NOT contains(t, '?') THEN {_part_sql("url", 4)} ELSE {_part_sql("t", 4)} END END AS t FROM g),
l AS (SELECT {_node_sql("url")} AS a, {_node_sql("t")} AS b FROM f), e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, q.root FROM reach q JOIN e ON e.a = q.node),
n AS (SELECT node, min(root) AS root, {_host_sql("node")} AS host, {_path_sql("node")} AS path FROM reach GROUP BY node),
nh AS ({_hit_sql("n", "node")}),
c AS (SELECT root, bool_or(hit.action = 'allow') AS allowed, bool_or(hit.action = 'block') AS blocked FROM n LEFT JOIN nh USING (node) GROUP BY root),
uh AS ({_hit_sql("u", "url")})
SELECT page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, hit.host || hit.path AS rule,
  coalesce(hit.action, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN u USING (url) LEFT JOIN uh USING (url) LEFT JOIN n ON n.node = u.node LEFT JOIN c USING (root)
"""
