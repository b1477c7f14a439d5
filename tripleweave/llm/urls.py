"""URL filters: host and path rules, and block decisions that redirects and canonical links carry to aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import cut, hinted
from .components import components

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for text without ://."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def page_key(url: Column) -> Column:
    """What names a resource: host, path and query, without scheme and fragment; null where there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^#]*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.coalesce(query, F.lit(""))))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Of rules of one length the first listed wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    parts = F.split(path, "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", ".."), F.when(F.size(kept) > 0, "/").otherwise("")).otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), last)).otherwise(path)


def absolute(target: Column, base: Column) -> Column:
    """A link as an absolute url: whole urls, //host/path, /path, ?query and names beside the page, with . and ..
    resolved; null for an empty one and for one of another kind than a place on the web (mailto:, a fragment)."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^:/?#]+://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target)).when(target.startswith("?"), F.concat(page, target))
    whole = whole.when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(target != "", F.concat(folder, target))
    start, path, rest = (F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    return F.when(whole.isNotNull(), F.concat(start, without_dots(path), rest))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in double quotes, single quotes or none; empty where the tag has none of that very name.
    Entities that stand in urls are decoded."""
    pattern = rf"""(?is)^<[a-z]+(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|\s*/)*?\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    for entity, char in (("&#38;", "&"), ("&#x26;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.trim(value)


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): from each page to the targets of all its canonical links (canonical may be one of several values of rel)
    and of all its refreshes. What stands in comments, scripts and styles is no link; pages without such tags are
    passed over by a search of their text."""
    url = F.col(url_col)
    some = pages.where(url.isNotNull() & F.col(html_col).rlike(r"(?i)canonical|http-equiv"))
    html = F.regexp_replace(F.col(html_col), r"(?is)<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", " ")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"""(?is)(<{name}\s(?:[^>"']|"[^"]*"|'[^']*')*>)"""), F.lit(1))
    canonical = F.filter(tags("link"), lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags("meta"), lambda x: F.lower(attribute(x, "http-equiv")) == "refresh")
    targets = F.concat(F.transform(canonical, lambda x: attribute(x, "href")), F.transform(refresh, lambda x: F.trim(F.regexp_extract(attribute(x, "content"), r"(?i)\burl\s*=\s*[\"']?([^\"']*)", 1))))
    found = some.select(url.alias("url"), F.explode(targets).alias("target"))
    return found.where("target <> ''").select(page_key(F.col("url")).alias("a"), page_key(absolute(F.col("target"), F.col("url"))).alias("b"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, cause), one row for each row of pages.

    A page that a rule fits has that rule's verdict, and an explicit allow is never overturned. Others are judged by
    their aliases: pages and link targets that redirects (a table of from_url and to_url, if given), refreshes and
    canonical links connect, in any number of steps. An alias blocked by a rule blocks them; else they have the
    default. cause is rule, alias or default.

    Where no page is linked and no redirects are given there is nothing to connect, and rules alone decide. Links point
    either way: a page is blocked with what it points to, and with what points to it.

    A null url, or one without ://, has an empty host and path, no rule and no alias; null html has no links; repeated
    rows keep their rows; an empty table gives an empty table; other columns are neither read nor returned. Components
    and decisions stay on the executors.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(page_key(F.col("from_url")).alias("a"), page_key(F.col("to_url")).alias("b")))
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct())
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), page_key(F.col(url_col)).alias("key")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        placed = rows.withColumn("blocked", F.lit(None).cast("boolean"))
    else:
        nodes = cut(components(edges))
        node_host, node_path = F.regexp_extract("node", r"^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)
        ruled = cut(nodes.select("root", rule_of(node_host, node_path, rules)["verdict"].alias("verdict")).where("verdict = 'block'").select("root").distinct())
        blocked = hinted(cut(nodes.join(hinted(ruled), "root").select(F.col("node").alias("key"), F.lit(True).alias("blocked"))))
        placed = rows.join(blocked, "key", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block"), F.lit(default))
    cause = F.when(F.col("own").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("default")
    return placed.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), cause.alias("cause"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def syndicated(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): of pages whose paths hold the same article number, on whatever host, each redirects to the
    next in the order of their urls, so that aliases lie up to as many steps apart as there are copies."""
    number = F.regexp_extract("url", r"^[^:]+://[^/?#]*/[^/?#]*/([0-9]+)", 1)
    named = pages.select("url", number.alias("number")).where("number <> ''")
    return named.select(F.col("url").alias("from_url"), F.lead("url").over(Window.partitionBy("number").orderBy("url")).alias("to_url")).where("to_url is not null")


def redirect_aliases(spark, sf_dir: str) -> DataFrame:
    """op8's operator with a table of redirects made from the pages, which hold no links themselves: components decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, redirects=syndicated(pages))


def _sql(rules: Sequence[Rule], redirects: str | None = None) -> str:
    """Rules and aliases as SQL. redirects is a query of from_url and to_url; without it pages that hold links stop the
    query, because SQL does not read html."""
    fits = lambda host, path: " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    link = r"""(?i)(<link\b[^>]*\brel\s*=\s*[\x22\x27]?canonical\b|<meta\b[^>]*\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b)"""
    host = lambda rest: f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}')"
    rest = lambda url: f"(CASE WHEN instr(coalesce({url}, ''), '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END)"
    key = lambda url: f"(CASE WHEN {host(rest(url))} <> '' THEN {host(rest(url))} || coalesce(nullif(regexp_extract({rest(url)}, '^[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract({rest(url)}, '^[^?#]*(\\?[^#]*)', 1) END)"
    edges = redirects or "SELECT NULL::VARCHAR AS from_url, NULL::VARCHAR AS to_url WHERE FALSE"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, url, {rest("url")} AS rest, regexp_matches(coalesce(html, ''), '{link}') AS linked FROM pages),
h AS (SELECT page_id, {key("url")} AS k, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, linked FROM u),
r AS (SELECT *, CASE {fits("host", "path")} END AS own FROM h),
d AS (SELECT {key("from_url")} AS a, {key("to_url")} AS b FROM ({edges})),
e AS (SELECT a, b FROM d WHERE a <> b UNION SELECT b, a FROM d WHERE a <> b),
n AS (SELECT a AS k, regexp_extract(a, '^([^/?]*)', 1) AS host, regexp_extract(a, '^[^/?]*([^?]*)', 1) AS path FROM (SELECT DISTINCT a FROM e)),
reach AS (SELECT k FROM n WHERE starts_with(CASE {fits("host", "path")} END, 'block') UNION SELECT e.b FROM reach JOIN e ON e.a = reach.k)
SELECT page_id, host, path, substr(own, 7) AS rule,
       CASE WHEN own IS NOT NULL THEN substr(own, 1, 5) WHEN linked THEN error('SQL does not read links') WHEN k IN (SELECT k FROM reach) THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN own IS NOT NULL THEN 'rule' WHEN k IN (SELECT k FROM reach) THEN 'alias' ELSE 'default' END AS cause FROM r
"""


OP8_SQL = _sql(RULES)
REDIRECTS_SQL = _sql(
    RULES,
    r"SELECT url AS from_url, lead(url) OVER (PARTITION BY number ORDER BY url) AS to_url FROM (SELECT url, regexp_extract(url, '^[^:]+://[^/?#]*/[^/?#]*/([0-9]+)', 1) AS number FROM pages) WHERE number <> ''",
)
