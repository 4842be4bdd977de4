"""URL rules whose block decisions reach aliases over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import cut, read
from clausework.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are one expression; longer lists belong into a table.
MOST_RULES = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Scheme and separator, host, path, query of a URL; the fragment is left out.
_URL = r"(?s)^(.*?://)([^/?#]*)([^?#]*)(\??[^#]*)"
#: A quoted or bare value of an attribute.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _lower(text: Column) -> Column:
    """A-Z to lower case, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end; empty without ://, and for null."""
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://, and for null."""
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits host and path, with its name and verdict, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    table = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in (("host", r.host), ("path", r.path), ("name", r.name), ("verdict", r.verdict)))) for r in longest))

    def fits(r: Column) -> Column:
        return ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])

    return F.get(F.filter(table, fits), F.lit(0))


def with_node(df: DataFrame, url: str, name: str) -> DataFrame:
    """df with what two spellings of one address share: lower-case scheme and host, a path without . and .., no fragment; null without ://."""
    tmp = [f"_{name}{k}" for k in range(1, 5)]
    df = df.withColumns({t: F.regexp_extract(url, _URL, k + 1) for k, t in enumerate(tmp)})
    path = F.when(F.col(tmp[2]) == "", F.lit("/")).otherwise(without_dots(F.col(tmp[2])))
    node = F.when(F.col(tmp[0]) != "", F.concat(_lower(F.concat(tmp[0], tmp[1])), path, tmp[3]))
    return df.withColumn(name, node).drop(*tmp)


def _attribute(tag: Column, name: str) -> Column:
    groups = [F.regexp_extract(tag, rf"(?i)[\s/]{name}{_VALUE}", k) for k in (1, 2, 3)]
    return F.trim(F.replace(F.concat(*groups), F.lit("&amp;"), F.lit("&")))


def targets(html: Column) -> Column:
    """Where a page says that it is or has gone: rel=canonical links and refresh redirects."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    gone = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*)", 1))
    return F.filter(F.concat(F.transform(links, lambda t: _attribute(t, "href")), gone), lambda x: x != "")


def without_dots(path: Column) -> Column:
    """path without its segments . and .., each .. with the segment before it; a path that ends in one ends in /."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda kept, p: F.when(p == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(p == ".", kept).otherwise(F.concat(kept, F.array(p)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.startswith("/") & path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def resolve(df: DataFrame, base: str, href: str, name: str) -> DataFrame:
    """df with href seen from base: absolute, //host, /path, ?query or relative to base's folder; with_node() resolves . and .. in it."""
    df = df.withColumns({f"_{k}": F.regexp_extract(base, _URL, n) for n, k in ((1, "scheme"), (2, "host"), (3, "path"))})
    root, h = F.concat("_scheme", "_host"), F.col(href)
    folder = F.regexp_extract("_path", r"(?s)^(.*/)", 1)
    seen = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_replace("_scheme", "//$", ""), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, "_path", h))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), h))
    )
    return df.withColumn(name, seen).drop("_scheme", "_host", "_path")


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b): a page's node and those of its canonical links and refresh redirects."""
    said = F.col("html").rlike("(?i)canonical|refresh")
    found = pages.where(said & F.col("url").contains("://")).select("url", F.explode(targets(F.col("html"))).alias("href"))
    found = with_node(resolve(found, "url", "href", "target"), "url", "a")
    return cut(with_node(found, "target", "b").select("a", "b")).where("a != b")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of_blocked of every row of pages.

    A page that a rule fits has the longest rule's verdict. Any other page is
    blocked if a page that redirects and canonical links connect with it is
    blocked by a rule, unless such a page, or the address itself, is explicitly
    allowed: an explicit allow in the class takes precedence over its blocks. All
    else is allowed. `redirects` (from_url, to_url) adds edges, such as those of
    a crawl log. A null url, or one without ://, has an empty host and path, no
    rule and no aliases; null html has no links. Repeated rows are judged alike;
    other columns are ignored.

    Only pages with edges enter the graph, and one row for each decided class is
    joined back, so that a host or a page with a third of all rows is never
    gathered.
    """
    url = F.col("url")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("r", rule)
    edges = edges_of(pages.select("url", "html"))
    if redirects is not None:
        moved = with_node(with_node(redirects.select("from_url", "to_url"), "from_url", "a"), "to_url", "b")
        edges = edges.unionByName(moved.select("a", "b").where("a != b"))
    classes = cut(components(edges, "a", "b"))
    # a node's own address decides, whether or not a page was crawled there
    parts = classes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = parts.select("component", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("v"))
    blocked = ruled.groupBy("component").agg(F.max((F.col("v") == "block").cast("int")).alias("b"), F.max((F.col("v") == "allow").cast("int")).alias("w"))
    out = classes.join(blocked.where("b = 1 AND coalesce(w, 0) = 0"), "component").select("node", F.lit(True).alias("hit"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    met = with_node(judged, "url", "node").join(out, "node", "left")
    return met.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), (F.col("r").isNull() & F.coalesce("hit", F.lit(False))).alias("alias_of_blocked"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_PATTERN = _URL.replace("'", "''")
_CASES = "\n".join(
    f"      WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}|{r.verdict}'"
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
)
_AZ = f"translate(%s, '{UPPER}', '{LOWER}')"


def _sql_value(tag: str, name: str) -> str:
    pattern = rf"(?i)[\s/]{name}{_VALUE}".replace("'", "''")
    return "trim(replace(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {k})" for k in (1, 2, 3)) + ", '&amp;', '&'))"


_CONTENT = r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?['"]?([^'"]*)""".replace("'", "''")
_PATH = f"regexp_extract(%(u)s, '{_PATTERN}', 3)"
#: The path without . and ..: a fold over its segments.
_FOLDED = (
    "list_reduce(string_split(" + _PATH + "[2:], '/'), lambda kept, p: CASE WHEN p = '..' THEN kept[:-2] WHEN p = '.' THEN kept ELSE list_append(kept, p) END, []::VARCHAR[])"
)
_CLEAN = (
    "CASE WHEN " + _PATH + " = '' THEN '/' WHEN starts_with(" + _PATH + ", '/') AND regexp_matches(" + _PATH + ", '/\\.\\.?(/|$)') THEN '/' || array_to_string(" + _FOLDED + ", '/')"
    " || CASE WHEN regexp_matches(" + _PATH + ", '/\\.\\.?$') AND len(" + _FOLDED + ") > 0 THEN '/' ELSE '' END ELSE " + _PATH + " END"
)
_NODE = (
    f"CASE WHEN regexp_extract(%(u)s, '{_PATTERN}', 1) <> '' THEN " + _AZ % f"regexp_extract(%(u)s, '{_PATTERN}', 1)" + " || " + _AZ % f"regexp_extract(%(u)s, '{_PATTERN}', 2)"
    + " || " + _CLEAN + f" || regexp_extract(%(u)s, '{_PATTERN}', 4) END"
)

OP10_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM pages WHERE url LIKE '%://%' AND html IS NOT NULL
), hrefs AS (
  SELECT url, {_sql_value("tag", "href")} AS href FROM tags
  WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches({_sql_value("tag", "rel")}, '(?i)(^|\\s)canonical(\\s|$)')
  UNION ALL
  SELECT url, regexp_extract({_sql_value("tag", "content")}, '{_CONTENT}', 1) FROM tags
  WHERE regexp_matches(tag, '(?i)^<meta') AND lower({_sql_value("tag", "http-equiv")}) = 'refresh'
), parts AS (
  SELECT url, href, regexp_extract(url, '{_PATTERN}', 1) AS scheme, regexp_extract(url, '{_PATTERN}', 2) AS h,
         regexp_extract(url, '{_PATTERN}', 3) AS p
  FROM hrefs WHERE href <> ''
), seen AS (
  SELECT url, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN regexp_replace(scheme, '//$', '') || href
    WHEN starts_with(href, '/') THEN scheme || h || href
    WHEN starts_with(href, '?') THEN scheme || h || p || href
    ELSE scheme || h || CASE WHEN regexp_extract(p, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(p, '(?s)^(.*/)', 1) END || href
  END AS target FROM parts
), one_way AS (
  SELECT {_NODE % {"u": "url"}} AS a, {_NODE % {"u": "target"}} AS b FROM seen
), links AS (
  SELECT DISTINCT a, b FROM one_way WHERE a <> b UNION SELECT DISTINCT b, a FROM one_way WHERE a <> b
), reach(a, b) AS (
  SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), judged AS (
  SELECT page_id, node, host, path, CASE
{_CASES}
    END AS r
  FROM (
    SELECT page_id, {_NODE % {"u": "url"}} AS node,
           coalesce({_AZ % f"regexp_extract(url, '{_PATTERN}', 2)"}, '') AS host,
           coalesce(regexp_extract(url, '{_PATTERN}', 3), '') AS path
    FROM pages)
), ends AS (
  SELECT a, CASE
{_CASES}
    END AS r
  FROM (
    SELECT a, {_AZ % f"regexp_extract(b, '{_PATTERN}', 2)"} AS host, regexp_extract(b, '{_PATTERN}', 3) AS path FROM reach)
), hit AS (
  SELECT a FROM ends GROUP BY a
  HAVING bool_or(r LIKE '%|block') AND NOT coalesce(bool_or(r LIKE '%|allow'), false)
)
SELECT page_id, host, path, split_part(r, '|', 1) AS rule,
       coalesce(nullif(split_part(r, '|', 2), ''), CASE WHEN a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN hit ON judged.node = hit.a
"""
