"""URL decisions: longest matching rule, then block decisions passed on to redirect and canonical aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.operators.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
#: What a browser does not read as tags, and a tag whose quoted values may hold `>`.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
TAG = r"""(?is)<%s(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+>"""
#: The first attribute of a name; those before it are passed over whole, quoted values included, without backtracking.
ATTRIBUTE = (
    r"""(?is)^<[a-z]+(?:[\s/]+(?!%s\s*=)[^\s=>/"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?+)*+"""
    r"""[\s/]+%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
)


def url_host(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """Identity of a resource in the alias graph: host, path and query, without scheme and fragment; null without a host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, url_path(url), F.regexp_extract(url, PARTS, 3)))


def _fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(length, rule, verdict) of the longest rule that fits, or null. `rules` is a literal list of (verdict, host, path)."""
    found = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*found))


def _attribute(tag: Column, name: str) -> Column:
    pattern = ATTRIBUTE % (name, name)
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def _resolve(href: Column, host: Column, path: Column) -> Column:
    """Absolute form of a link on the page at host and path; null for other schemes and empty links."""
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    return (
        F.when(href == "", None)
        .when(href.rlike(r"(?i)^https?://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(F.lit("http://"), host, href))
        .when(href.rlike("^[?#]"), F.concat(F.lit("http://"), host, path, href))
        .otherwise(F.concat(F.lit("http://"), host, F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), href))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) urls that pages declare equal: `<link rel=canonical>` and `<meta http-equiv=refresh>`.

    Links are relative to the page, or to its first `<base href>`. Comments and scripts declare nothing, and only the
    attribute of exactly that name counts, the first of several. Pages without url or html declare nothing.
    """
    p = pages.select(F.col(url).alias("src"), F.col(html).alias("html"))
    p = p.where(url_host(F.col("src")) != "").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    p = p.withColumn("html", F.regexp_replace("html", HIDDEN, ""))
    tags = lambda name: F.regexp_extract_all("html", F.lit(TAG % name), F.lit(0))
    links = F.filter(tags("link"), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)"))
    metas = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    refresh = lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"'\s]+)""", 1)
    hrefs = F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(metas, refresh))
    named = F.get(F.filter(F.transform(tags("base"), lambda t: _attribute(t, "href")), lambda h: h != ""), F.lit(0))
    base = F.coalesce(_resolve(named, url_host(F.col("src")), url_path(F.col("src"))), F.col("src"))
    return (
        p.select("src", base.alias("base"), F.explode(hrefs).alias("href"))
        .select("src", _resolve(F.col("href"), url_host(F.col("base")), url_path(F.col("base"))).alias("dst"))
        .where("dst is not null")
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(key, host, path, rule, verdict, alias_group) for every row.

    `rules` holds (allow or block, host, path); it is a literal list and becomes part of the plan, so keep it short. A rule
    fits its host and all subdomains if the url's path starts with its path; the longest wins and decides the url.
    A url that no rule fits takes the decision of its alias group, the connected component over canonical and refresh links and
    the optional `redirects` (src, dst): allow if any member is allowed by a rule, else block if any is blocked, else allow.
    Members may be urls that are no page themselves.

    Null urls and urls without `://` have empty host and path, no rule, no alias and the verdict allow. Repeated rows stay
    and agree. An empty table gives an empty result. Other columns are not read.
    """
    p = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = alias_edges(p)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    ends = edges.select(url_node(F.col("src")).alias("src"), url_node(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    groups = components(ends)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    members = groups.withColumn("fit", _fitting(url_host(as_url), url_path(as_url), rules)["verdict"])
    decided = members.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("fit") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("fit") == "block"), F.lit(False)).alias("blocked"),
    )
    alias = groups.join(decided, "component").select(
        "node", F.col("component").alias("alias_group"), F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("by_alias")
    )
    own = p.select(
        "key", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_node(F.col("url")).alias("node"),
        _fitting(url_host(F.col("url")), url_path(F.col("url")), rules).alias("fit"),
    )
    return own.join(alias, "node", "left").select(
        F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.col("by_alias"), F.lit("allow")).alias("verdict"), "alias_group",
    )
