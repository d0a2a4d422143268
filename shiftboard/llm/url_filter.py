"""URL filters with redirect equivalence.

A rule is a host and a path prefix with a verdict; it fits its host, all subdomains, and paths that start with
its own; the longest fitting rule decides.  Pages that no rule fits take the decision of their aliases: redirects
(meta refresh, or a table of them) and canonical links are edges between URLs, and if any URL of a connected component
is blocked by a rule, so are its pages without a rule.  A rule on the page itself comes first, so an
explicit allow holds against blocked aliases.  Everything is DataFrame work; components are distributed
joins (see ``components``), and HTML leaves the rows before any shuffle.

Two URLs are the same if they differ in scheme, case of the host, dot segments or fragment only.  Links are resolved as browsers do:
against the page's folder, with ``.`` and ``..`` taken out, a query alone against the page's path, ``&amp;`` as ``&``.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; null or empty
HTML has no links; repeated rows are judged each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .components import smallest_reachable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\bcontent\s*=\s*[\"']?[^>]*?\burl\s*=\s*'?([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments applied; an empty one is ``/``."""
    folded = F.aggregate(
        F.slice(F.split(path, "/"), 2, F.char_length(path)),
        F.lit(""),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x)),
    )
    ends_in_dots = path.rlike(r"/\.\.?$")
    return F.when(path == "", "/").when(ends_in_dots, F.concat(folded, F.lit("/"))).when(path.contains("/."), folded).otherwise(path)


def key_of(url: Column) -> Column:
    """The URL without scheme, dot segments and fragment; null without ``://``.  It parses like a URL."""
    host, path, query = (F.regexp_extract(url, PARTS, i) for i in (1, 2, 3))
    return F.when(url.contains("://"), F.concat(F.lit("://"), F.translate(host, UPPER, LOWER), without_dots(path), query))


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute URL, seen from the page's own; null for links that are no URL, such as ``mailto:``."""
    host, path = F.regexp_extract(url, PARTS, 1), F.regexp_extract(url, PARTS, 2)
    here = F.concat(F.lit("://"), host, F.when(path == "", "/").otherwise(path))
    folder = F.concat(F.lit("://"), host, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)))
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.lit(":"), link))
        .when(link.startswith("/"), F.concat(F.lit("://"), host, link))
        .when(link.startswith("?"), F.concat(here, link))
        .when(link.startswith("#"), url)
        .otherwise(F.concat(folder, link))
    )


def links(html: Column) -> Column:
    """Targets of canonical links and refreshes, as written."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    found = F.transform(
        tags,
        lambda t: F.when(t.rlike(CANONICAL), F.regexp_extract(t, HREF, 1)).when(t.rlike(REFRESH), F.regexp_extract(t, TARGET, 1)),
    )
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(
    pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """Per page row: id, host, path, rule (null if none fits), verdict.

    ``redirects``: further edges, as URLs in its first two columns.
    """
    link = F.col(url).cast("string")
    read = pages.select(F.col(page_id).alias("id"), link.alias("url"), F.col(html).cast("string").alias("html"))
    rows = read.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"))
    rows = rows.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    edges = read.filter(F.col("url").contains("://")).select("url", F.explode(links(F.col("html"))).alias("link"))
    edges = edges.select(key_of(F.col("url")).alias("a"), key_of(resolved(F.col("link"), F.col("url"))).alias("b"))
    if redirects is not None:
        source, target = (F.col(c).cast("string") for c in redirects.columns[:2])
        edges = edges.unionByName(redirects.select(key_of(source).alias("a"), key_of(resolved(target, source)).alias("b")))
    nodes = smallest_reachable(edges)
    decided = fitting(rules, host_of(F.col("node")), path_of(F.col("node")))["verdict"]
    bad = nodes.filter(decided == "block").select("component").distinct()
    # a semi join: a component with a third of all URLs is a skewed side that Spark can split
    aliases = nodes.join(bad, "component", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("alias"))
    found = rows.join(aliases, "key", "left")
    verdict = F.coalesce("fit.verdict", "alias", F.lit("allow"))
    return found.select("id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
