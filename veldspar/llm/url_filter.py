"""URL rules with redirect equivalence.

A url is judged by the longest rule that fits its host (or a parent domain) and path.  Urls that redirect to each other or
name each other as canonical are aliases: the connected components over those edges.  A url without a rule of its own is blocked if an
alias is blocked by a rule, unless some alias is allowed by a rule; otherwise it is allowed.

Edges are read from the page: ``<link rel=canonical href=...>``, ``<meta http-equiv=refresh content="0;url=...">``, and further edge
tables (redirect logs: from, to) may be passed.  Targets may be absolute, start with ``//`` or with ``/``.  A target needs no row of its own:
its rule verdict counts all the same.  Everything is DataFrame functions.

Defined cases: a url that is null or has no ``://`` has an empty host and path, fits no rule, has no aliases and is allowed; equal rules after
one another keep the first; repeated pages are judged each; null html has no links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.components import connected_components
from veldspar.llm.tables import stored

ALLOW, BLOCK = "allow", "block"


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host/path) that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # configuration: a literal condition each, the longest on top
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _absolute(target: Column, url: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    return (F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target)))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) urls of canonical links and refresh redirects; a relative path without a leading slash is no edge."""
    url, html = F.col(url_col), F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    rows = pages.filter(url.contains("://") & html.rlike(r"(?i)canonical|http-equiv")).select(url.alias("source"), F.explode(tags).alias("tag"))
    tag = F.col("tag")
    canonical = F.when(tag.rlike(r"(?i)^<link\b") & tag.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""),
                       F.regexp_extract(tag, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(tag.rlike(r"(?i)^<meta\b") & tag.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""),
                     F.regexp_extract(tag, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    target = F.nullif(F.coalesce(canonical, refresh), F.lit(""))
    return rows.select("source", _absolute(target, F.col("source")).alias("target")).filter("target IS NOT NULL")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
                html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """id_col, url, host, path, rule, verdict, component (null without aliases) of every page."""
    url = F.col(url_col)
    edges = alias_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(F.col(redirects.columns[0]).alias("source"), F.col(redirects.columns[1]).alias("target"))
        edges = more if edges is None else edges.union(more)
    judged = pages.select(F.col(id_col).alias("page"), url.alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    judged = judged.select("page", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("own"))
    if edges is None:
        out = judged.withColumn("component", F.lit(None).cast("string")).withColumn("alias", F.lit(None).cast("string"))
    else:
        groups = stored(connected_components(edges, "source", "target"), "url-aliases")
        rule, verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
        # allow has precedence over block within a component
        component = groups.select("component", verdict.alias("own")).groupBy("component").agg(F.min("own").alias("alias"))
        of = groups.join(component, "component").select(F.col("node").alias("url"), "component", "alias")
        out = judged.join(of, "url", "left")
    final = F.coalesce("own", "alias", F.lit(ALLOW)).alias("verdict")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", final, "component")
