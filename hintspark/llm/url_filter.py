"""URL rules whose block decisions reach aliases, with DataFrame functions only.

Redirects and canonical links tie the URLs of one page together. Connected components over these
edges make the groups of aliases; a URL without a rule is blocked if a rule blocks any of its
aliases. A URL's own rule comes first, so an explicit allow stands against blocked aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hintspark.functions.text import once
from hintspark.plans.components import connected_components
from hintspark.plans.shared import SharedTables

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
META = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
GOES_TO = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_parts(url: Column) -> Column:
    """struct(site, host, path, node) of a URL. Values that several parts need are bound, not repeated: filters that are
    pushed down copy an expression, and copies of copies would outgrow what can be compiled."""

    def cut(rest: Column) -> Column:
        site = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        return F.struct(site.alias("site"), F.translate(site, _UPPER, _LOWER).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1).alias("query"))

    def joined(p: Column) -> Column:
        node = F.concat(p["host"], F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), p["query"])
        return F.struct(p["site"].alias("site"), p["host"].alias("host"), p["path"].alias("path"), F.when(p["host"] != "", node).alias("node"))

    return once(url, lambda u: once(F.coalesce(_rest(u), F.lit("")), lambda rest: once(cut(rest), joined)))


def with_url_parts(frame: DataFrame, url: Column, host: str, path: str, node: str) -> DataFrame:
    """frame with a URL's host, path and node."""
    parts = url_parts(url)
    return frame.withColumns({host: parts["host"], path: parts["path"], node: parts["node"]})


def link_target(url: Column, to: Column) -> Column:
    """The URL that a page's link leads to; null if it ties nothing."""

    def resolved(b: Column) -> Column:
        to, scheme = b["to"], b["scheme"]
        site = F.concat(scheme, F.lit("://"), b["parts"]["site"])
        folder = F.regexp_extract(b["parts"]["path"], r"^(.*/)?", 0)
        here = F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(to, r"^(?:\./)+", ""))
        return (
            F.when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
            .when(F.startswith(to, F.lit("/")), F.concat(site, to))
            .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
            .when(F.startswith(to, F.lit("?")), F.concat(site, b["parts"]["path"], to))
            .when(~F.startswith(to, F.lit("#")), here)
        )

    return once(F.struct(to.alias("to"), F.regexp_extract(url, r"^(.*?)://", 1).alias("scheme"), url_parts(url).alias("parts")), resolved)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; rules are (verdict, host, path).

    A rule fits its host and all subdomains if the path starts with its path. Every suffix of the
    host is looked up in the rules by host, which stand in the expression.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append((verdict, rule_host + rule_path, rule_path))
    one = lambda r: F.struct(F.lit(len(r[1])).alias("size"), F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("verdict"), F.lit(r[2]).alias("path"))
    table = F.create_map(*(x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(one, rs)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(
        F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.filter(F.array(one(("", "", ""))), lambda x: F.lit(False))))),
        lambda r: F.startswith(path, r["path"]),
    )
    best = F.array_max(fitting)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): nodes of a page and of the target of its canonical link or its refresh redirect.

    Targets without a scheme, a host or a leading slash stand beside the page; of dot segments only
    a leading ./ is resolved. Targets of other schemes than those with :// tie nothing.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    moves = F.transform(F.regexp_extract_all(html, F.lit(META), F.lit(0)), lambda t: F.regexp_extract(t, GOES_TO, 1))
    raw = pages.where(html.rlike("(?i)canonical|refresh") & (F.instr(F.col(url_col), "://") > 0))
    raw = raw.select(F.col(url_col).alias("url"), F.explode(F.concat(links, moves)).alias("to")).withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    ends = raw.select(url_parts(F.col("url"))["node"].alias("src"), url_parts(link_target(F.col("url"), F.col("to")))["node"].alias("dst"))
    return ends.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """id, host, path, rule (null if none fits), verdict (allow or block) for every row.

    redirects (from_url, to_url) adds edges to those in the pages. Without a rule the verdict is
    block if a rule blocks an alias, which needn't be a page itself, else allow. Null URLs and such
    without :// have an empty host and path, no rule and no alias, and are allowed. Repeated rows
    are judged alike; an empty table gives no rows. Other columns of pages play no part.
    """
    url = F.col(url_col)
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_parts(F.col("from_url"))["node"].alias("src"), url_parts(F.col("to_url"))["node"].alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    tables = SharedTables(pages.sparkSession, "urls")
    groups = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), tables)
    parts = with_url_parts(groups, F.concat(F.lit("x://"), F.col("node")), "host", "path", "again")
    ruled = parts.withColumn("blocked", F.coalesce(rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block", F.lit(False)))
    blocked = ruled.groupBy("component").agg(F.bool_or("blocked").alias("any_blocked")).where("any_blocked")
    aliases = tables.keep(groups.join(blocked, "component").select("node"))
    judged = with_url_parts(pages.select(F.col(id_col).alias("__id"), url.alias("__url")), F.col("__url"), "host", "path", "__node")
    judged = judged.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.join(aliases.select(F.col("node").alias("__alias")), F.col("__node") == F.col("__alias"), "left")
    by_alias = F.when(F.col("__alias").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), by_alias).alias("verdict"))
