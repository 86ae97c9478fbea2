"""URL filters with redirect equivalence: connected components over redirect
and canonical-link edges carry block decisions to aliases; explicit allows
take precedence.

The longest rule that fits a url decides it. A url without a rule is blocked if
one of its aliases (a url that redirects or canonical links join with it,
directly or through others) is blocked by a rule and none is allowed by one;
else it is allowed.

All canonical links and refreshes of a page count, but for those in comments,
scripts, styles and text areas. References are resolved against the page's url,
or its first base element: dot segments, queries alone and references without a
scheme among them. One that stays on the page (nothing, or a fragment alone),
or has a scheme without ``://`` (such as mailto), is no link.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is nobody's alias; a null or empty page has no links; repeated rows
get equal verdicts; texts are read whole; empty tables give empty results. Only
the named columns are read, so that others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Up to so many rules are tested in place; more are joined by host suffix.
RULES_IN_PLACE = 256

#: What is read as no markup.
SKIPPED = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|textarea|xmp)\b.*?(?:</(?:script|style|textarea|xmp)\b[^>]*>|\z)"
TAG = r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?is)([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFRESH_URL = r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*(.*?)\s*["']?\s*$"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What tells urls apart: host, path and query; neither scheme nor fragment."""
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host and path."""
    if len(rules) <= RULES_IN_PLACE:
        rule = decided = F.lit(None).cast("string")
        for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
            fits = _fits(F.col("host"), F.col("path"), host, path)
            rule = F.when(fits, F.lit(host + path)).otherwise(rule)
            decided = F.when(fits, F.lit(verdict)).otherwise(decided)
        return urls.withColumns({"rule": rule, "rule_verdict": decided})
    spark = urls.sparkSession
    listed = spark.createDataFrame([(h, p, v) for v, h, p in rules], "rule_host string, rule_path string, v string")
    if len(rules) <= 100_000:
        listed = F.broadcast(listed)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path").distinct()
    fits = keys.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.expr("startswith(path, rule_path)"))
    longest = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("a"), F.length("rule_host").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "v"))
    best = fits.groupBy("host", "path").agg(longest.alias("x")).select("host", "path", "x.rule", F.col("x.v").alias("rule_verdict"))
    return urls.join(best, ["host", "path"], "left")


def resolved(base: Column, reference: Column) -> Column:
    """The url that a reference means on a page; null if it is no link."""
    ref = F.regexp_replace(reference, r"#.*$", "")
    part = lambda k: F.regexp_extract(base, r"^([^:/?#]*)(://[^/?#]*)([^?#]*)", k)
    path = F.when(ref.startswith("/"), F.regexp_extract(ref, r"^([^?]*)", 1)).otherwise(
        F.concat(F.regexp_extract(F.when(part(3) == "", "/").otherwise(part(3)), r"^(.*/)[^/]*$", 1), F.regexp_extract(ref, r"^([^?]*)", 1))
    )
    query = F.regexp_extract(ref, r"^[^?]*(\?.*)$", 1)
    own_path = F.concat(part(1), part(2), part(3), query)
    return (
        F.when((base.isNull()) | (F.instr(base, "://") == 0) | (ref == ""), None)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(ref.startswith("//"), F.concat(part(1), F.lit(":"), ref))
        .when(ref.startswith("?"), own_path)
        .otherwise(F.concat(part(1), part(2), without_dots(path), query))
    )


def without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..``."""
    parts = F.split(path, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
    walk = lambda out, p: F.when(p == ".", out).when(p == "..", up(out)).otherwise(F.concat(out, F.array(p)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), walk)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) url pairs that the pages' canonical links and refreshes state."""
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html_col), SKIPPED, " "), F.lit(TAG), F.lit(0))
    found = pages.where((F.instr(url_col, "://") > 0) & F.contains(F.lower(html_col), F.lit("<"))).select(F.col(url_col).alias("page"), tags.alias("tags")).where(F.size("tags") > 0)
    names = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    plain = lambda v: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(v, "^[\"']|[\"']$", "")), "&(?:amp|#38|#x26);", "&"), r"[\t\r\n]", "")
    values = lambda t: F.transform(F.regexp_extract_all(t, F.lit(ATTRIBUTE), F.lit(2)), plain)
    read = F.transform("tags", lambda t: F.struct(F.lower(F.substr(t, F.lit(2), F.lit(4))).alias("tag"), names(t).alias("n"), values(t).alias("v")))
    value = lambda t, name: F.get(t["v"], F.array_position(t["n"], name).cast("int") - 1)
    read = found.select("page", read.alias("read"))
    base = F.get(F.filter(F.transform("read", lambda t: F.when(t["tag"] == "base", value(t, "href"))), lambda x: x.isNotNull()), 0)
    canonical = lambda t: (t["tag"] == "link") & F.array_contains(F.split(F.lower(value(t, "rel")), r"\s+"), "canonical")
    refresh = lambda t: (t["tag"] == "meta") & (F.lower(value(t, "http-equiv")) == "refresh")
    target = lambda t: F.when(canonical(t), value(t, "href")).when(refresh(t), F.regexp_extract(value(t, "content"), REFRESH_URL, 1))
    targets = F.filter(F.transform("read", target), lambda x: x.isNotNull() & (x != ""))
    stated = read.select("page", base.alias("base"), F.explode(targets).alias("reference"))
    on = F.coalesce(resolved(F.col("page"), F.col("base")), F.col("page"))
    return stated.select(F.col("page").alias("a"), resolved(on, F.col("reference")).alias("b")).where("b IS NOT NULL")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for every page.
    ``redirects``: further (a, b) url pairs, such as a crawler's log."""
    scratch = Scratch(pages.sparkSession, "urls")
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    links = page_links(narrow)
    if redirects is not None:
        links = links.union(redirects.select("a", "b"))
    links = scratch.save(links, "links")
    edges = links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
    alias = scratch.save(connected_components(edges, scratch), "alias")
    as_url = alias.withColumn("u", F.concat(F.lit("x://"), "node"))
    judged = with_rules(as_url.select("node", "root", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules)
    roots = scratch.save(
        judged.groupBy("root").agg(
            F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocked"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allowed")
        ),
        "roots",
    )
    spread = F.when((F.coalesce("blocked", F.lit(0)) == 1) & (F.coalesce("allowed", F.lit(0)) == 0), "block").otherwise("allow")
    decided = scratch.save(alias.join(broadcast_if_small(roots), "root").select("node", F.col("root").alias("alias_of"), spread.alias("spread")), "decided")
    own = with_rules(narrow.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")), rules)
    return own.join(broadcast_if_small(decided), "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"), "alias_of"
    )
