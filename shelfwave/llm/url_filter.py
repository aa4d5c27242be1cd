"""URL rules carried over redirects: pages that redirect to each other, or name one canonical address, stand or fall together.

DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwave.llm.components import components
from shelfwave.session import cut_lineage

Rule = tuple[str, str]  # verdict ("allow" or "block"), host and path ("example.com/en/")

#: Query parameters that only tell where a visit came from.
TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"


def host_of(url: Column) -> Column:
    """Null or no "://": empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """What servers redirect to one address: scheme, port, fragment, trailing slash, index page, ".html" and tracking parameters do not count."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), TRACKING, ""), "^&", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    return F.concat(F.regexp_replace(host_of(url), r":\d+$", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def absolute(target: Column, page: Column) -> Column:
    """A link of a page as an absolute URL."""
    target, scheme = F.trim(target), F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host_of(page), target))
            .when(target != "", F.concat(scheme, F.lit("://"), host_of(page), F.regexp_replace(path_of(page), "[^/]*$", ""), target)))


def page_links(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects, over the whole page."""
    canonical = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""), 1)
    return F.coalesce(F.concat(canonical, refresh), F.array().cast("array<string>"))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; of equally long ones, the first given; null without one. The rules are a small list."""
    def tail(spec: str) -> str:
        name, _, rest = spec.partition("/")
        return f"{name}\0/{rest}"

    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, spec in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested last and so comes outermost; sort is stable
        name, start = tail(spec).split("\0")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        same = [r for r in rules if len(r[1]) == len(spec)]
        if same.index((verdict, spec)) and any(s[1] == spec for s in same[:same.index((verdict, spec))]):
            continue
        found = F.when(fits, F.struct(F.lit(spec).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url: str = "url", html: str | None = "html",
                keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule and verdict of every row.

    A row that a rule fits has the rule's verdict. Any other row takes the verdict of its aliases: allow if a rule allows one of them, else block
    if a rule blocks one, else allow. Aliases are the connected component over redirects (`redirects`: src, dst, optional), canonical links and
    the forms of one address (`alias_key`). Addresses that occur only as targets count too. Repeated rows get equal verdicts; a null or relative
    URL has no aliases and is allowed; result columns replace input columns of the same name."""
    new = ("host", "path", "rule", "verdict")
    carried = [F.col(f"`{c}`") for c in keep if c not in new]
    u = F.col(f"`{url}`")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = (pages.select(*carried, host_of(u).alias("host"), path_of(u).alias("path"), F.when(u.contains("://"), alias_key(u)).alias("__key"))
            .withColumn("__fit", fit))
    links = None
    if html is not None and html in pages.columns:
        links = pages.where(u.contains("://")).select(u.alias("src"), F.explode(page_links(F.col(f"`{html}`"))).alias("to")).select("src", absolute(F.col("to"), F.col("src")).alias("dst"))
    if redirects is not None:
        more = redirects.select("src", absolute(F.col("dst"), F.col("src")).alias("dst"))
        links = more if links is None else links.unionByName(more)
    members = rows.where("__key is not null").select("__key", "__fit.verdict")
    if links is not None:
        links = cut_lineage(links.where("src is not null and dst is not null").distinct())
        edges = links.select(alias_key(F.col("src")).alias("a"), alias_key(F.col("dst")).alias("b"))
        groups = cut_lineage(components(edges))
        ends = links.select(F.explode(F.array("src", "dst")).alias("end")).distinct().select(alias_key(F.col("end")).alias("__key"), host_of(F.col("end")).alias("host"), path_of(F.col("end")).alias("path"))
        members = members.unionByName(ends.select("__key", fit["verdict"].alias("verdict")))
    # one row per key first, then per component: a hot key or component is pre-aggregated before it moves
    said = lambda v: F.max(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v)
    by_key = members.where("verdict is not null").groupBy("__key").agg(said("allow"), said("block"))
    if links is not None:
        names = groups.select(F.col("node").alias("__key"), F.col("component"))
        by_group = (by_key.join(names, "__key").groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block")))
        spread = names.join(by_group, "component").select("__key", "allow", "block")
        by_key = by_key.unionByName(spread).groupBy("__key").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    blocked = cut_lineage(by_key.where("block = 1 and allow = 0").select("__key"))
    # written first, so both sides of the join are plain exchanges that adaptive execution can split at a hot key
    return (rows.join(blocked.withColumn("__hit", F.lit(True)), "__key", "left")
            .select(*carried, "host", "path", F.col("__fit.rule").alias("rule"),
                    F.coalesce(F.col("__fit.verdict"), F.when(F.col("__hit"), "block").otherwise("allow")).alias("verdict")))
