"""URL filter with redirect equivalence, in DataFrame operations.

Urls that differ in scheme, letter case of the host, default port, fragment, tracking
parameters or a closing slash are one node. Canonical links and redirects of pages are
edges between nodes; their connected components are classes of aliases. A rule judges the
urls it fits; what no rule fits takes its class's decision: block if a rule blocks a member
and none explicitly allows one, else allow.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule, has no aliases and is allowed; repeated rows are judged each; null html has no links;
html of any length is searched in time in proportion to it; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import stored
from fotolake.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|source)(=|$)"


@dataclass(frozen=True)
class UrlRule:
    """``host`` and its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith("." + self.host)
        return inside & path.startswith(self.path)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    own = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(own, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does.

    A rule list is short and part of the plan. Longer text wins, then the earlier rule.
    """
    found = F.lit(None)
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        own = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), own).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """The url's spelling without what does not change the resource; null without a host."""
    rest = _after_scheme(url)
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))
    )
    return F.when(host != "", F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


# A tag ends at the next angle bracket at the latest; quoted values are taken whole, so that
# what stands in them is no attribute. All patterns go forward.
_TAGS = r"(?i)<(?:link|meta)[\s/][^<>]*"
_ATTRIBUTE = r"[\s\"'/][^\s\"'/<>=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)"
_REFRESH = r"(?i)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\"']?\s*([^\s\"']+)"


def _value(tag: Column, name: str) -> Column:
    """The value of the first attribute of this name; empty if there is none."""
    own = F.filter(
        F.regexp_extract_all(tag, F.lit(f"({_ATTRIBUTE})"), 1),
        lambda a: a.rlike(rf"(?i)^[\s\"'/]{name}\s*="),
    )
    raw = F.regexp_extract(F.get(own, 0), r"=\s*([\s\S]*)$", 1)
    return F.coalesce(F.trim(F.regexp_replace(raw, r"^[\"']|[\"']$", "")), F.lit(""))


def _target(tag: Column) -> Column:
    """Where a link or meta element leads: by rel, http-equiv, property or name; else empty."""
    content = _value(tag, "content")
    return (
        F.when(
            tag.rlike(r"(?i)^<link"),
            F.when(_value(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _value(tag, "href")),
        )
        .when(F.lower(_value(tag, "http-equiv")) == "refresh", F.regexp_extract(content, _REFRESH, 1))
        .when(
            (F.lower(_value(tag, "property")) == "og:url") | (F.lower(_value(tag, "name")) == "og:url"),
            content,
        )
    )


def link_targets(url: Column, html: Column) -> Column:
    """Absolute urls that a page names as its canonical address or redirects to."""
    # Most pages have no such element; the first test keeps them from the rest.
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(f"({_TAGS})"), 1),
        lambda tag: tag.rlike("(?i)canonical|refresh|og:url"),
    )
    found = F.transform(
        tags, lambda tag: F.replace(F.coalesce(_target(tag), F.lit("")), F.lit("&amp;"), F.lit("&"))
    )
    scheme = F.concat(F.substring_index(url, "://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.concat(site, F.regexp_extract(path_of(url), r"^(.*/)?", 0))

    def absolute(target: Column) -> Column:
        return (
            F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(scheme, target))
            .when(target.startswith("/"), F.concat(site, target))
            .otherwise(F.concat(folder, target))
        )

    return F.transform(F.filter(found, lambda t: t != ""), absolute)


def redirect_edges(pages: DataFrame) -> DataFrame:
    """``url, target`` for the links of ``url, html``."""
    return pages.select("url", F.explode(link_targets(F.col("url"), F.col("html"))).alias("target"))


def judge_urls(pages: DataFrame, edges: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``page_id, url``.

    ``edges`` has ``url, target``. Its urls take part in the classes with their own rules,
    whether they are pages or not.
    """
    links = stored(
        edges.select(
            "url", "target", node_of(F.col("url")).alias("_a"), node_of(F.col("target")).alias("_b")
        )
        .dropna(subset=["_a", "_b"])
        .select("url", "target", F.xxhash64("_a").alias("a"), F.xxhash64("_b").alias("b")),
        "links",
    )
    roots = components(links)
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = stored(
        pages.select(
            "page_id",
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
            F.xxhash64(node_of(F.col("url"))).alias("node"),
            node_of(F.col("url")).isNull().alias("alone"),
        ).withColumn("own", ruled),
        "judged",
    ).join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    ends = links.select(F.col("url"), F.col("a").alias("node")).unionByName(
        links.select(F.col("target").alias("url"), F.col("b").alias("node"))
    )
    outside = (
        ends.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        .withColumn("own", ruled)
        .where("own is not null")
        .join(roots, "node")
        .select(F.col("root").alias("class"), "own")
    )
    # One row per class with a decision: combined before the shuffle, however large the class.
    decided = (
        judged.where("own is not null and not alone")
        .select("class", "own")
        .unionByName(outside)
        .groupBy("class")
        .agg(
            F.max(F.col("own.verdict") == "block").alias("blocked"),
            F.max(F.col("own.verdict") == "allow").alias("allowed"),
        )
        .where("blocked and not allowed")
        .select("class", F.lit("block").alias("by_class"))
    )
    decided = stored(decided, "decided")
    open_rows = judged.where("own is null").join(decided, "class", "left")
    verdict = F.when(F.col("alone"), "allow").otherwise(F.coalesce("by_class", F.lit("allow")))
    columns = ["page_id", "host", "path"]
    return judged.where("own is not null").select(*columns, "own.rule", "own.verdict").unionByName(
        open_rows.select(
            *columns, F.lit(None).cast("string").alias("rule"), verdict.alias("verdict")
        )
    )
