"""URL filter rules, with decisions carried over to redirect and canonical-link aliases.

A rule names a host (with all its subdomains) and the start of a path; the longest rule that
fits a URL decides. URLs joined by a redirect or a canonical link are one resource: connected
components over these edges carry a block to every alias that no rule speaks about, unless a
rule allows one of the component's URLs, which comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lower_ascii, store

#: (verdict, host and start of path)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rules are held by every expression up to this number; beyond it they are joined.
INLINE_RULES = 256

_MARK = re.compile(r"<!--|<script\b|<(?:link|meta)\b[^>]*>", re.IGNORECASE)
_SCRIPT_END = re.compile(r"</script\s*>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\s([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_REFRESH = re.compile(r"""[\d.\s]*[;,]?\s*url\s*=\s*["']?([^"']*)""", re.IGNORECASE)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    own = (host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))
    return own & F.startswith(path, rule_path) & (host != "")


def decide(urls: DataFrame, rules) -> DataFrame:
    """``urls`` (url, ...) with host, path, rule and verdict of the longest rule that fits, else null."""
    spark = urls.sparkSession
    rules = list(rules)
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    order = sorted({(r, v) for v, r in rules}, key=lambda x: (-len(x[0]), x[0], x[1]))
    if len(order) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r, v in reversed(order):
            host, path = _split(r)
            fits = _fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path))
            rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
        return out.withColumn("rule", rule).withColumn("verdict", verdict)
    # One row a host in the table, so that a host of many rules multiplies no URL's rows.
    table = spark.createDataFrame([(*_split(r), r, v, i) for i, (r, v) in enumerate(order)], "rule_host string, rule_path string, rule string, verdict string, n int")
    table = table.groupBy("rule_host").agg(F.array_sort(F.collect_list(F.struct("n", "rule_path", "rule", "verdict"))).alias("rules"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = out.select("url", "path", F.explode(suffixes).alias("rule_host")).distinct().join(table, "rule_host")
    hit = each.select("url", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), 0).alias("hit"))
    best = hit.where("hit is not null").groupBy("url").agg(F.min("hit").alias("hit")).select(F.col("url").alias("__url"), "hit.rule", "hit.verdict")
    return out.join(best, F.col("url") == F.col("__url"), "left").drop("__url")


def resource(url: Column) -> Column:
    """A URL without its fragment, scheme and host lower-cased: what an alias edge joins."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(lower_ascii(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): canonical links and meta refreshes that pages declare, comments and scripts left out.

    Only pages that name one of them at all are looked at beyond a search for the words.
    """
    some = pages.where(F.col(url_col).contains("://")).where(F.rlike(F.col(html_col), F.lit(r"(?i)\bcanonical\b|\brefresh\b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(url, to) for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for to in declared(url, html)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["source", "target"])

    return some.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "source string, target string")


def _tags(html: str) -> Iterator[str]:
    """link and meta tags outside comments and scripts, in one pass; a comment or script without an end hides nothing."""
    last = html.rfind(">") + 1  # a tag ends before this
    at, comment, script = 0, True, True
    while m := _MARK.search(html, at, last):
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at, last) if comment else -1
            comment = end >= 0  # without one after here, later ones have none either
            at = end + 3 if comment else at
        elif m[0][1] in "sS":
            end = _SCRIPT_END.search(html, at, last) if script else None
            script = end is not None
            at = end.end() if end else at
        else:
            yield m[0]


def declared(url: str, html: str) -> list[str]:
    """URLs that a page names as its canonical address or sends its readers to."""
    out = []
    for tag in _tags(html):
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").strip() for m in reversed(list(_ATTRIBUTE.finditer(tag)))}  # the first of equal names
        href = None
        if tag[1].lower() == "l" and "canonical" in attributes.get("rel", "").lower().split():
            href = attributes.get("href")
        elif tag[1].lower() == "m" and attributes.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(attributes.get("content", ""))):
            href = m[1]
        if href:
            try:
                target = urljoin(url, href)
            except ValueError:
                continue
            if "://" in target:
                out.append(target)
    return out


def judge(pages: DataFrame, *, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` are (verdict, rule) pairs; ``redirects`` may add edges (source, target) to those
    that the pages' html declares. verdict is the rule's; without one, ``allow`` if a rule allows
    a URL of the same component, else ``block`` if a rule blocks one, else ``allow``. A null URL
    or one without ``://`` has an empty host and path, fits no rule and is allowed. Null html
    declares no edges; very long html is read whole, once. Of two rules of one length that fit,
    the first by spelling decides, and of one rule that is allowed and blocked, the allowance.
    Repeated rows are kept and judged alike; extra columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = decide(rows, rules)
    edges = redirects.select(F.col("source").alias("a"), F.col("target").alias("b")) if redirects is not None else None
    if html_col is not None:
        own = page_links(pages, url_col=url_col, html_col=html_col).select(F.col("source").alias("a"), F.col("target").alias("b"))
        edges = own if edges is None else edges.unionByName(own)
    if edges is None:
        return _final(judged)
    edges = store(edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b")).where("a is not null and b is not null").distinct(), "links")
    if edges.where("a <> b").isEmpty():
        return _final(judged)
    members = store(connected_components(edges), "components")
    said = decide(members.select(F.col("node").alias("url"), "component"), rules)
    groups = said.groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
    groups = groups.where("blocked = 1 and coalesce(allowed, 0) = 0")
    aliases = members.join(groups, "component", "left_semi").select(F.col("node").alias("__node"), F.lit("block").alias("carried"))
    return _final(judged.withColumn("__at", resource(F.col("url"))).join(aliases, F.col("__at") == F.col("__node"), "left"), F.col("carried"))


def _final(judged: DataFrame, carried: Column | None = None) -> DataFrame:
    verdict = F.coalesce("verdict", *([carried] if carried is not None else []), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
