"""Pages and regulations as text, and the links between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import unescape
from corvane.session import materialize

_BLOCKS = "p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|pre|blockquote|hr|dd|dt"
# Paths and files that a crawl has no use for.
NOISE_PREFIXES = ("/login", "/signin", "/signup", "/register", "/search", "/tag/", "/tags/", "/author/", "/feed", "/rss", "/cdn-cgi/")
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".pdf", ".zip", ".tar.gz", ".mp4", ".xml", ".json")


def html_to_text(html: Column | str) -> Column:
    """Text of a page: without scripts, styles, links and images; headings marked with ``#``; at most one blank line."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->|<head\b.*?</head>", "")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{_BLOCKS})\b[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]+>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def regulation_to_text(xml: Column | str) -> Column:
    """Prose of a regulation's XML, one paragraph a line, without source citations."""
    t = F.regexp_replace(xml, r"(?is)<\?xml.*?\?>|<CITA\b.*?</CITA>", "")
    t = F.regexp_replace(t, r"(?i)</(?:P|HEAD|FP|DIV\d*|HD\d*|EXTRACT|NOTE)>", "\n")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]+>", ""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def section_numbers(xml: Column | str) -> Column:
    """Numbers of the sections of a regulation's XML, in order."""
    return F.regexp_extract_all(xml, F.lit(r'(?i)<DIV8\s[^>]*N="([^"]+)"[^>]*TYPE="SECTION"'), F.lit(1))


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, link of every anchor, made absolute, without fragment and closing slash."""
    href = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1)))
    origin = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    raw = pages.select(url, origin.alias("o"), folder.alias("f"), href.alias("h"))
    absolute = (
        F.when(F.col("h").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.col("h"))
        .when(F.startswith("h", F.lit("//")), F.concat(F.regexp_extract(url, r"^([a-zA-Z]+:)", 1), F.col("h")))
        .when(F.startswith("h", F.lit("/")), F.concat("o", "h"))
        .otherwise(F.concat(F.col("f"), F.lit("/"), F.regexp_replace("h", r"^\./", "")))
    )
    return raw.select(url, F.regexp_replace(absolute, r"(?<=[^/:])/+$", "").alias("link"))


def worth_crawling(link: Column | str, host: Column, prefix: str = "/") -> Column:
    """Whether a link leads to a page of the same host, below the prefix and not to noise or an asset."""
    link = F.col(link) if isinstance(link, str) else link
    path = F.lower(F.coalesce(F.nullif(F.regexp_extract(link, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/")))
    ok = link.rlike(r"^https?://") & (F.regexp_extract(link, r"^[a-zA-Z]+://([^/?#]+)", 1) == host) & F.startswith(path, F.lit(prefix))
    for p in NOISE_PREFIXES:
        ok = ok & ~F.startswith(path, F.lit(p))
    for s in ASSET_SUFFIXES:
        ok = ok & ~F.endswith(path, F.lit(s))
    return ok


def crawl(links: DataFrame, start: DataFrame, max_depth: int = 3, max_pages: int = 200) -> DataFrame:
    """Pages reached from ``start`` (url) over ``links`` (url, link): url, depth.

    Breadth first; of a depth the first pages by name are taken until ``max_pages`` are reached, as the crawl budget is a feature.
    """
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    frontier, taken = seen, seen.count()
    for depth in range(1, max_depth + 1):
        fresh = links.join(frontier.select("url"), "url").select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        fresh = materialize(fresh.orderBy("url").limit(max(max_pages - taken, 0)).withColumn("depth", F.lit(depth)), f"crawl-{depth}")
        n = fresh.count()
        if not n:
            break
        taken += n
        seen, frontier = seen.unionByName(fresh), fresh
    return seen
