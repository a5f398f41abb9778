"""Link tables: page links, file links, and headline anchors.

The native path cuts anchors out by pattern, inside whole-stage code, from pages without comments, scripts and styles; an
anchor ends at its end tag, at the next anchor, or, without either, at the end of a block.  The exact path takes them
from the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import trim_ws, unescape, visible
from pagemill.operators import dom

#: Attributes up to the end of a tag: quoted values may hold anything.
ATTRIBUTES = r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
HREF = r"""(?is)^(?:[^"']|"[^"]*"|'[^']*')*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
BLOCK_END = r"(?i)</(?:address|article|aside|blockquote|body|div|dd|dl|dt|footer|form|h[1-6]|header|html|li|main|nav|ol|p|section|table|td|th|tr|ul)\b"

#: Extensions of linked files.
FILE_TYPES = [".txt", ".zip", ".m3u", ".jpg", ".png", ".ico", ".rar", ".conf", ".md", ".git"]


def anchors(pages: DataFrame, exact: bool = False) -> DataFrame:
    """(page_id, url, html) to one row per anchor with an href: page_id, url, pos, href, text; pos is in document order."""
    if exact:
        return dom.select(pages, "a[href]", keep=("url",)).select("page_id", "url", F.col("idx").alias("pos"), F.col("attrs")["href"].alias("href"), "text")
    pieces = F.split(visible(F.col("html")), r"(?i)<a(?=[\s/>])")
    rows = pages.select("page_id", "url", F.posexplode(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("pos", "_piece"))
    rows = rows.withColumn("_attributes", F.regexp_extract("_piece", "(?s)^" + ATTRIBUTES + ">", 1))
    rows = rows.select("page_id", "url", "pos", F.regexp_extract("_attributes", HREF, 1).alias("_href"), F.substring("_piece", F.length("_attributes") + 2, F.lit(2**31 - 1)).alias("_inside")).where("_href <> ''")
    href = F.when(F.substring("_href", 1, 1).isin("'", '"'), F.substring("_href", F.lit(2), F.length("_href") - 2)).otherwise(F.col("_href"))
    closed = F.regexp_extract("_inside", r"(?is)^(.*?)</a\b", 0)
    text = F.when(closed != "", F.substring(closed, F.lit(1), F.length(closed) - 3)).otherwise(F.regexp_replace("_inside", "(?s)" + BLOCK_END + ".*", ""))
    return rows.select("page_id", "url", "pos", unescape(href, attribute=True).alias("href"), unescape(F.regexp_replace(text, "(?s)<[^>]*>", "")).alias("text"))


def page_links(pages: DataFrame, include_outer: bool = False, exact: bool = False) -> DataFrame:
    """Distinct (page_id, link): rooted links joined to the page's site; absolute ones only with include_outer.

    Rows whose page has no readable URL are dropped.
    """
    rows = anchors(pages, exact).where(~F.col("href").isin("", "/"))
    site = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host_port(F.col("url")))
    link = F.when(F.startswith("href", F.lit("/")), urls.url_join(site, F.col("href")))
    if include_outer:
        link = link.when(F.startswith("href", F.lit("http")), F.col("href"))
    return rows.select("page_id", link.alias("link")).where("link IS NOT NULL").distinct()


def file_links(links: DataFrame) -> DataFrame:
    """Those links whose path's first dotted token is a file type."""
    token = F.regexp_extract(F.coalesce(urls.path(F.col("link")), F.lit("")), r"\.[a-zA-Z0-9]+", 0)
    return links.where(token.isin(*FILE_TYPES))


def headline_anchors(pages: DataFrame, exact: bool = False) -> DataFrame:
    """(page_id, host, link, title): anchors of 7 bytes of text or more; of equal links on a page the last title counts.

    Rooted links become host/path without scheme; abs_url has the scheme.  Other relative links are dropped.
    """
    rows = anchors(pages, exact).where(F.octet_length("text") >= 7).withColumn("href", trim_ws(F.col("href"))).withColumn("host", urls.hostname(F.col("url")))
    link = F.when(F.startswith("href", F.lit("/")), urls.path_join(F.col("host"), F.col("href"))).when(F.startswith("href", F.lit("http")), F.col("href"))
    rows = rows.withColumn("link", link).where("link IS NOT NULL")
    last = rows.groupBy("page_id", "host", "link").agg(F.max_by("text", "pos").alias("title"), F.max_by("url", "pos").alias("_url"))
    abs_url = F.when(F.startswith("link", F.lit("http")), F.col("link")).otherwise(F.concat(urls.scheme(F.col("_url")), F.lit("://"), F.col("link")))
    return last.select("page_id", "host", "link", "title", abs_url.alias("abs_url"))
