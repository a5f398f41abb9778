"""What is new: anti-joins against done sets, first-seen titles, batches, soft 404 groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators.news import clustered_pages, simple_news


def not_done(rows: DataFrame, done: DataFrame | None, key: str = "url") -> DataFrame:
    """Rows whose key is not in the done set; without one, all."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def first_seen(rows: DataFrame, seen: DataFrame | None = None, key: str = "title", order: tuple[str, ...] = ("page_id", "link")) -> DataFrame:
    """One row for each key that is not in seen: the first by the order."""
    fresh = not_done(rows, seen, key)
    rest = [c for c in rows.columns if c != key]
    best = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(key, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*rows.columns)


def new_titles(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The monitor's step: of pages that have a cluster of news links, headline links with titles not seen before."""
    found = simple_news(pages).join(clustered_pages(pages), "page_id", "left_semi")
    return first_seen(found.select("page_id", "title", "link"), seen)


def alerts(fresh: DataFrame) -> DataFrame:
    """One text per page that has new links: lines `title ( link ) `, in link order."""
    lines = F.array_sort(F.collect_list(F.struct("link", F.concat("title", F.lit(" ( "), "link", F.lit(" ) \n")).alias("line"))))
    return fresh.groupBy("page_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("body"))


def payloads(fresh: DataFrame) -> DataFrame:
    """The alerts as JSON objects, for whoever sends them: page_id, payload."""
    return alerts(fresh).select("page_id", F.to_json(F.struct("page_id", "body")).alias("payload"))


def batches(rows: DataFrame, size: int, key: str, bin_rows: int = 1_000_000) -> DataFrame:
    """Adds batch: fixed-size runs of rows in the order of a numeric key.

    The row number is taken in two levels (range bins of about bin_rows, then rows in a bin), so no task holds all rows.
    """
    bins = max(64, -(-rows.count() // bin_rows))
    cuts = rows.agg(F.percentile_approx(key, F.array(*(F.lit(i / bins) for i in range(1, bins))), F.lit(10000)).alias("c")).first()["c"] or []
    binned = rows.withColumn("_bin", F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array(), lambda c: c < F.col(key))))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)  # over one row a bin
    counts = counts.select("_bin", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy("_bin").orderBy(key)) + F.col("_before") - 1
    return binned.join(F.broadcast(counts), "_bin").withColumn("batch", F.floor(number / size).cast("bigint")).drop("_bin", "_before")


def soft_404(pages: DataFrame) -> DataFrame:
    """Hosts that give several pages the same text: host, text_hash, n_pages."""
    rows = pages.select(urls.hostname(F.col("url")).alias("host"), text.page_text_hash(F.col("html")).alias("text_hash"))
    return rows.where("text_hash <> ''").groupBy("host", "text_hash").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages > 1")


def alive_pages(pages: DataFrame, status: str = "status", also: Column | None = None) -> DataFrame:
    """Pages answered with 200 to 399, and passing a further test if one is given."""
    keep = text.alive(F.col(status))
    return pages.where(keep if also is None else keep & also)
