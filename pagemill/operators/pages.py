"""Stored pages with what is done to them, in a chain; pages that cannot be read stay as rows with an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import article, dom, links, news


@dataclass(frozen=True)
class Pages:
    """rows: page_id, url, html, err; html is null where err is not.  selected: the nodes chosen so far."""

    rows: DataFrame
    selected: DataFrame | None = None

    @classmethod
    def of(cls, pages: DataFrame) -> Pages:
        """Pages as stored; an err column counts, and a page without a document has the error of none."""
        err = F.when(F.col("html").isNull(), F.lit("no document"))
        if "err" in pages.columns:
            err = F.coalesce(F.col("err"), err)
        rows = pages.select("page_id", "url", "html", err.alias("err"))
        return cls(rows.withColumn("html", F.when(F.col("err").isNull(), F.col("html"))))

    @property
    def good(self) -> DataFrame:
        return self.rows.where("err IS NULL").drop("err")

    @property
    def errors(self) -> DataFrame:
        return self.rows.where("err IS NOT NULL").select("page_id", "url", "err")

    def select(self, css: str) -> Pages:
        """Adds the nodes that match."""
        found = dom.select(self.good, css)
        return replace(self, selected=found if self.selected is None else self.selected.unionByName(found))

    def each(self, css: str, do: Callable[[int, dom.Node], str | None]) -> DataFrame:
        """What do(idx, node) says of every node that matches."""
        return dom.each(self.good, css, do)

    def links(self, include_outer: bool = False) -> DataFrame:
        return links.page_links(self.good, include_outer)

    def simple_news(self) -> DataFrame:
        return news.simple_news(self.good)

    def news(self, rank: int = 3, distance: float = 0.3) -> DataFrame:
        return news.news_clusters(self.good, rank=rank, distance=distance)

    def articles(self) -> DataFrame:
        return article.articles(self.good)
