"""Sitemap expansion and traversal over stored documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import unescape
from pagemill.sources import shared


def locations(maps: DataFrame) -> DataFrame:
    """(url, xml) to (url, loc, is_map): the text of every loc element; `.xml` names a further map."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>"), F.lit(1))
    return maps.select("url", F.explode(locs).alias("loc")).withColumn("loc", unescape(F.col("loc"))).withColumn("is_map", F.endswith("loc", F.lit(".xml")))


def flagged(url: Column, flags: list[str]) -> Column:
    """`+s` admits URLs that contain s, `-s` refuses them; the last flag that applies decides; without flags all pass."""
    if not flags:
        return F.lit(True)
    keep = F.lit(False)
    for flag in flags:
        keep = F.when(F.contains(url, F.lit(flag[1:])), F.lit(flag[0] == "+")).otherwise(keep)
    return keep


def traverse(maps: DataFrame, roots: DataFrame, done: DataFrame | None = None, flags: list[str] | None = None, max_depth: int | None = None, admit: Callable[[Column], Column] | None = None) -> DataFrame:
    """Breadth-first from roots (url): pages found, each once with its least depth, as (url, depth).

    Maps are parsed once, into a table of edges.  They are visited once, so cycles end, and the walk ends when no map is
    left (or, if asked for, at a depth); maps in done, or refused by the flags or by admit(url), are not entered.  Each
    level is one join and one anti-join, and its lineage is cut by a table in the shared folder.
    """
    spark = maps.sparkSession
    edges = shared.written(locations(maps).distinct(), "edges")
    frontier = shared.written(roots.select("url").distinct(), "level")
    visited, pages, depth = frontier, None, 0
    if done is not None:
        visited = visited.unionByName(done.select("url"))
    while max_depth is None or depth < max_depth:
        locs = shared.written(edges.join(frontier, "url", "left_semi").select("loc", "is_map").distinct(), "locs")
        found = locs.where(~F.col("is_map")).select(F.col("loc").alias("url"), F.lit(depth).alias("depth"))
        pages = found if pages is None else pages.unionByName(found)
        further = locs.where("is_map").select(F.col("loc").alias("url")).where(flagged(F.col("url"), flags or []))
        if admit is not None:
            further = further.where(admit(F.col("url")))
        frontier = shared.written(further.join(visited, "url", "left_anti"), "level")
        depth += 1
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if depth % 20 == 0:  # long chains: one table instead of many
            visited, pages = shared.written(visited, "visited"), shared.written(pages, "found")
    if pages is None:
        return spark.createDataFrame([], "url string, depth int")
    return pages.groupBy("url").agg(F.min("depth").alias("depth"))
