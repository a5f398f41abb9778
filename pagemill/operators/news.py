"""Headline candidates and clusters of similar links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import urls
from pagemill.functions.text import trim_ws
from pagemill.operators.links import headline_anchors
from pagemill.sources import shared


def simple_news(pages: DataFrame, exact: bool = False) -> DataFrame:
    """Anchors that pass the headline rule, as one cluster per page: page_id, cluster_rank, title, link."""
    rows = headline_anchors(pages, exact).where(urls.is_headline(F.col("title"), F.col("link")))
    return rows.select("page_id", F.lit(0).alias("cluster_rank"), trim_ws(F.col("title")).alias("title"), "link")


def link_pairs(links: DataFrame, group: str, limit: float | None = None) -> DataFrame:
    """Distinct links of one group, each pair once: group, seed, member (seed < member), distance.

    Without a limit, all pairs, from cells().  With one, an equi-join on the group keeps pairs within it; AQE splits a group
    with very many links.  Before the distance is computed, pairs that cannot be under the limit fall to bounds on their
    lengths, which lose none.
    """
    if limit is None:
        return cells(links, group)
    one = links.select(group, F.col("link").alias("seed")).distinct()
    two = one.select(group, F.col("seed").alias("member"))
    pairs = one.join(two, group).where(F.col("seed") < F.col("member"))
    least = 1 - limit - 1e-3
    ratio = lambda f: F.least(f("seed"), f("member")) / F.greatest(f("seed"), f("member"))
    pairs = pairs.where((ratio(F.octet_length) > least) | (ratio(lambda c: F.size(urls.segments(F.col(c)))) > least))
    pairs = pairs.withColumn("distance", urls.distance(F.col("seed"), F.col("member")))
    return pairs.where(F.col("distance") < F.lit(limit).cast("float"))


#: Links of a block, about, and pairs that a task makes, about.
BLOCK, TASK_PAIRS = 512, 4_000_000


def cells(links: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """All pairs of distinct links of one group, as link_pairs gives them.

    A group's links are dealt into blocks by their hashes, and each two blocks, or one with itself, are a cell: so a large
    group is made by many tasks, none of which holds more than a cell.  A cell's distances are one matrix.
    """
    spark = links.sparkSession
    one = shared.written(links.select(F.col(group).alias("g"), "link").where("g IS NOT NULL AND link IS NOT NULL").distinct(), "links")
    sizes = one.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -int(-pairs // TASK_PAIRS))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = one.join(sizes, "g").select("g", "link", blocks.alias("m"), F.pmod(F.xxhash64("link"), blocks).cast("int").alias("own"))
    sent = dealt.select("g", "link", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    sent = sent.select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "link").repartition(tasks, "g", "x", "y")

    def one_cell(cell: pa.Table) -> pa.Table:
        x, y, own = cell.column("x")[0].as_py(), cell.column("y")[0].as_py(), cell.column("own").to_numpy()
        link = np.array(cell.column("link").to_pylist(), object)
        a = sorted(link[own == x].tolist())
        b = a if x == y else sorted(link[own == y].tolist())
        near = urls.distances(a, b)
        before = np.searchsorted(np.array(b, object), np.array(a, object), "right")[:, None] <= np.arange(len(b))  # a's link is the seed
        parts = [(a, b, before, near)] if x == y else [(a, b, before, near), (b, a, ~before.T, near.T)]
        out = []
        for seeds, members, mine, d in parts:
            to = np.broadcast_to(np.arange(len(members)), d.shape)[mine]
            ends = pa.array(np.concatenate([[0], np.cumsum(mine.sum(1))]), pa.int32())
            out.append(pa.table([pa.array(seeds, pa.string()), pa.ListArray.from_arrays(ends, pa.array(members, pa.string()).take(pa.array(to))), pa.ListArray.from_arrays(ends, pa.array(d[mine], pa.float32()))], ["seed", "members", "distances"]))
        out = pa.concat_tables(out)
        return out.add_column(0, "g", pa.repeat(cell.column("g")[0], len(out)))

    made = T.StructType([T.StructField("g", one.schema["g"].dataType), *T.StructType.fromDDL("seed string, members array<string>, distances array<float>").fields])
    rows = sent.groupBy("g", "x", "y").applyInArrow(one_cell, made)
    return rows.select(F.col("g").alias(group), "seed", "distances", F.posexplode("members").alias("at", "member")).select(group, "seed", "member", F.get("distances", F.col("at")).alias("distance"))


def news_clusters(pages: DataFrame, by: str = "page_id", rank: int = 3, distance: float = 0.3, exact: bool = False) -> DataFrame:
    """Top clusters per page (or host): by, cluster_rank, seed_url, member_url, title.

    Links in URL order; a seed's members are the later links nearer than distance, the seed itself not among them;
    clusters of more than three members stay, the largest `rank` of them, ties by seed.
    """
    links = headline_anchors(pages, exact)
    titled = links.groupBy(by, "link").agg(F.max("title").alias("title"))
    pairs = shared.written(link_pairs(titled, by, distance), "pairs")  # read twice below
    seeds = _seeds(pairs, by)
    order = W.partitionBy(by).orderBy(F.col("n").desc(), "seed")
    seeds = seeds.withColumn("cluster_rank", F.row_number().over(order) - 1).where(F.col("cluster_rank") < rank)
    rows = pairs.join(seeds, [by, "seed"]).join(titled, (titled[by] == pairs[by]) & (titled["link"] == pairs["member"]))
    return rows.select(pairs[by], "cluster_rank", F.col("seed").alias("seed_url"), F.col("member").alias("member_url"), trim_ws(F.col("title")).alias("title"))


def _seeds(pairs: DataFrame, by: str) -> DataFrame:
    return pairs.groupBy(by, "seed").agg(F.count(F.lit(1)).alias("n")).where("n > 3")


def clustered_pages(pages: DataFrame, distance: float = 0.3) -> DataFrame:
    """page_id of the pages that have a cluster."""
    return _seeds(link_pairs(headline_anchors(pages), "page_id", distance), "page_id").select("page_id").distinct()


def cluster(rows: DataFrame, rank: int) -> DataFrame:
    """The links of one rank; empty if there is none."""
    return rows.where(F.col("cluster_rank") == rank).select("title", F.col("link") if "link" in rows.columns else F.col("member_url").alias("link"))
