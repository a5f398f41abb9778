r"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Sizes are words (``[^\x20\x09-\x0D]+``).  Targets share the corpus's words by weight; a source's target stops at
``max_repeats`` times its size and the excess goes to the others by weight until none is above (water filling: with
sources ordered by size per weight, the capped ones are a prefix of that order).

Curriculum: each source has a schedule, knots (time, intensity) in [0, 1] with linear intensity between them.  Its
integral, scaled to the source's target, is the cumulative demand in words; a document that begins at word x of its
source's stream is trained on at the time where the demand reaches x, found by inverting the piecewise quadratic.
`curriculum` range-sorts the resulting rows by that time.

A source's stream is its documents in the order of a hash of their ids, repeated whole while the target allows; the
last round takes documents up to the boundary nearest the target.  Running sums are taken in two levels (bins of the
hash, then rows in a bin), so a source that holds a third of all rows is spread over 4096 bins, or 16 times as many as
often as a bin of all rows would have over ``BIN_ROWS``.  Texts are read once, for their sizes.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; repeated rows are rows of
their own and tie by (doc_id, size), where equal rows are interchangeable; a source whose size is 0 has target 0; an
empty table gives none; other columns are ignored by `mixed` and kept by `curriculum` only if named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm import storage

WORD = r"[^\x20\x09-\x0D]+"
BINS_HEX = 3  # at least 4096 bins of each source's stream
BIN_ROWS = 1 << 20
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) rows to one row per source: source, source_size, weight, target.

    The windows here run over one row per source, after partial aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), rank % len(cycle)).cast("long"))
    # By size per weight, compared without division: size * (lcm / weight) is exact.
    lcm = math.lcm(*cycle)
    order = W.orderBy((F.col("source_size") * lcm / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({"_size_before": F.sum("source_size").over(upto) - F.col("source_size"), "_weight_before": F.sum("weight").over(upto) - F.col("weight"), "_total": F.sum("source_size").over(every), "_weights": F.sum("weight").over(every)})
    # Capped: the fair share of what the sources before it leave is above its own cap.
    left = F.col("_total") - max_repeats * F.col("_size_before")
    per = per.withColumn("_capped", left * F.col("weight") > max_repeats * F.col("source_size") * (F.col("_weights") - F.col("_weight_before")))
    held = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("source_size"))).over(every), F.lit(0))
    gone = F.coalesce(F.sum(F.when(F.col("_capped"), F.col("weight"))).over(every), F.lit(0))
    share = ((F.col("_total") - max_repeats * held) * F.col("weight")).cast("double") / (F.col("_weights") - gone).cast("double")
    target = F.when(F.col("_capped"), (max_repeats * F.col("source_size")).cast("double")).otherwise(share)
    return per.select("source", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of the documents, as a table."""
    return storage.written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def streamed(rows: DataFrame) -> DataFrame:
    """Adds _from: the words of the same source before each row, in the order of the id's hash; without an id, of the size's."""
    digits, n = BINS_HEX, rows.count()
    while n >> (4 * digits) > BIN_ROWS:
        digits += 1
    rows = rows.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))))
    rows = rows.withColumn("_bin", F.substring("_hash", 1, digits))
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_n"))
    ahead = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.select("source", "_bin", (F.sum("_n").over(ahead) - F.col("_n")).alias("_bin_from"))
    inner = W.partitionBy("source", "_bin").orderBy("_hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_in_bin", F.sum("size").over(inner) - F.col("size"))
    b = bins.select(F.col("source").alias("_s"), F.col("_bin").alias("_b"), "_bin_from")
    return rows.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))).withColumn("_from", F.col("_in_bin") + F.col("_bin_from")).drop("_s", "_b", "_bin", "_bin_from", "_in_bin", "_hash")


def mixed(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, text) to one row per document: doc_id, source, size, source_size, target, taken, stream_from."""
    return mixed_sizes(sized(docs), cycle, max_repeats)


def mixed_sizes(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """As `mixed`, of what `sized` gives."""
    targets = source_targets(sizes.select("source", "size"), cycle, max_repeats).select(F.col("source").alias("_t"), "source_size", "target")
    rows = streamed(sizes).join(targets, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - (rounds * F.col("source_size")).cast("double")
    middle = F.col("_from").cast("double") + F.col("size").cast("double") / 2
    taken = F.col("size") * (rounds + F.when(middle <= rest, 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("_from").alias("stream_from"))


def with_position(rows: DataFrame, schedules: DataFrame) -> DataFrame:
    """Adds positions: for each share in _x, the time at which the source's demand reaches that share of its target.

    schedules: (source, time, intensity) knots, times from 0 to 1, intensities not negative and not all zero; a source
    without knots has intensity 1 throughout.
    """
    by_time = W.partitionBy("source").orderBy("time")
    parts = schedules.select("source", F.col("time").alias("t0"), F.lead("time").over(by_time).alias("t1"), F.col("intensity").alias("w0"), F.lead("intensity").over(by_time).alias("w1")).where("t1 > t0")
    parts = parts.withColumn("area", (F.col("t1") - F.col("t0")) * (F.col("w0") + F.col("w1")) / 2)
    upto = W.partitionBy("source").orderBy("t0").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("before", F.sum("area").over(upto) - F.col("area"))
    plans = parts.groupBy(F.col("source").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("before", "area", "t0", "t1", "w0", "w1"))).alias("_parts"), F.sum("area").alias("_whole"))
    rows = rows.join(plans, F.col("source").eqNullSafe(F.col("_p")), "left")

    def part_of(x: Column) -> Column:
        """The share scaled to the schedule's integral, and the piece in which it lies."""
        x = F.least(x, F.lit(1.0)) * F.coalesce("_whole", F.lit(1.0))
        return F.struct(x.alias("x"), F.try_element_at(F.filter("_parts", lambda p: (p["before"] <= x) & (p["area"] > 0)), F.lit(-1)).alias("p"))

    def time(found: Column) -> Column:
        x, p = found["x"], found["p"]
        need, slope = x - p["before"], (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
        root = 2 * need / (p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * need, F.lit(0.0))))
        return F.when(p.isNull(), x).when(need <= 0, p["t0"]).otherwise(p["t0"] + root)

    rows = rows.withColumn("_found", F.transform("_x", part_of))
    return rows.withColumn("positions", F.transform("_found", time)).drop("_p", "_parts", "_whole", "_found", "_x")


def scheduled(mix: DataFrame, schedules: DataFrame) -> DataFrame:
    """`mixed` with the times of all taken copies of each document, in order; none taken, none."""
    n = F.when(F.col("taken") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    begin = lambda k: (F.col("stream_from") + k * F.col("source_size")).cast("double") / F.col("target")
    shares = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), begin)).otherwise(F.array().cast("array<double>"))
    return with_position(mix.withColumn("_x", shares), schedules)


def curriculum(mix: DataFrame, schedules: DataFrame) -> DataFrame:
    """One row per taken copy of a document of `mixed`, range-sorted by its training time."""
    rows = scheduled(mix, schedules)
    return rows.select(*mix.columns, F.posexplode("positions").alias("copy", "position")).orderBy("position", "source", "doc_id", "copy")


def default_schedules(targets: DataFrame) -> DataFrame:
    """Linear ramps from 2 - w/2 to w/2, w being the source's weight: heavier sources come later."""
    w = F.col("weight").cast("double") / 2
    knots = F.array(F.struct(F.lit(0.0).alias("time"), (2 - w).alias("intensity")), F.struct(F.lit(1.0).alias("time"), w.alias("intensity")))
    return targets.select("source", F.explode(knots).alias("k")).select("source", "k.time", "k.intensity")


def placed(docs: DataFrame) -> DataFrame:
    """`mixed` with the times of each document's copies (positions), of the first (position) and of the last (last_position).

    Range-sorted by the first; documents of which none is taken come last, with null times.
    """
    sizes = sized(docs)
    rows = scheduled(mixed_sizes(sizes), default_schedules(source_targets(sizes.select("source", "size"))))
    ends = {"position": F.try_element_at("positions", F.lit(1)), "last_position": F.try_element_at("positions", F.lit(-1))}
    return rows.withColumns(ends).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, range-sorted by the time at which each is first trained on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return placed(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS BIGINT) AS weight FROM s GROUP BY source
), o AS (
  SELECT *, coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
    coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM p WINDOW w AS (ORDER BY source_size * 6 // weight, source NULLS LAST)
), c AS (SELECT *, (total - 3 * sb) * weight > 3 * source_size * (weights - wb) AS capped FROM o),
t AS (
  SELECT source, source_size, weight, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((total - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0)) * weight AS DOUBLE)
    / CAST(weights - coalesce(sum(weight) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) END AS target FROM c
), r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.weight,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CAST(size * (rounds + CASE WHEN CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2 <= target - CAST(rounds * source_size AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
    2 - CAST(weight AS DOUBLE) / 2 AS w0, CAST(weight AS DOUBLE) / 2 AS w1 FROM r
), x AS (
  SELECT *, CAST(before AS DOUBLE) / target AS x1, least(CAST(before + (taken // size - 1) * source_size AS DOUBLE) / target, 1.0::DOUBLE) AS x2 FROM k
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN x1 <= 0 THEN 0.0::DOUBLE ELSE 2 * x1 / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * x1)) END END AS position,
  CASE WHEN taken > 0 THEN CASE WHEN x2 <= 0 THEN 0.0::DOUBLE ELSE 2 * x2 / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * x2)) END END AS last_position
FROM x
"""
