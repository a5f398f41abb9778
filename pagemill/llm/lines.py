"""Line dedup over overlapping three-line windows, in DataFrame functions only.

A text is split at newlines.  A window is three consecutive lines of one document, compared unchanged; windows whose
lines are all blank do not count.  Of the places where a window occurs, ordered by (doc_id, line), the first stays and
every other is a repeat; a line covered by any repeat is removed, and covered positions merge.  Windows are judged on
the input, not on what is left.

Windows are known by two independent 64-bit hashes.  The first place of each comes from a partially aggregated minimum,
so a window that fills a third of the corpus shrinks before its shuffle.  Those minima are written before the places
join them: AQE splits the hot partition of a join only where both sides are plain shuffles, not one an aggregate.

Defined results: a null text stays null and has no lines; a text of fewer than three lines is unchanged; a null doc_id
comes last in the order; rows that share a doc_id count as one document, whose places tie, and a line removed from one
of them is removed from all; an empty table gives none; other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import storage

WINDOW = 3


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document with any: _id and the sorted 0-based positions of its removed lines."""
    # Every line is hashed once; a window's hashes are those of its lines' hashes.
    seen = lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(window), line).alias("b"), F.rlike(line, F.lit(r"[^\t\r\x0B\x0C ]")).alias("w"))
    lines = docs.select(F.col(doc_id).alias("_id"), F.transform(F.split(text, "\n"), seen).alias("_lines")).where(F.size("_lines") >= window)
    starts = F.sequence(F.lit(0), F.size("_lines") - window)
    part = lambda i, name: [F.get("_lines", i + k)[name] for k in range(window)]
    keys = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(*part(i, "a")).alias("a"), F.xxhash64(*part(i, "b")).alias("b"), reduce(Column.__or__, part(i, "w")).alias("w")))
    places = lines.select("_id", F.explode(keys).alias("k")).where("k.w").select("k.a", "k.b", F.struct(F.isnull("_id").alias("last"), "_id", F.col("k.at").alias("at")).alias("place"))
    firsts = places.groupBy("a", "b").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = storage.written(firsts, "firsts")
    repeats = places.join(firsts, ["a", "b"]).where(F.col("place") > F.col("first"))
    covered = repeats.groupBy("place._id").agg(F.array_sort(F.collect_set("place.at")).alias("starts"))
    return covered.select("_id", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))).alias("_removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs with repeated windows taken out of the text, and columns n_lines and n_removed.

    Columns of docs that have these two names are replaced; no other name can clash, for rows travel as one struct.
    """
    found = repeated_lines(docs, doc_id, text, window)
    plain = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*plain).alias("_row"), F.col(doc_id).alias("_key"), F.col(text).alias("_text")).join(found, F.col("_key").eqNullSafe(F.col("_id")), "left")
    lines = F.split(F.col("_text"), "\n")
    # Flags by position make the filter linear in the number of lines.
    flags = F.map_from_arrays("_removed", F.transform("_removed", lambda _: F.lit(True)))
    kept = F.filter(lines, lambda _, i: F.try_element_at(F.col("_flags"), i).isNull())
    rows = rows.withColumn("_flags", F.when(F.col("_removed").isNotNull(), flags))
    new = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in plain],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_windows(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w
  WHERE regexp_matches(win, '[^\\n\\t\\r\\x0b\\x0c ]')
), r AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM f WHERE k > 1
), s AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[j] FOR j IN range(1, len(lines) + 1) IF NOT list_contains(gone, j)], chr(10)) END AS text
FROM d LEFT JOIN s USING (doc_id)
"""
