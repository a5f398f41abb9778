"""Sources: stored pages, raw responses, lists, done sets and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import trim_ws
from pagemill.sources import shared


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def raw_responses(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds status, headers (name to values, in order) and body, as bytes, from raw HTTP responses; null where there is no head."""
    data = F.col(raw).cast("binary")
    head = F.substring_index(data.cast("string"), "\r\n\r\n", 1)
    ok = F.rlike(head, F.lit(r"^HTTP/[0-9.]+ [0-9]{3}")) & (F.octet_length(data) >= F.octet_length(head) + 4)
    lines = F.filter(F.split(head, "\r\n"), lambda line, i: (i > 0) & F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.initcap(F.replace(trim_ws(F.substring_index(x, ":", 1)), F.lit("-"), F.lit(" "))).alias("k"), trim_ws(F.substring(x, F.instr(x, ":") + 1, F.lit(2**31 - 1))).alias("v")))
    pairs = F.transform(pairs, lambda p: F.struct(F.replace(p["k"], F.lit(" "), F.lit("-")).alias("k"), p["v"].alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))
    return rows.withColumns(
        {
            "status": F.when(ok, F.regexp_extract(head, r"^HTTP/[0-9.]+ ([0-9]{3})", 1).try_cast("int")),
            "headers": F.when(ok, headers),
            "body": F.when(ok, F.substring(data, F.octet_length(head) + 5, F.lit(2**31 - 1))),
        }
    )


def as_url(line: Column) -> Column:
    """Trimmed, with http:// before what does not start with http."""
    line = trim_ws(line)
    return F.when(F.startswith(line, F.lit("http")), line).otherwise(F.concat(F.lit("http://"), line))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(as_url(F.col("value")).alias("url"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines, blanks kept."""
    return spark.read.text(path).select(trim_ws(F.col("value")).alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): trimmed lines in file order, which pos keeps without a count over all of them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select(F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("pos"), trim_ws(F.col("value")).alias("value"))


def done_urls(lines: DataFrame, maps_only: bool = False) -> DataFrame:
    """Of lines (value): trimmed ones that start with http, and for maps end in .xml."""
    rows = lines.select(trim_ws(F.col("value")).alias("url")).where(F.startswith("url", F.lit("http")))
    return rows.where(F.endswith("url", F.lit(".xml"))) if maps_only else rows


def done_set(spark: SparkSession, path: str, maps_only: bool = False) -> DataFrame:
    """A missing file is an empty set."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], "url string")
    return done_urls(spark.read.text(path), maps_only)


def state(lines: DataFrame) -> DataFrame:
    """JSON objects (value) of title to url, as rows."""
    return lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("title", "url"))
