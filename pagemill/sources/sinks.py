"""Sinks: articles, extract tables, done sets, state and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_articles(articles: DataFrame, path: str) -> None:
    """Appends one JSON object per article that has text; a missing date is written as null."""
    articles.where("text <> ''").select("text", "title", "date", "author", "link").write.mode("append").option("ignoreNullFields", "false").json(path)


def write_table(rows: DataFrame, names: list[str], path: str) -> None:
    """Headerless CSV in the order of names, without rows whose cells are all empty."""
    some = F.concat(*(F.coalesce(F.col(n), F.lit("")) for n in names)) != ""
    rows.where(some).select(*names).write.mode("overwrite").option("header", "false").option("emptyValue", "").csv(path)


def save_done(urls: DataFrame, path: str, append: bool = False) -> None:
    urls.select(F.col("url").alias("value")).write.mode("append" if append else "overwrite").text(path)


def save_state(seen: DataFrame, path: str) -> None:
    """Seen titles as a table; one row per title."""
    seen.groupBy("title").agg(F.min("url").alias("url")).write.mode("overwrite").parquet(path)


def log_rows(rows: DataFrame, level: str, message: str, at: str) -> DataFrame:
    """(ts, level, message) with the message after its time."""
    ts = F.to_timestamp(F.lit(at))
    return rows.select(ts.alias("ts"), F.lit(level).alias("level"), F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), F.col(message)).alias("message"))


def result_log(handled: DataFrame, at: str) -> DataFrame:
    """The log of handled rows: their results as `ok`, their errors as `err`."""
    return log_rows(handled.where("error IS NULL AND result IS NOT NULL"), "ok", "result", at).unionByName(log_rows(handled.where("error IS NOT NULL"), "err", "error", at))


def write_log(log: DataFrame, path: str) -> None:
    """Appends one JSON object per row."""
    log.select("ts", "level", "message").write.mode("append").json(path)
