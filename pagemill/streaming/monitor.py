"""The monitor as a stream: headline links with first-seen titles, appended to a table per micro-batch.

Stream state is the set of all titles seen; it grows without bound, as the use needs.  For bounded state pass
event-time rows and a watermark to `bounded`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.article import articles
from pagemill.operators.incremental import alerts, new_titles, not_done
from pagemill.sources import shared


def page_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


BINS = 64  # of the seen titles' hashes; a micro-batch reads those that its own titles fall into


def watch(pages: DataFrame, table: str, checkpoint: str, alert_table: str | None = None, every: str | None = None) -> StreamingQuery:
    """Appends (title, link) of each new title to the table, and a text per page to the alert table.

    Only pages that have a cluster of news links count.  A batch that is run again after a failure overwrites its own
    part, so every title is kept once.
    """
    spark = pages.sparkSession
    binned = F.pmod(F.xxhash64("title"), F.lit(BINS)).cast("int")
    #: Epochs without titles leave no file, so the table's schema is told, not read.
    kept = f"title string, page_id {pages.schema['page_id'].dataType.simpleString()}, link string, epoch long, bin int"

    def step(batch: DataFrame, epoch: int) -> None:
        found = shared.written(new_titles(batch).select("title", "page_id", "link", binned.alias("bin")), "titles")
        bins = [r.bin for r in found.select("bin").distinct().collect()]  # at most BINS
        seen = None
        if bins and shared.exists(spark, table):
            seen = spark.read.schema(kept).parquet(table).where((F.col("epoch") < epoch) & F.col("bin").isin(bins)).select("title")
        not_done(found, seen, "title").write.mode("overwrite").partitionBy("bin").parquet(f"{table}/epoch={epoch}")
        if alert_table and bins:
            fresh = spark.read.schema(kept).parquet(table).where(F.col("epoch") == epoch)
            alerts(fresh).write.mode("overwrite").parquet(f"{alert_table}/epoch={epoch}")

    return _started(pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), every)


def _started(writer, every: str | None) -> StreamingQuery:
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def article_sink(pages: DataFrame, path: str, checkpoint: str, every: str | None = "3 seconds", closed: bool = False) -> StreamingQuery:
    """Appends one JSON object per article that has text, every so often (None: what there is, and then end).

    closed: as in dom.parse.
    """
    rows = articles(pages, closed).where("text <> ''").select("text", "title", "date", "author", "link")
    writer = rows.writeStream.format("json").option("path", path).option("ignoreNullFields", "false").option("checkpointLocation", checkpoint)
    return _started(writer, every)


def bounded(titles: DataFrame, time: str, delay: str) -> DataFrame:
    """First-seen titles of a stream within a watermark."""
    return titles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title"])
