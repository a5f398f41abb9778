"""Row generators for enumerated URLs, and the extract job over stored pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.templates import format_map
from pagemill.operators import dom
from pagemill.sources import readers, sinks
from pagemill.sources.config import ExtractJob


def int_range(spark: SparkSession, start: int, end: int, overrun: bool = True) -> DataFrame:
    """(pos, value) from start to end, and one more unless overrun is off; at least start."""
    last = max(start, end + (1 if overrun else 0))
    return spark.range(start, last + 1).select((F.col("id") - start).alias("pos"), F.col("id").cast("string").alias("value"))


def listed(spark: SparkSession, values: list[str]) -> DataFrame:
    """(pos, value) of a list that was given with the query."""
    return spark.createDataFrame([(values,)], "v array<string>").select(F.posexplode("v").alias("pos", "value")).select(F.col("pos").cast("bigint").alias("pos"), "value")


def stepped(spark: SparkSession, step: Callable[[str | None], str | None]) -> DataFrame:
    """(pos, value) of a generator of one's own: step(None) is the first value, step(last) the next, None the end.

    A value needs the one before it, so one task makes them all, a row at a time.
    """

    class Steps:
        def eval(self):
            value, pos = step(None), 0
            while value is not None:
                yield pos, value
                value, pos = step(value), pos + 1

    return F.udtf(Steps, returnType="pos bigint, value string")()


def lock_step(generators: dict[str, DataFrame]) -> DataFrame:
    """All generators advanced together until any ends: pos and a column per name."""
    if not generators:
        raise ValueError("no generator")
    named = [g.select("pos", F.col("value").alias(name)) for name, g in generators.items()]
    return reduce(lambda a, b: a.join(b, "pos"), named)


def enumerate_urls(template: str, generators: dict[str, DataFrame]) -> DataFrame:
    """pos and the rendered url."""
    rows = lock_step(generators)
    return rows.select("pos", format_map(template, {n: F.col(n) for n in generators}).alias("url"))


def looked_up(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Every wanted URL with its stored page's columns; null where there is none."""
    return wanted.join(pages, "url", "left")


def extract(spark: SparkSession, job: ExtractJob, pages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The job's table over stored pages: its named columns, multiple values joined by a space, rows without any dropped.

    ids: (pos, value); without them, the lines of the job's id_file, or its range of numbers.
    """
    if ids is None:
        ids = readers.numbered_lines(spark, job.id_file) if job.id_file else int_range(spark, job.start_id, job.end_id)
    wanted = enumerate_urls(job.domain, {"id": ids})
    found = dom.css_extract(looked_up(wanted, pages.select("url", "html")), job.template)
    rows = found.select("pos", *(F.array_join(n, " ").alias(n) if n in job.template else F.lit("").alias(n) for n in job.names))
    return rows.where(F.concat(*(F.col(n) for n in job.names)) != "").orderBy("pos").select(*job.names)


def run_job(spark: SparkSession, job: ExtractJob, pages: DataFrame) -> None:
    """The job from its file to its output: a CSV without header."""
    sinks.write_table(extract(spark, job, pages), job.names, job.output)
