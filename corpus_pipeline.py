"""The corpus pipeline; counted as part of pagemill.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, extra ones and such with clashing names included.  The model of the first stage is fitted on labelled rows
of its own input.  Every stage gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, jaccard, lines, mixing, rules, storage


def carried(docs: DataFrame) -> DataFrame:
    """Rows as one struct, and what stages look at; no name in docs can clash with one of a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject.

    Null, empty and short texts are rejected; each of several equal rows, or rows of one doc_id, has its own verdict, which
    depends on its text alone; a null doc_id is judged like any other, and not learnt from.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.judge(docs.select(F.struct(*docs.columns).alias("_row")), rules.fit(docs, labels), "_row.text").where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line windows out of the texts; every document stays, with n_chars of the new text.

    A null text stays null, and n_chars of an unchanged text as it was; rows of one doc_id (null is one too) lose the same
    lines; a null doc_id comes last in the order that decides which copy is the first.
    """
    out = lines.dedup_lines(carried(docs))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select(*({"text": F.col("text"), "n_chars": n_chars.alias("n_chars")}.get(c, F.col("_row")[c].alias(c)) for c in docs.columns))


#: A list of ids up to this size, as measured, is broadcast; a longer one is shuffled.
BROADCAST_BYTES = 32 << 20


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each near-duplicate class; of equal rows (doc_id and text), one.

    Null ids come last, and of rows that share an id that of the least text hash first.  Null texts and texts without words
    are near-duplicates of none.
    """
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("h").eqNullSafe(F.col("class_h"))
    judged = jaccard.near_duplicates(docs).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.max(first).alias("_kept"), F.count(F.lit(1)).alias("_n"))
    judged = storage.written(judged.where("NOT _kept OR _n > 1"), "judged")
    n_lost, n_many = judged.agg(F.count_if(~F.col("_kept")), F.count_if(F.col("_kept"))).first()
    sized = F.broadcast if 40 * max(n_lost, n_many) <= BROADCAST_BYTES else (lambda x: x)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_h"))
    out = carried(docs).join(sized(judged.where("NOT _kept")), same, "left_anti")
    if n_many:  # of several rows
        many = sized(judged.where("_kept"))
        out = out.join(many, same, "left_anti").unionByName(out.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by the benchmark.

    Null and empty texts are not; rows that share a doc_id, or have none, are judged each by its own text; equal rows go or
    stay together; an empty benchmark drops nothing.
    """
    found = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = found.select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct()
    return carried(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & F.xxhash64("text").eqNullSafe(F.col("_hash")), "left_anti").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left, range-sorted by training time; one row per row.

    A null text has size 0 and is not taken; a null source is one more, ordered last; equal rows are interchangeable, and
    each counts; ids without a value are ordered by their sizes.
    """
    return mixing.placed(docs).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]

#: The first and third stages can't be stated in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages, each written and read again, make of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.written(docs, f"stage{k}")
    return docs
