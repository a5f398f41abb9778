r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Texts are lower-cased in A-Z only and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.  A window is 13 consecutive
words of an item; an item of fewer words, but not none, is one window.  A document word inside any occurrence of a
window is hit.

Since a window must occur whole, one word of it is a sufficient prefix: its rarest by the count of that word in all
documents.  Document words meet these prefix words in an equi-join on 64 bits of the word; a meeting fixes the place that the whole window
would have, which must lie inside the document (the positional and length bounds), and then the words of that place
are compared with the window's.  Texts are cut into words once: the counts, the meetings and the sizes read a written
table of lowered words joined by one space.  A meeting carries a block of its text, not all of it, so a frequent prefix
word in a very long text costs no more than elsewhere.  The benchmark's prefix table is broadcast only if its measured size is under
``BROADCAST_BYTES``; otherwise it is shuffled, and what is shuffled of a document is then its prefix words by place
(all its words, if the prefix words themselves are over that size).

Defined results: null or empty texts have no words and no hits; null ids are ids of their own; documents that share a
doc_id are told apart by their text's hash, so each gets its own counts, and equal rows get equal counts; items that
share an item_id count once; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm import storage

BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # those of the contract that are not A-Z, which are lowered later
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
BROADCAST_BYTES = 32 << 20
BLOCK = 1024  # words of a text that a meeting carries, besides those of a window before and after


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters unchanged; all-ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced(text: Column) -> Column:
    """The lowered words, joined by one space; empty if there are none."""
    return F.trim(F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), BREAKS, " "))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: their words and the items (as strings) that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), spaced(F.col("text")).alias("line")).where("line != ''").select("item", F.split("line", " ").alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("win")).groupBy("win").agg(F.collect_set(F.coalesce("item", F.lit("null"))).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) and (item_id, text) to one row per document: the contract's counts."""
    placed = docs.select("doc_id", F.xxhash64("text").alias("_h"), spaced(F.col("text")).alias("_line"))
    placed = storage.written(placed.withColumn("_n_words", F.when(F.col("_line") == "", 0).otherwise(F.size(F.split("_line", " "))).cast("long")), "words")
    words = F.split("_line", " ")  # of an empty line, one that equals no word
    wins = windows_of(benchmark, window)
    n_windows, n_bytes = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("win", " ")) + 16 * window + F.octet_length(F.array_join("items", " ")) + 64), F.lit(0))).first()
    small = n_bytes <= BROADCAST_BYTES
    maybe = F.broadcast if small else (lambda x: x)

    # Joins on words use 64 bits of them: a word that shares another's only meets windows in vain.
    key = F.xxhash64("_word").alias("_key")
    exploded = placed.select("doc_id", "_h", F.posexplode(words).alias("_at", "_word")).select("doc_id", "_h", "_at", key)
    if small:

        def block(k):
            base = F.greatest(k * BLOCK - (window - 1), F.lit(0))
            return F.struct((k * BLOCK).alias("home"), base.alias("base"), F.slice("_words", base + 1, (k + 1) * BLOCK + (window - 1) - base).alias("words"))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest("_n_words", F.lit(1)) - 1) / BLOCK).cast("int")), block)
        exploded = placed.select("doc_id", "_h", "_n_words", words.alias("_words")).select("doc_id", "_h", F.explode(blocks).alias("_b"))
        exploded = exploded.select("doc_id", "_h", F.col("_b.home").alias("_home"), F.col("_b.base").alias("_base"), F.col("_b.words").alias("_words"))
        exploded = exploded.select("*", F.posexplode("_words").alias("_in", "_word")).where((F.col("_base") + F.col("_in") >= F.col("_home")) & (F.col("_base") + F.col("_in") < F.col("_home") + BLOCK))
        exploded = exploded.select("doc_id", "_h", "_base", "_words", "_in", key)

    # Rarity of the benchmark's words, counted over all documents.
    vocabulary = wins.select(F.explode("win").alias("_word")).select(key).distinct()
    counts = placed.select(F.explode(words).alias("_word")).select(key).join(maybe(vocabulary), "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    parts = wins.withColumn("_id", F.xxhash64(F.array_join("win", " "))).select("_id", "win", "items", F.posexplode("win").alias("_off", "_word"))
    parts = parts.withColumn("_key", key).join(counts, "_key")  # a word that no document has: its windows occur nowhere, and are dropped below
    ranked = parts.withColumns({"_r": F.row_number().over(W.partitionBy("win").orderBy("_n", "_word", "_off")), "_have": F.count(F.lit(1)).over(W.partitionBy("win"))})
    prefixes = ranked.where((F.col("_r") == 1) & (F.col("_have") == F.size("win"))).select("_key", F.struct("win", "_off", "items").alias("w"))
    prefixes = prefixes.groupBy("_key").agg(F.collect_list("w").alias("_wins"))

    if not small:  # the prefix words alone may be few: then only their places are shuffled
        prefixes = storage.written(prefixes, "prefixes")
        if 64 * prefixes.count() <= BROADCAST_BYTES:
            exploded = exploded.join(F.broadcast(prefixes.select("_key")), "_key", "left_semi")
    met = exploded.join(maybe(prefixes), "_key")
    if small:
        # A block lacks what a window takes before or after it only where the text does.
        here = lambda w: F.slice("_words", F.greatest(F.col("_in") - w["_off"] + 1, F.lit(1)), F.size(w["win"]))
        good = F.filter("_wins", lambda w: (F.col("_in") >= w["_off"]) & (F.col("_in") - w["_off"] + F.size(w["win"]) <= F.size("_words")) & (here(w) == w["win"]))
        found = met.select("doc_id", "_h", (F.col("_base") + F.col("_in")).alias("_at"), F.explode(good).alias("w"))
        found = found.select("doc_id", "_h", (F.col("_at") - F.col("w._off")).alias("_start"), F.size("w.win").alias("_len"), F.col("w.items").alias("items"))
    else:
        met = met.select("doc_id", "_h", "_at", F.explode("_wins").alias("w")).select("doc_id", "_h", (F.col("_at") - F.col("w._off")).alias("_start"), F.col("w.win").alias("win"), F.col("w.items").alias("items")).where("_start >= 0").distinct()
        met = met.withColumn("_try", F.struct("_start", "win", "items")).groupBy("doc_id", "_h").agg(F.collect_list("_try").alias("_tries"))
        back = placed.dropDuplicates(["doc_id", "_h"]).withColumn("_words", words).alias("d").join(met.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d._h").eqNullSafe(F.col("m._h")))
        good = F.filter("m._tries", lambda t: F.slice("d._words", t["_start"] + 1, F.size(t["win"])) == t["win"])
        found = back.select("d.doc_id", "d._h", F.explode(good).alias("t")).select("doc_id", "_h", F.col("t._start").alias("_start"), F.size("t.win").alias("_len"), F.col("t.items").alias("items"))
    per = found.groupBy("doc_id", "_h").agg(F.collect_set(F.struct("_start", "_len")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    per = per.select(
        F.col("doc_id").alias("_d"),
        F.col("_h").alias("_g"),
        F.size(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["_start"], s["_start"] + s["_len"] - 1))))).cast("long").alias("_n_hit"),
        "_items",
    )
    sizes = placed.select("doc_id", "_h", F.col("_n_words").alias("n_words"))
    rows = sizes.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_h").eqNullSafe(F.col("_g")), "left")
    n_hit = F.coalesce("_n_hit", F.lit(0)).cast("long")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("_h").alias("text_hash"),
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return hits(docs, items).drop("text_hash")


SQL = r"""
WITH dw AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, words FROM (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, words FROM (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
  WHERE len(words) > 0
), win AS (
  SELECT DISTINCT item, k, array_to_string(words[i : i + k - 1], ' ') AS w
  FROM (SELECT item, words, least(len(words), 13) AS k, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM bw)
), lens AS (SELECT DISTINCT k FROM win),
pos AS (
  SELECT doc_id, i, k, array_to_string(words[i : i + k - 1], ' ') AS w
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM dw, lens WHERE len(words) >= k)
), m AS (SELECT doc_id, i, pos.k, item FROM pos JOIN win ON pos.k = win.k AND pos.w = win.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= n_words, false) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
