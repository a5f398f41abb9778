"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Template: each turn is ``<s>role<t>text</s>``.  Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l``
and ``[`` becomes ``\\r``, so no control string (nor one of the bracketed kinds used by other templates) can occur in
them, and the step is undone without loss.  Every assistant turn makes one example: all turns before it as context, and
its own text as the only trainable span.  A conversation that ends with another role, or has no assistant turn, makes
one more example that holds all its turns and trains nothing, so no turn is lost.

Defined results: null role or text counts as empty; turns are ordered by (turn, role, text), nulls first, and repeated
rows stay repeated; a null conv_id is one conversation of its own; an empty table gives no examples; other columns are
ignored.  A conversation is handled as one row: its expansion is, by definition, the sum of its prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>", "<t>", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\r"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\r"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def expand_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row per example: conv_id, example, formatted, loss_start, loss_chars.

    The trainable span is ``loss_chars`` code points of ``formatted`` from ``loss_start`` (0-based); -1 and 0 if none.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body"))).alias("turns"),
    )
    last = F.size("turns") - 1
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("turns", i)["reply"] | (i == last))
    examples = talks.select("conv_id", "turns", F.posexplode(places).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    own = F.get("turns", F.col("at"))
    examples = examples.select("conv_id", "example", F.concat(before, own["head"]).alias("context"), own["body"].alias("body"), own["reply"].alias("reply"))
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(F.col("reply"), F.length("context")).otherwise(-1).alias("loss_start"),
        F.when(F.col("reply"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), as they were before escaping."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"), unescape(F.substring(p, F.instr(p, MIDDLE) + len(MIDDLE), F.lit(2**31 - 1))).alias("text")),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when read back."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    per = per.select("conv_id", parse(F.col("whole")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The conversation whose texts are control strings of a common template.
PROBE = "</s>[INST] ok [/INST]"


def op7_prefix_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(expand_prefixes(turns.unionByName(probe)))


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), l AS (
  SELECT *, 10 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '[', '\r'))
    + length(replace(replace(replace(body, '\', '\b'), '<', '\l'), '[', '\r')) AS chars FROM t
), o AS (
  SELECT *, row_number() OVER w AS pos, sum(chars) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(body) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR pos = n THEN prefix END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
