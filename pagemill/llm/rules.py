r"""Quality rules: exact text counts, and a hashed word and character n-gram logistic regression.

Words are ``[^\x20\x09-\x0D]+``.  The model's features are a text's relative frequencies of hashed words, character
trigrams and character 4-grams (``BUCKETS`` buckets each).  It is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the
smallest hashes of their ids, four fifths of them for the weights and the rest for the probability calibration (Platt).
A text is kept if it passes the base rules and its probability of being good is at least ``KEEP_AT``.  All texts are
counted and scored whole, in Arrow batches cut into slices of about 256 KB.  Equal lines and windows are found by the
exact codes of their bytes and words, not by hashes.

Defined results: a null or empty text has no words and fails the base rules; repeated rows are scored each, and of
rows that share a labelled id the least text is learnt from; rows without a label are only scored, labels without a row are not used, a null label counts as absent; without labels of
both kinds the base rules decide alone; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import chunks, linear, storage, tokens

BUCKETS = 1 << 16
TRAIN_ROWS = 4000
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SCALE = 30.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SPACE = tokens._SPACE


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _occurrence(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: how many items equal it, and whether one of them comes before."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group = np.cumsum(new) - 1
    n, later = np.empty(len(key), np.int64), np.empty(len(key), bool)
    n[order], later[order] = np.bincount(group, minlength=1)[group], ~new
    return n, later


def counts(s: tokens.Slice) -> dict[str, np.ndarray]:
    start, end, first = s.words
    rows = s.row1 - s.row0
    inside = ~_SPACE[s.data]
    l0, l1, lfirst = s.split(_NEWLINE)
    seen = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    line_rows = np.repeat(np.arange(rows), np.diff(lfirst))
    real = seen[l1] > seen[l0]
    line_rows = line_rows[real]
    lines, _ = tokens.coded(s.data, l0[real], l1[real])
    _, again = _occurrence(tokens.grouped(lines, line_rows))
    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        same = s.word_rows[:-2] == s.word_rows[2:]
        at = np.flatnonzero(same)
        n, _ = _occurrence(tokens.grouped(s.codes[at], s.codes[at + 1], s.codes[at + 2], s.word_rows[at]))
        hit = at[n > 1]
        for k in range(3):
            covered[hit + k] = True
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": _per_row(inside & ((s.data & 0xC0) != 0x80), s.offs),
        "n_symbols": _per_row(_SYMBOL[s.data], s.offs),
        "n_dup_lines": np.bincount(line_rows[again], minlength=rows).astype(np.int64),
        "n_repeat_words": np.bincount(s.word_rows[covered], minlength=rows).astype(np.int64),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def code_points(s: tokens.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The slice's characters as numbers, and each row's first (rows + 1)."""
    decode = lambda raw: np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = decode(s.data.tobytes())
    leads = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data & 0xC0) != 0x80, out=leads[1:])
    if leads[-1] == len(points):
        return points, leads[s.offs]
    rows = [decode(s.data[a:b].tobytes()) for a, b in zip(s.offs[:-1], s.offs[1:], strict=True)]  # broken UTF-8
    return np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def features(s: tokens.Slice) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: the bucket of every item, and the rows' bounds in them."""
    out = [((s.hashes >> np.uint64(48)).astype(np.int32), s.words[2])]
    points, offs = code_points(s)
    for family, n in enumerate((3, 4), 1):
        m = len(points) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(len(offs), np.int64)))
            continue
        gram = np.zeros(m, np.uint32)
        for k in range(n):
            gram = gram * np.uint32(0x9E3779B1) + points[k : k + m]
        gram ^= gram >> np.uint32(15)
        gram = (gram * np.uint32(0x85EBCA6B)) >> np.uint32(16)
        ends = np.maximum(offs[1:] - n + 1, offs[:-1])
        inside = np.zeros(m + 1, np.int32)
        np.add.at(inside, np.minimum(offs[:-1], m), 1)
        np.add.at(inside, np.minimum(ends, m), -1)
        gram = gram[np.cumsum(inside)[:m] > 0]
        bounds = np.zeros(len(offs), np.int64)
        np.cumsum(ends - offs[:-1], out=bounds[1:])
        out.append((gram.astype(np.int32) + family * BUCKETS, bounds))
    return out


def scores(s: tokens.Slice, weights: np.ndarray) -> np.ndarray:
    total = np.full(s.row1 - s.row0, float(weights[-1]))
    for bucket, bounds in features(s):
        sums = np.zeros(len(bucket) + 1)
        np.cumsum(weights[bucket], out=sums[1:])
        n = np.diff(bounds)
        total += SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
    return total


def _vectors(batches):
    """Labelled texts to sparse counts, packed: buckets (by difference), counts, and each family's total."""
    for batch in batches:
        out = []
        for s in tokens.slices(batch.column("text")):
            found = features(s)
            for r in range(s.row1 - s.row0):
                parts = [np.unique(b[o[r] : o[r + 1]], return_counts=True) for b, o in found]
                index = np.concatenate([p[0] for p in parts])
                out.append(chunks.pack(np.diff(index, prepend=0).astype("<i4"), np.concatenate([p[1] for p in parts]).astype("<u4"), np.array([p[1].sum() for p in parts], "<i8")))
        yield pa.record_batch([pa.array(out, pa.binary()), batch.column("y").cast(pa.int32())], ["vector", "y"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and scaled frequencies; the bias's bucket last, with value 0."""
    step, count, totals = chunks.unpack(blob, "<i4", "<u4", "<i8")
    index = np.append(np.cumsum(step, dtype=np.int32), np.int32(3 * BUCKETS))
    value = SCALE * count / np.maximum(totals, 1)[index[:-1] // BUCKETS]
    return index, np.append(value.astype(np.float32), np.float32(0))


def sampled_labels(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most limit labelled ids, those with the smallest hashes, as (_id, y)."""
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(column).alias("y"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> np.ndarray | None:
    """Calibrated weights, the bias last; None if the sample lacks one of the labels."""
    storage.bound_batches(docs.sparkSession)
    sample = F.broadcast(sampled_labels(labels, "quality", limit))  # at most limit rows of two numbers
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.select("text", "y").mapInArrow(_vectors, "vector binary, y int").toArrow()
    pairs = sorted(zip(got.column("vector").to_pylist(), got.column("y").to_pylist(), strict=True))  # a fixed order keeps reruns equal
    del got
    y = np.array([p[1] for p in pairs], np.int64)
    held = np.arange(len(y)) % 5 == 0
    if len(y) < 10 or y[~held].min() == y[~held].max():
        return None

    def packed(keep):
        made = [_unpacked(pairs[i][0]) for i in np.flatnonzero(keep)]
        return np.cumsum([0, *(len(i) for i, _ in made)]), np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made])

    weights = linear.fit_sparse(*packed(~held), y[~held], 3 * BUCKETS, 1e-5)
    starts, idx, val = packed(held)
    slope, offset = linear.platt(np.add.reduceat(val * weights[idx], starts[:-1]) + weights[-1], y[held])
    weights = weights * slope  # without a slope every text has the rate of the held rows
    weights[-1] += offset
    return weights.astype(np.float32)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
NAMES = [x.strip().split()[0] for x in SCHEMA.split(",")]


def judge(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """The rows of docs with the counts, the verdict and the probability of being good (1 without a model).

    Columns of docs that have one of these names are replaced; others pass through.  text names a column, or a field of
    a struct column as in "row.text".
    """
    storage.bound_batches(docs.sparkSession)
    column, *fields = text.split(".")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    kept_columns = [c for c in docs.columns if c not in NAMES]

    def run(batches):
        for batch in batches:
            parts, texts = [], batch.column(column)
            for name in fields:
                texts = texts.field(name)
            for s in tokens.slices(texts):
                c = counts(s)
                c["base_failed"] = base_failed(c)
                c["quality"] = linear.sigmoid(scores(s, shared.value)) if shared.value is not None else np.ones(s.row1 - s.row0)
                c["kept"] = ~c["base_failed"] & (c["quality"] >= KEEP_AT)
                parts.append(c)
            new = [pa.array(np.concatenate([p[n] for p in parts]) if parts else []) for n in NAMES]
            yield pa.record_batch([*(batch.column(c) for c in kept_columns), *(a.cast(t) for a, t in zip(new, [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True))], [*kept_columns, *NAMES])

    rows = docs.select(*kept_columns)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(SCHEMA).fields]))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return judge(docs, fit(docs, labels)).drop("text")
