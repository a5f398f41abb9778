"""Toxicity with noisy-channel deobfuscation.

A writer who hides a word replaces letters (``1d10t``), repeats them (``stuuupid``) or spaces them out (``s c u m``).
Tokens that show one of these marks are decoded: every character spans a lattice of the letters it may stand for
(or none, for separators and repeats), and the Viterbi path under a character trigram model gives the restored word.
Tokens of any length and script are decoded: accents fold or fall away, and letters of other scripts among Latin ones
count as look-alikes.  A token with separators is read as one word and as the words between them; spaced letters as one
word, as several, and as every run of 4 to 12 letters, since nothing tells where words begin in them.
The trigram model counts the plain words of all documents.  Texts are then scored by their plain and restored words.

The score: a lexicon of words and word beginnings, each with its smoothed log-odds between toxic and other labelled
texts, turns a text into six numbers (strongest and summed evidence, shares), and a logistic regression turns these
into a probability.  Lexicon and regression learn from at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hashes of their ids, among rows whose crc32(doc_id as text) mod 5 is not 0; neither labels nor lang, source or doc_id
is an input of a score.  Whole texts are scored, in Arrow batches.

Defined results: null and empty texts have no evidence and get the score of none; a null doc_id has a null remainder
and counts as not held out, and is never a training row; repeated rows are scored each, and of rows that
share a labelled id the least text is learnt from; without labels of both kinds
all scores are 0; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import linear, rules, storage, tokens

TRAIN_ROWS = 12000
MIN_DOCS, MIN_ODDS = 3, 2.0
STEM = 5

#: The letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "п": "n",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "κ": "k",
}
SEPARATORS = ".-_*~'/ "
SPACED_PARTS = 4, 13  # lengths (the last not included) of the words that spaced letters may hide anywhere
LOG_BOUNDARY = np.log(0.1)  # of a word that ends within spaced letters
LOG_SWAP, LOG_DROP_SEPARATOR, LOG_DROP_REPEAT, LOG_KEEP_REPEAT, LOG_WILD = np.log(0.3), np.log(0.5), np.log(0.9), np.log(0.05), np.log(0.02)

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the Latin-1 capitals in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


class Words:
    """Plain words (runs of letters and digits, lowered) of a slice: names, names of their beginnings, rows."""

    def __init__(self, s: tokens.Slice):
        low = tokens.Slice(s.row0, s.row1, lowered(s.data), s.offs)
        start, end, first = low.split(_BREAK)
        codes, spans = tokens.coded(low.data, start, end)
        names, stems = hash_words(spans)
        self.first, self.words, self.stems = first, names[codes], stems[codes]
        self.rows = np.repeat(np.arange(s.row1 - s.row0), np.diff(first))


def hash_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of words and of their beginnings; 0 for the beginning of a shorter word."""
    size = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1])
    return tokens.names_of(words)[:, 0], np.where(size >= STEM, tokens.names_of(words, STEM)[:, 0] ^ np.uint64(1), np.uint64(0))


# -- the character model and the decoder ------------------------------------------------------------------------------

LETTERS = 27  # a-z, and 0 for a word's edge


def count_trigrams(s: tokens.Slice) -> np.ndarray:
    """Counts of letter trigrams of words of a-z only, edges included."""
    low = _LOWER[s.data]
    code = np.where((low >= 0x61) & (low <= 0x7A), low - 0x60, np.where(tokens._SPACE[low], 0, 255)).astype(np.int64)
    # Rows touch in the buffer: an edge is put between them, two for the model's order.
    code = np.insert(code, np.repeat(s.offs, 2), 0)
    space = np.flatnonzero(code == 0)
    code = np.insert(code, space, 0)
    a, b, c = code[:-2], code[1:-1], code[2:]
    good = (a != 255) & (b != 255) & (c != 255)
    return np.bincount((a[good] * LETTERS + b[good]) * LETTERS + c[good], minlength=LETTERS**3)


def trigram_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), smoothed by bigrams and unigrams, from all documents; a fixed-size table per task."""

    def run(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for s in tokens.slices(batch.column("text")):
                total += count_trigrams(s)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(LETTERS**3)
    three[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    three = three.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3)


@functools.cache
def folded(sign: str) -> str:
    """The letter of a-z under an accent or in another width, or ''."""
    base = unicodedata.normalize("NFKD", sign)[:1].lower()
    return base if "a" <= base <= "z" else ""


def arcs_at(token: str, i: int) -> list[tuple[int, float]]:
    """What the sign at a place may stand for, with its cost: a letter from 1, or nothing (-1)."""
    sign = token[i]
    arcs: list[tuple[int, float]] = []
    repeat = i > 0 and token[i - 1] == sign
    run = repeat and (i > 1 and token[i - 2] == sign or i + 1 < len(token) and token[i + 1] == sign)
    if "a" <= sign <= "z":
        arcs.append((ord(sign) - 96, LOG_KEEP_REPEAT if run else 0.0))
    else:
        accented = not sign.isascii() and sign not in LOOKALIKES and not "\uff00" < sign < "\uff5f"
        options = LOOKALIKES.get(sign) or folded(sign)
        for o in options:
            arcs.append((ord(o) - 96, (0.0 if accented else LOG_WILD if len(options) > 2 else LOG_SWAP) + (LOG_KEEP_REPEAT if run else 0.0)))
        if accented and not repeat:
            arcs.append((-1, LOG_DROP_SEPARATOR))
    if repeat:
        arcs.append((-1, LOG_DROP_REPEAT if run else LOG_DROP_SEPARATOR - 2))
    elif sign in SEPARATORS:
        arcs.append((-1, LOG_DROP_SEPARATOR))
    return arcs or [(-1, LOG_WILD)]


def decode(token: str, model: list, spaced: bool = False) -> str:
    """The most probable plain word behind a token, by Viterbi over its lattice, in time linear in its length.

    model: log P as nested lists [a][b][c].  States are the last two letters.  spaced: a word may end before any letter,
    and the result is words with blanks between.
    """
    token = _LONG_REPEAT.sub(r"\1\1\1", token.lower())
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # and the path: a letter and the path before it
    for i in range(len(token)):
        arcs = arcs_at(token, i)
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (p, path) in best.items():
            row = model[a][b]
            for letter, cost in arcs:
                state, q = ((a, b), p + cost) if letter < 0 else ((b, letter), p + cost + row[letter])
                if state not in new or q > new[state][0]:
                    new[state] = (q, path if letter < 0 else (chr(96 + letter), path))
                if spaced and letter > 0 and b:
                    state, q = (0, letter), p + cost + row[0] + LOG_BOUNDARY + model[0][0][letter]
                    if state not in new or q > new[state][0]:
                        new[state] = (q, (" " + chr(96 + letter), path))
        best = new
    end = max(best, key=lambda ab: (best[ab][0] + model[ab[0]][ab[1]][0], ab))
    letters, path = [], best[end][1]
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


_LONG_REPEAT = re.compile(r"(.)\1{3,}", re.S)
_SEPARATED = re.compile(f"[{re.escape(SEPARATORS)}]+")
_EDGES = "\"'.,;:?()[]{}<>%&#=~^`"


def suspicious(token: str) -> str:
    """The part of a whitespace token to be decoded, or '' if it is plain."""
    token = token.strip(_EDGES).rstrip("*!|")
    if len(token) < 3 or not any(c.isalpha() for c in token):
        return ""
    if token.isalpha():
        low = token.lower()
        strange = [c for c in low if not c.isascii() and (c in LOOKALIKES or "\uff00" < c < "\uff5f")]
        mixed = strange and all("a" <= c <= "z" or c in strange for c in low)  # signs of another script among the letters
        return token if mixed or any(low[i] == low[i + 1] == low[i + 2] for i in range(len(low) - 2)) else ""
    return token if all(c.isalpha() or c in LOOKALIKES or c in SEPARATORS for c in token) else ""


def marked(s: tokens.Slice) -> Iterator[tuple[int, str]]:
    """(row, token) of every token with a mark in it; a vectorised screen picks the few places to look at."""
    start, end, _ = s.words
    if not len(start):
        return
    data, size = s.data, end - start
    low = _LOWER[data]
    letter = (low >= 0x61) & (low <= 0x7A)
    odd, strong = np.zeros(len(data), bool), np.zeros(len(data), bool)
    for c in [*LOOKALIKES, *"-_.'/~"]:
        odd |= data == ord(c)
    for c in "0123456789@$+":
        strong |= data == ord(c)
    # A mark counts with a letter on its right (trailing signs may be decoration); one that is no decoration, anywhere.
    odd[:-1] &= letter[1:] | (odd[1:] & (np.append(letter[2:], False)))
    odd[-1:] = False
    sums = np.zeros((2, len(data) + 1), np.int32)
    np.cumsum(odd | strong, out=sums[0, 1:])
    np.cumsum(letter, out=sums[1, 1:])
    found = (sums[0, end] > sums[0, start]) & (sums[1, end] > sums[1, start]) & (size >= 3)
    if len(low) > 2:
        triple = np.zeros(len(data), bool)
        triple[:-2] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & letter[:-2]
        np.cumsum(triple, out=sums[0, 1:])
        # the last two places of a word may begin a triple that runs into the next row only
        found |= (sums[0, np.maximum(end - 2, start)] > sums[0, start]) & (size >= 3)
    other = ((data >= 0xCE) & (data <= 0xD4)) | (data == 0xEF)  # first bytes of Greek, Cyrillic and wide letters
    if other.any():
        np.cumsum(other, out=sums[0, 1:])
        found |= (sums[0, end] > sums[0, start]) & ((sums[1, end] > sums[1, start]) | (data[start] == 0xEF))
    for w in np.flatnonzero(found):
        token = suspicious(s.text(start[w], end[w]))
        if token:
            yield int(s.word_rows[w]), token


def spaced_runs(s: tokens.Slice) -> Iterator[tuple[int, str]]:
    """(row, signs) of spaced letters: three or more tokens in line that are one sign each."""
    start, end, _ = s.words
    if not len(start):
        return
    sign, rows = _LOWER[s.data[start]], s.word_rows
    single = (end - start == 1) & (((sign >= 0x61) & (sign <= 0x7A)) | ((sign >= 0x30) & (sign <= 0x39)) | (sign == 0x40) | (sign == 0x24))
    cut = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (rows[1:] != rows[:-1]), [True]]))
    long = single[cut[:-1]] & (np.diff(cut) >= 3)
    for a, b in zip(cut[:-1][long], cut[1:][long], strict=True):
        yield int(rows[a]), s.data[start[a:b]].tobytes().decode("ascii")


def suspects(s: tokens.Slice) -> Iterator[tuple[int, str]]:
    """(row, token) of all that shows a mark."""
    yield from marked(s)
    yield from spaced_runs(s)


def restored(s: tokens.Slice, model: list, cache: dict[str, str]) -> tuple[np.ndarray, list[str]]:
    rows, words = [], []
    for spaced, found in ((False, marked(s)), (True, spaced_runs(s))):
        for row, token in found:
            key = " " + token if spaced else token
            out = cache.get(key)
            if out is None:
                out = decode(token, model)
                if spaced or any(c in SEPARATORS for c in token):  # one word, or several
                    parts = [out[a : a + n] for n in range(*SPACED_PARTS) for a in range(len(out) - n + 1)] if spaced else []
                    out = " ".join(dict.fromkeys([out, *parts, *(w for x in ([token] if spaced else _SEPARATED.split(token)) for w in decode(x, model, spaced).split(" "))]))
                if len(cache) > 200_000:
                    cache.clear()
                if len(key) <= 64:
                    cache[key] = out
            for word in out.split(" "):
                if len(word) >= 3:
                    rows.append(row)
                    words.append(word)
    return np.array(rows, np.int64), words


# -- evidence ---------------------------------------------------------------------------------------------------------


def evidence_items(s: tokens.Slice, model: list, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and hashes of all words and stems, plain and restored; and the number of plain words per row."""
    w = Words(s)
    rows, words = restored(s, model, cache)
    found, stems = hash_words(pa.array(words, pa.large_string()).cast(pa.large_binary()))
    return np.concatenate([w.rows, w.rows, rows, rows]), np.concatenate([w.words, w.stems, found, stems]), np.diff(w.first)


def numbers(s: tokens.Slice, model: list, cache: dict, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    rows, hashes, n = evidence_items(s, model, cache)
    out = np.zeros((s.row1 - s.row0, 6))
    out[:, 5] = np.log1p(n) / 10
    if len(lexicon) and len(hashes):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        hit = lexicon[at] == hashes
        rows, value = rows[hit], odds[at[hit]]
        np.maximum.at(out[:, 0], rows, value)
        total, count = np.bincount(rows, value, len(out)), np.bincount(rows, minlength=len(out))
        out[:, 1], out[:, 2] = np.log1p(total), np.log1p(count)
        out[:, 3], out[:, 4] = np.log1p(100 * count / np.maximum(n, 1)), count > 0
    return out


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    allowed = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = F.broadcast(rules.sampled_labels(allowed, "toxic", limit))  # at most limit rows of two numbers
    return docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learn_lexicon(rows: DataFrame, model: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and log-odds of the words and stems that toxic texts of the sample favour."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def toxic(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            for s in tokens.slices(batch.column("text")):
                r, h, _ = evidence_items(s, shared.value, cache)
                both = np.unique(np.stack([r[h != 0].astype(np.uint64), h[h != 0]]), axis=1)  # one place per text and word
                words, n = np.unique(both[1], return_counts=True)
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    # A text counts once on its side, however many rows are copies of it.
    texts = rows.select(F.col("y") > 0, "text").toDF("toxic", "text").where("text IS NOT NULL").distinct()
    found = texts.where("toxic").select("text").mapInArrow(toxic, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).toArrow()
    keys = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, a = keys[order], found.column("n").to_numpy()[order].astype(float)
    known = rows.sparkSession.sparkContext.broadcast(keys)  # of words in at least MIN_DOCS texts of the bounded sample

    def other(batches):
        cache: dict[str, str] = {}
        total = np.zeros(len(known.value), np.int64)
        for batch in batches:
            for s in tokens.slices(batch.column("text")):
                r, h, _ = evidence_items(s, shared.value, cache)
                at = np.minimum(np.searchsorted(known.value, h), max(0, len(known.value) - 1))
                if len(known.value):
                    hit = known.value[at] == h
                    both = np.unique(r[hit] * len(known.value) + at[hit])
                    total += np.bincount(both % len(known.value), minlength=len(known.value))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    got = texts.where("NOT toxic").select("text").mapInArrow(other, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    b = np.zeros(len(keys))
    b[got.column("at").to_numpy()] = got.column("n").to_numpy()
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = np.log((a + 0.5) / (sizes.get(True, 0) + 1)) - np.log((b + 0.5) / (sizes.get(False, 0) + 1))
    keep = odds >= MIN_ODDS
    return keys[keep], odds[keep]


class Model:
    """All that scoring needs; of a size bounded by the training sample."""

    def __init__(self, trigrams, lexicon, odds, weights):
        self.trigrams, self.lexicon, self.odds, self.weights = trigrams, lexicon, odds, weights


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    storage.bound_batches(docs.sparkSession)
    trigrams = trigram_model(docs).tolist()
    rows = storage.written(training_rows(docs, labels, limit), "sample")  # read four times below
    lexicon, odds = learn_lexicon(rows, trigrams)

    def run(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            parts = [numbers(s, trigrams, cache, lexicon, odds) for s in tokens.slices(batch.column("text"))]
            x = np.concatenate(parts) if parts else np.zeros((0, 6))
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column("y").cast(pa.int32())], ["x", "y"])

    got = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(trigrams, lexicon, odds, None)
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort([*x.T, y])
    return Model(trigrams, lexicon, odds, linear.fit_dense(x[order], y[order]))


def scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    cache: dict[str, str] = {}

    def score(texts: pa.Array) -> np.ndarray:
        parts = [numbers(s, model.trigrams, cache, model.lexicon, model.odds) for s in tokens.slices(texts)]
        x = np.concatenate(parts) if parts else np.zeros((0, 6))
        return linear.sigmoid(x @ model.weights[:-1] + model.weights[-1]) if model.weights is not None else np.zeros(len(x))

    return score


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    storage.bound_batches(docs.sparkSession)

    def run(batches):
        score = scorer(shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score(batch.column("text")), pa.float64())], ["doc_id", "held_out", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return score_texts(docs, fit(docs, labels))
