r"""Substring dedup by recompression.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  A window is 20 consecutive words of one document.  Each word covered by a
window whose word sequence also starts earlier (smaller doc_id, or same document and earlier start) is removed; windows
are judged on the input, not on what is left.

Recompression: in every round, runs of one symbol get one name, then symbols are dealt to a left and a right side by
their names and each left-right pair gets one name.  A name is a hash of what it stands for, so all tasks name equal
runs and pairs alike without a dictionary.  With each symbol goes its context, the words that fix that it is there:
equal word sequences have equal symbols wherever the context lies inside.  A window's anchor is, of the highest round
that has symbols whose context lies in it, the symbol least in the hash of its context; equal windows have equal anchors.

1. Chunks of documents ask which anchors occur more than once in the corpus; a window with a unique anchor is unique.
2. For the windows left, chunks send each distinct window, verified by its whole word sequence in 128 bits, with its
   first place; the parts answer whether that place is the corpus's first.
3. Each chunk marks its windows that start later, merges what they cover, and gives back the words left.

Both questions are packed (see chunks), so what is shuffled for a passage is one entry per chunk that has it.  A word
is known by 128 bits (see tokens), and a word sequence by two independent 64-bit sums over the halves of these:
no sequence of words is known to make two windows alike, and by chance two differ in 128 bits.

Defined results: a null text has no words, and its text left is empty; texts of fewer than 20 words are whole; rows
that share a doc_id tie, and of equal windows with equal first places all stay; a null doc_id comes last; an empty table
gives none; doc_id must be an integer; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import chunks, storage, tokens

WINDOW = 20
ROUNDS = 3
_FAR = 1 << 40
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(8)]
_M = np.uint64(0xD6E8FEB86659FD93)


def recompress(name: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from 0: the contexts (first word, word after the last) of its symbols; _FAR beyond a document's edge."""
    first = np.arange(len(name))
    left, right = first.copy(), first + 1
    out = [(left, right)]
    for k in range(rounds):
        # Runs: a run is known once the symbols on both sides of it are.
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(name)) - 1
        n = (tails - heads + 1).astype(np.uint64)
        edge_left = np.append(True, row[heads[1:]] != row[heads[1:] - 1]) if len(heads) else np.zeros(0, bool)
        edge_right = np.append(edge_left[1:], True)
        left = np.where(edge_left, -_FAR, left[np.maximum(heads - 1, 0)])
        right = np.where(edge_right, _FAR, right[np.minimum(tails + 1, len(name) - 1)])
        name = np.where(n > 1, tokens.mix(name[heads] * _M + n + _SALTS[k]), name[heads])
        row = row[heads]
        # Pairs: a left symbol before a right one; a symbol that stays alone is known once its other neighbour is.
        side = (tokens.mix(name ^ _SALTS[k]) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = ~side[:-1] & side[1:] & (row[1:] == row[:-1])
        second = np.zeros(len(name), bool)
        second[1:] = joins[:-1]
        keep = np.flatnonzero(~second)
        pair = joins[keep]
        after, before = np.minimum(keep + 1, len(name) - 1), np.maximum(keep - 1, 0)
        edge_left, edge_right = (keep == 0) | (row[before] != row[keep]), (keep == len(name) - 1) | (row[after] != row[keep])
        alone_left = np.where(side[keep], np.where(edge_left, -_FAR, left[before]), left[keep])
        alone_right = np.where(side[keep], right[keep], np.where(edge_right, _FAR, right[after]))
        name = np.where(pair, tokens.mix(name[keep] * _M + name[after] * _SALTS[7] + _SALTS[k]), name[keep])
        left, right = np.where(pair, left[keep], alone_left), np.where(pair, right[after], alone_right)
        row = row[keep]
        out.append((left, right))
    return out


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64, grown on demand."""

    base, held = 0x9E3779B97F4A7C15, (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.held[0]) < n:
            made = []
            for x in (cls.base, pow(cls.base, -1, 1 << 64)):
                steps = np.full(max(n, 1 << 16), x, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            cls.held = tuple(made)
        return cls.held


class Windows:
    """The windows of a slice: their first words, anchors, and word-sequence hashes."""

    def __init__(self, s: tokens.Slice, window: int = WINDOW):
        names = s.names
        self.window, self.hashes, self.checks, self.rows = window, np.ascontiguousarray(names[:, 0]), np.ascontiguousarray(names[:, 1]), s.word_rows
        self.first = s.words[2]
        h, m = self.hashes, len(self.hashes) - window + 1
        self.at = np.flatnonzero(self.rows[: max(m, 0)] == self.rows[window - 1 :]) if m > 0 else np.zeros(0, np.int64)
        self.powers = Powers.upto(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.powers[0][: len(h)], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[b] - self.sums[a]) * self.powers[1][a] + (b - a).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window: its anchor's name (59 bits) and place."""
        w = self.window
        best = np.full(len(self.hashes) + 1, _NONE)
        valid = np.zeros(len(self.hashes) + 1, bool)
        valid[self.at] = True
        for left, right in reversed(recompress(self.hashes, self.rows)):
            open_ = np.zeros(len(best) + 1, np.int64)
            np.cumsum(valid & (best == _NONE), out=open_[1:])
            if not open_[-1]:
                break
            use = (right - left <= w) & (left >= 0) & (right <= len(self.hashes))
            left, right = left[use], right[use]
            low = np.maximum(right - w, 0)
            use = open_[left + 1] > open_[low]
            left, right, low = left[use], right[use], low[use]
            key = self.span(left, right) & ~np.uint64(31)
            level = np.full(len(best), _NONE)
            for k in range(w):
                start = left - k
                ok = start >= low
                if not ok.any():
                    break
                np.minimum.at(level, start[ok], key[ok] | np.uint64(k))
            best = np.where(best == _NONE, level, best)
        best = best[self.at]
        return best >> np.uint64(5), self.at + (best & np.uint64(31)).astype(np.int64)

    def sequences(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words of windows."""
        check = np.zeros(len(at), np.uint64)
        for k in range(self.window):
            check = check * _M + self.checks[at + k]
        return self.span(at, at + self.window), tokens.mix(check)


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column("doc_id").cast(pa.int64())
    return ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


class Chunk:
    """The windows of a chunk, in one order that every step repeats."""

    def __init__(self, blob: bytes, window: int):
        self.batch = chunks.rows_of(blob)
        self.windows = [Windows(s, window) for s in tokens.slices(self.batch.column("text"))]
        found = [w.anchors() for w in self.windows]
        self.names = np.concatenate([n for n, _ in found]) if found else np.zeros(0, np.uint64)
        self.places = [p for _, p in found]
        self.distinct = np.unique(self.names)

    def repeated_names(self) -> np.ndarray:
        """Of the distinct names: those at two places within the chunk (names met again out of line count as repeated)."""
        out, again = np.zeros(len(self.distinct), np.int64), 0
        for w, p in zip(self.windows, self.places, strict=True):
            n = self.names[again : again + len(p)]
            again += len(p)
            new = np.ones(len(n), bool)
            new[1:] = (n[1:] != n[:-1]) | (p[1:] != p[:-1])
            out += np.bincount(np.searchsorted(self.distinct, n[new]), minlength=len(out))
        return out > 1

    def distinct_windows(self, open_names: np.ndarray):
        """Of the windows with these anchors: slice, place, doc, start; and each one's group, and the groups' keys and first places."""
        use = open_names[np.searchsorted(self.distinct, self.names)] if len(self.names) else np.zeros(0, bool)
        ids, parts, at = _doc_ids(self.batch), [], 0
        row0 = 0
        for k, w in enumerate(self.windows):
            mine = w.at[use[at : at + len(w.at)]]
            at += len(w.at)
            key, check = w.sequences(mine)
            rows = w.rows[mine]
            parts.append((np.full(len(mine), k), mine, ids[row0 + rows], (mine - w.first[rows]).astype(np.uint32), key, check))
            row0 += len(w.first) - 1
        piece, place, doc, start, key, check = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 6
        order = np.lexsort((start, doc, check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new]
        return piece, place, doc, start, group, (key[lead], check[lead], doc[lead], start[lead])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (tokens.mix(keys) % np.uint64(parts)).astype(np.int32)


def _more_than_once(table: pa.Table) -> pa.Table:
    heads, (values,) = chunks.read_asked(table, "<u8")
    _, inverse, n = np.unique(values >> np.uint64(1), return_inverse=True, return_counts=True)
    flagged = np.bincount(inverse, (values & np.uint64(1)).astype(float), len(n)) > 0
    return chunks.answer_rows(table, heads, ((n > 1) | flagged)[inverse].astype("u1"))


def _is_first(table: pa.Table) -> pa.Table:
    heads, (key, check, doc, start) = chunks.read_asked(table, "<u8", "<u8", "<i8", "<u4")
    order = np.lexsort((start, doc, check, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    lead = order[new][np.cumsum(new) - 1]
    out = np.empty(len(order), "u1")
    out[order] = (doc[order] == doc[lead]) & (start[order] == start[lead])
    return chunks.answer_rows(table, heads, out)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, n_words, n_removed, text (the words left, joined by one space)."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = chunks.chunked(docs.select("doc_id", "text"), "substrings")
    # A part's items follow the shuffle partitions, and the chunks where these are set too few for the input.
    parts = chunks.even_parts(spark, table.count() // 64)

    def ask_names(batches):
        def question(row):
            c = Chunk(row["blob"], window)
            return _part(c.distinct, len(parts)), ((c.distinct << np.uint64(1)) | c.repeated_names().astype(np.uint64),)

        yield from chunks.asks(batches, parts, question)

    names = table.mapInArrow(ask_names, chunks.ASKED).groupBy("part").applyInArrow(_more_than_once, chunks.ANSWER)
    names = storage.written(chunks.gathered(names, "names"), "anchors")
    storage.release(spark)

    def ask_windows(batches):
        said = chunks.Said(parts, "u1")

        def question(row):
            c = Chunk(row["blob"], window)
            (opened,) = said.to(row, row["names"], _part(c.distinct, len(parts)))
            *_, lead = c.distinct_windows(opened.astype(bool))
            return _part(lead[0], len(parts)), lead

        yield from chunks.asks(batches, parts, question)

    windows = chunks.answered(table, names).mapInArrow(ask_windows, chunks.ASKED).groupBy("part").applyInArrow(_is_first, chunks.ANSWER)
    windows = storage.written(chunks.gathered(windows, "windows"), "windows")
    storage.release(spark)

    def cut(batches):
        names_said, windows_said = chunks.Said(parts, "u1"), chunks.Said(parts, "u1")
        for batch in batches:
            for one in chunks.rows_in(batch):
                c = Chunk(one["blob"], window)
                (opened,) = names_said.to(one, one["names"], _part(c.distinct, len(parts)))
                piece, place, doc, start, group, lead = c.distinct_windows(opened.astype(bool))
                (is_first,) = windows_said.to(one, one["windows"], _part(lead[0], len(parts)))
                stays = (is_first[group] > 0) & (doc == lead[2][group]) & (start == lead[3][group]) if len(group) else np.zeros(0, bool)
                n_words, n_removed, left = [], [], []
                text, row = c.batch.column("text"), 0
                for k, w in enumerate(c.windows):
                    gone = place[(piece == k) & ~stays]
                    marks = np.zeros(len(w.hashes) + 1, np.int64)
                    np.add.at(marks, gone, 1)
                    np.add.at(marks, gone + window, -1)
                    covered = np.cumsum(marks)[:-1] > 0
                    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                        words = (text[row].as_py() or "").encode().split()
                        removed = int(covered[a:b].sum())
                        if removed:
                            words = [x for x, g in zip(words, covered[a:b], strict=True) if not g]
                        n_words.append(int(b - a))
                        n_removed.append(removed)
                        left.append(b" ".join(words).decode())
                        row += 1
                yield pa.record_batch([c.batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    out = storage.written(chunks.answered(table, names, windows).mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, text string"), "deduped")
    for df in (table, names, windows):
        storage.delete(df)
    return out


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM (
    SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20))
), g AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM w WHERE k > 1) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(gone, j)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
