"""Chunks: runs of whole documents, compressed, as the unit in which corpus-wide questions are asked and answered.

A question about every word or window of a corpus would shuffle one row for each.  Instead each chunk sorts and
combines its own items, and the items of a group of chunks (up to ``GROUP_BYTES`` of text of one task) are packed by
part (a hash range of the item) and sent as one row per part; each part merges the packed items of all groups and
answers every row by one, in the order asked.  So a question has at most one row for each pair of a group and a part,
which is what a plain shuffle has in blocks, and a frequent item reaches its part once per chunk, however often it
occurs.  Chunks are a written table, so an answer always meets the group that asked; it is bucketed by group, so answers
come to the chunks, and the chunks' texts are never shuffled.  Groups are numbered so that they fill buckets evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import storage

CHUNK_BYTES = 2 << 20
GROUP_BYTES = 8 << 20
ROW_BYTES = 32  # what a row counts beside its text, so that empty texts fill chunks too
ASKED_BYTES = 32 << 20  # of items that wait in a task; a group with more asks in several rows per part
_CODEC = pa.Codec("zstd", 6)
_FAST = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed column by column; bytes of equal rank lie together, so that small numbers take few."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        small = _FAST.compress(planes.tobytes(), asbytes=True)
        out += [np.array([planes.size, len(small)], "<i8").tobytes(), small]
    return b"".join(out)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        raw, small = (int(x) for x in np.frombuffer(blob, "<i8", 2, at))
        planes = np.frombuffer(_FAST.decompress(blob[at + 16 : at + 16 + small], raw, asbytes=True), np.uint8)
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes.reshape(size, raw // size).T).view(kind).ravel())
        at += 16 + small
    return out


def _seal(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def rows_of(blob: bytes) -> pa.RecordBatch:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"))
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_next_batch()


def group_number(task: int, k: int, buckets: int) -> int:
    """A number of the task's k-th group whose bucket is the next in turn."""
    first = (task << 36) + (k << 20)
    tries = first + np.arange(min(16 * buckets, 1 << 20))
    good = np.flatnonzero(storage.bucket(tries, buckets) == (task + 7919 * k) % buckets)
    return int(tries[good[0]]) if len(good) else first


def chunked(docs: DataFrame, name: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """docs, whose column text is a string, as a table (grp, chunk, blob); a text over the limit is a chunk's last."""

    storage.bound_batches(docs.sparkSession)
    buckets = storage.shuffle_partitions(docs.sparkSession)

    def run(batches):
        task, count, group, in_group, k = TaskContext.get().partitionId(), 0, None, 0, 0
        held, size = [], 0

        def flush():
            nonlocal count, held, size, group, in_group, k
            if group is None or in_group + size > GROUP_BYTES:
                group, in_group, k = group_number(task, k, buckets), 0, k + 1
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.record_batch([pa.array([group], pa.int64()), pa.array([count], pa.int32()), pa.array([_seal(whole)], pa.binary())], ["grp", "chunk", "blob"])
            count, in_group, held, size = count + 1, in_group + size, [], 0
            return out

        for batch in batches:
            text = batch.column("text")
            ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), float)) + ROW_BYTES)
            row = 0
            while row < len(batch):
                base = ends[row - 1] if row else 0.0
                end = min(len(batch), int(np.searchsorted(ends, base + limit - size, "left")) + 1)
                held.append(batch.slice(row, end - row))
                size += ends[end - 1] - base
                row = end
                if size >= limit:
                    yield flush()
        if held and sum(map(len, held)):
            yield flush()

    return storage.bucketed(docs.mapInArrow(run, "grp long, chunk int, blob binary"), name, "grp")


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)][: len(cuts)], strict=True))


ASKED = "grp long, part long, asked binary"
ANSWER = "grp long, part long, answer binary"


def even_parts(spark, least: int) -> np.ndarray:
    """Names of parts, at least so many and as many for each shuffle partition: Spark's hash deals them out evenly."""
    buckets = storage.shuffle_partitions(spark)
    each, tried = max(1, -(-least // buckets)), 0
    found = np.zeros(0, np.int64)
    while len(found) < each * buckets:
        tried = 2 * tried or 8 * each * buckets + 1000
        at = storage.bucket(np.arange(tried), buckets)
        order = np.argsort(at, kind="stable")
        rank = np.arange(tried) - np.searchsorted(at[order], at[order])
        found = order[rank < each][np.argsort(rank[rank < each], kind="stable")]
    return found


class _Asked:
    """What a group's chunks ask, until it is sent."""

    def __init__(self):
        self.chunks, self.parts, self.items, self.size = [], [], [], 0

    def add(self, chunk: int, part: np.ndarray, items: tuple[np.ndarray, ...]) -> None:
        self.chunks.append(chunk)
        self.parts.append(part)
        self.items.append(items)
        self.size += sum(a.nbytes for a in items)

    def rows(self, group: int, parts: np.ndarray) -> pa.RecordBatch:
        """One per part that has items: chunks, their numbers of items, and the items, which keep their order within a chunk."""
        part, n = np.concatenate(self.parts), len(self.chunks)
        at = np.repeat(np.arange(n), [len(p) for p in self.parts])
        order = np.argsort(part, kind="stable")
        items = [np.concatenate(c)[order] for c in zip(*self.items, strict=True)]
        part, at = part[order], at[order]
        spans, numbers = runs(part), np.array(self.chunks, "<u4")
        blobs = [pack(numbers, np.bincount(at[x:y], minlength=n).astype("<u4"), *(a[x:y] for a in items)) for x, y in spans]
        return pa.record_batch([pa.array([group] * len(spans), pa.int64()), pa.array([int(parts[part[x]]) for x, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], ["grp", "part", "asked"])


def asks(batches: Iterator[pa.RecordBatch], parts: np.ndarray, question: Callable[..., tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Rows of ASKED for chunks; question(row) gives the number of each item's part in parts, and the items as arrays."""
    held, now = _Asked(), None
    for batch in batches:
        for row in rows_in(batch):
            if held.chunks and (row["grp"] != now or held.size > ASKED_BYTES):
                yield held.rows(now, parts)
                held = _Asked()
            now = row["grp"]
            held.add(row["chunk"], *question(row))
    if held.chunks:
        yield held.rows(now, parts)


def rows_in(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one at a time: blobs are large."""
    for i in range(len(batch)):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def read_asked(table: pa.Table, *kinds: str) -> tuple[list, list[np.ndarray]]:
    """What was asked of a part: the rows' heads and sizes, and all items."""
    asked = [unpack(x, "<u4", "<u4", *kinds) for x in table.column("asked").to_pylist()]
    return [(a[0], a[1], len(a[2])) for a in asked], [np.concatenate(c) for c in list(zip(*asked, strict=True))[2:]]


def answer_rows(table: pa.Table, heads: list, *answers: np.ndarray, extra: bytes | None = None) -> pa.Table:
    """Rows of ANSWER with an answer per item in the order of read_asked; extra is sent to group -1."""
    part, at, out = table.column("part")[0].as_py(), 0, []
    for chunk, n, size in heads:
        out.append(pack(chunk, n, *(a[at : at + size] for a in answers)))
        at += size
    groups = table.column("grp").to_pylist()
    if extra is not None:
        groups, out = [*groups, -1], [*out, extra]
    return pa.table([pa.array(groups, pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array(out, pa.binary())], ["grp", "part", "answer"])


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """(grp, name): what all parts say to a group."""
    return answers.groupBy("grp").agg(F.collect_list(F.struct("part", "answer")).alias(name))


class Said:
    """The answers to a group, unpacked once for all its chunks."""

    def __init__(self, parts: np.ndarray, *kinds: str):
        self.parts, self.kinds, self.group, self.by = parts, kinds, None, {}

    def to(self, row: dict, said: list[dict] | None, part: np.ndarray) -> list[np.ndarray]:
        """Of each kind, the answers in the order of the chunk's items, whose parts' numbers are given as when they were asked."""
        if self.group != row["grp"]:
            self.group, self.by = row["grp"], {}
            for x in said or []:
                chunk, n, *answers = unpack(x["answer"], "<u4", "<u4", *self.kinds)
                ends = np.cumsum(n)
                for c, a, b in zip(chunk.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
                    if b > a:
                        self.by[x["part"], c] = [v[a:b] for v in answers]
        order = np.argsort(part, kind="stable")
        found = [self.by[int(self.parts[part[order[x]]]), row["chunk"]] for x, _ in runs(part[order])]
        out = []
        for k, kind in enumerate(self.kinds):
            back = np.empty(len(part), kind)
            back[order] = np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
            out.append(back)
        return out


def answered(table: DataFrame, *answers: DataFrame) -> DataFrame:
    """The chunks, and in a column for each of the answers its array; null for a group without."""
    for a in answers:
        table = table.join(a, "grp", "left")
    return table
