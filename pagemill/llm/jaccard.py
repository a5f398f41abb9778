r"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its five-word shingles (words ``[^\x20\x09-\x0D]+``; one to four words make one shingle).
Two documents are linked if the Jaccard similarity of their sets is at least 0.8.

1. Documents with equal sets form one class, known by a 128-bit fingerprint of the set; only classes go on.
2. Each class has 180 MinHash values; 36 bands of 5 values find candidates.  A pair at 0.8 shares no band with a
   probability of 6e-7, one at 0.85 with 7e-10.  A band's bucket yields a star, never its pairs, and is combined
   before the shuffle; candidate components come from the stars, and every candidate pair lies within one.
3. Components are packed into cells of bounded size; a component larger than a block is cut into blocks, and each pair
   of blocks is a cell.  A cell compares the MinHash values of its candidate pairs 20 at a time and drops a pair when
   the posterior probability (uniform prior) that its similarity reaches 0.8 falls below 1e-6; what is left is
   verified exactly on the shingle sets.  A cell returns link counts and a spanning forest, not pairs.
4. Components of the verified forest are the near-duplicate classes.

Defined results: null texts and texts without words have no set: no links, a class of their own; equal rows are
copies of each other; a null doc_id takes part, but names a class only if all its ids are null; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import chunks, components, storage, tokens

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # the similarity, 0.8
BANDS, ROWS, STEP = 36, 5, 20
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 19
BROADCAST_BYTES = 32 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(s: tokens.Slice) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    h, first = s.hashes, s.words[2]
    grams, out = tokens.combine(h, SHINGLE), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(tokens.combine(h[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(items: np.ndarray) -> bytes:
    """128 bits of a set; in the order of bytes as in that of numbers."""
    with np.errstate(over="ignore"):
        x = tokens.mix(items).sum(dtype=np.uint64) + np.uint64(len(items))
        y = tokens.mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return struct.pack(">QQ", int(x), int(y))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if sets else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(flat * _A[j] + _B[j], starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def least_matches() -> dict[int, int]:
    """For each number of compared values, the fewest matches with which a pair stays."""
    t, out = NUMERATOR / DENOMINATOR, {}
    for n in range(STEP, HASHES + 1, STEP):
        posterior, m = 0.0, -1
        while posterior < TOLERANCE and m < n:
            m += 1
            posterior += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


def _sketch(batches):
    for batch in batches:
        nodes, sizes, sigs = [], [], []
        for s in tokens.slices(batch.column("text")):
            sets = shingle_sets(s)
            full = [x for x in sets if len(x)]
            made = iter(signatures(full)) if full else iter(())
            for x in sets:
                nodes.append(fingerprint(x) if len(x) else None)
                sizes.append(len(x))
                sigs.append(next(made).tobytes() if len(x) else None)
        yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "h", "node", "n", "sig"])


_ENTRY = np.dtype([("key", "<u8"), ("hi", "<u8"), ("lo", "<u8")])


def _stars(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least entry of each key; and, for the other entries, themselves and their key's least."""
    entries = entries[np.lexsort((entries["lo"], entries["hi"], entries["key"]))]
    first = np.ones(len(entries), bool)
    first[1:] = entries["key"][1:] != entries["key"][:-1]
    return entries[first], entries[~first], entries[first][np.cumsum(first) - 1][~first]


def _names(entries: np.ndarray) -> list[bytes]:
    raw = np.empty((len(entries), 2), ">u8")
    raw[:, 0], raw[:, 1] = entries["hi"], entries["lo"]
    raw = raw.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[bytes], list[bytes]]:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, _ENTRY)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, _ENTRY)
    both = np.unique(np.stack([a["hi"], a["lo"], b["hi"], b["lo"]], axis=1), axis=0) if len(a) else np.zeros((0, 4), np.uint64)
    back = lambda hi, lo: _names(np.rec.fromarrays([hi, hi, lo], dtype=_ENTRY))
    return back(both[:, 0], both[:, 1]), back(both[:, 2], both[:, 3])


def _band_rows(parts: int):
    """Bucket entries packed by part, one per bucket and batch, and the stars within the batch (part -1)."""

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("node").to_pylist()), ">u8").reshape(-1, 2)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            entries = np.empty(len(sig) * BANDS, _ENTRY)
            entries["key"] = band_keys(sig).ravel()
            entries["hi"], entries["lo"] = np.repeat(raw[:, 0], BANDS), np.repeat(raw[:, 1], BANDS)
            heads, rest, least = _stars(entries)
            u, v = _edges([(rest, least)])
            part = ((heads["key"] >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            heads, part = heads[order], part[order]
            spans = chunks.runs(part)
            blobs = [heads[a:b].tobytes() for a, b in spans]
            yield pa.record_batch(
                [pa.array([*(int(part[a]) for a, _ in spans), *[-1] * len(u)], pa.int32()), pa.array([*blobs, *[None] * len(u)], pa.binary()), pa.array([*[None] * len(blobs), *u], pa.binary()), pa.array([*[None] * len(blobs), *v], pa.binary())], ["part", "entries", "u", "v"]
            )

    return run


def _meet(table: pa.Table) -> pa.Table:
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY)
    _, rest, least = _stars(entries)
    u, v = _edges([(rest, least)])
    return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def _cell_rows(batches):
    """Texts to (cell, side, node, weight, shingles), checked against the class they stand for; rows of one class, once."""
    done = set()
    for batch in batches:
        rows, sets = [], []
        nodes = batch.column("node").to_pylist()
        for s in tokens.slices(batch.column("text")):
            for i, x in enumerate(shingle_sets(s), s.row0):
                if len(x) and nodes[i] not in done and fingerprint(x) == nodes[i]:
                    done.add(nodes[i])
                    rows.append(i)
                    sets.append(x.tobytes())
        kept = batch.select(["cells", "block", "node", "weight"]).take(pa.array(rows, pa.int64()))
        yield pa.record_batch([*kept.columns, pa.array(sets, pa.binary())], ["cells", "block", "node", "weight", "items"])


def candidate_pairs(sig: np.ndarray, block: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that share a band; of a cell of two blocks, only pairs across them."""
    m = len(sig)
    met = np.zeros((m, m), bool)
    keys = band_keys(sig)
    for b in range(BANDS):
        order = np.argsort(keys[:, b], kind="stable")
        k, d = keys[order, b], 1
        while len(at := np.flatnonzero(k[:-d] == k[d:])):
            i, j = order[at], order[at + d]
            met[np.minimum(i, j), np.maximum(i, j)] = True
            d += 1
            if d >= m:
                break
    i, j = np.nonzero(met)
    if across:
        apart = block[i] != block[j]
        i, j = i[apart], j[apart]
    return i, j


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops pairs whose posterior of reaching the threshold is below the tolerance, 20 values at a time."""
    matches = np.zeros(len(i), np.int32)
    for n, least in _LEAST.items():
        for at in range(0, len(i), 1 << 18):  # bounded memory
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            matches[at : at + (1 << 18)] += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs, sorted by i, are at least 0.8 alike."""
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    mark = np.zeros(len(flat) + 1, np.int8)
    good = np.zeros(len(i), bool)
    for a, b in chunks.runs(i):
        own, partners = flat[starts[i[a]] : starts[i[a] + 1]], j[a:b]
        mark[own] = 1
        lo, hi = partners.min(), partners.max() + 1
        span = starts[hi] - starts[lo]
        if span <= 4 * sizes[partners].sum():
            sums = np.zeros(span + 1, np.int64)
            np.cumsum(mark[flat[starts[lo] : starts[hi]]], out=sums[1:])
            both = sums[starts[partners + 1] - starts[lo]] - sums[starts[partners] - starts[lo]]
        else:
            both = np.array([int(mark[flat[starts[p] : starts[p + 1]]].sum()) for p in partners])
        good[a:b] = DENOMINATOR * both >= NUMERATOR * (sizes[i[a]] + sizes[partners] - both)
        mark[own] = 0
    return good


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell(table: pa.Table) -> pa.Table:
    table = table.sort_by([("group", "ascending"), ("node", "ascending")])
    nodes = table.column("node").to_pylist()
    keep = [k for k, x in enumerate(nodes) if k == 0 or x != nodes[k - 1]]  # repeated rows of one class
    table, nodes = table.take(pa.array(keep, pa.int64())), [nodes[k] for k in keep]
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    weight, block = table.column("weight").to_numpy(), table.column("block").to_numpy()
    sig = signatures(sets)
    # Told by the cell's name, as one of its two blocks may be empty.
    of = table.column("group")[0].as_py().split("/")
    i, j = prune(sig, *candidate_pairs(sig, block, len(of) == 3 and of[1] != of[2]))
    good = verify(sets, i, j)
    i, j = i[good], j[good]
    links = np.bincount(i, weight[j], len(nodes)) + np.bincount(j, weight[i], len(nodes))
    label = _forest(len(nodes), i, j)
    has = np.flatnonzero(links > 0)
    return pa.table([pa.array([nodes[k] for k in has], pa.binary()), pa.array(links[has].astype(np.int64)), pa.array([nodes[label[k]] for k in has], pa.binary())], ["node", "links", "other"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, class_id (the least doc_id of its class), n_links, n_shingles.

    And h, its text's hash, and class_h, that of the class's first text: ids may be null, or shared by several texts.
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = storage.written(docs.mapInArrow(_sketch, f"doc_id {kind}, h long, node binary, n int, sig binary"), "sketch")
    # A class is read back from rows with its least id and, of their texts, the one of least hash.
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "h"))
    classes = rows.where("n > 0").groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = storage.written(classes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h"), "weight", "n", "sig"), "classes")
    n_classes = classes.count()
    parts = max(storage.shuffle_partitions(spark), n_classes * BANDS // 1_000_000)

    bands = storage.written(classes.select("node", "sig").mapInArrow(_band_rows(parts), "part int, entries binary, u binary, v binary"), "bands")
    stars = bands.where("part >= 0").groupBy("part").applyInArrow(_meet, "u binary, v binary").unionByName(bands.where("part < 0").select("u", "v"))
    groups = storage.written(components.components(stars), "groups")
    storage.delete(bands)

    # Cells: small components packed together, large ones as pairs of blocks.
    members = groups.join(classes.drop("sig"), "node").withColumnRenamed("root", "group")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("items"))
    sizes = sizes.select("group", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("items") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = storage.written(sizes, "sizes")  # so that the join below is of two plain shuffles, which AQE can split
    n_cells = max(storage.shuffle_partitions(spark), n_classes * 2 // BLOCK_DOCS)
    members = members.join(sizes, "group")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # The cells of a component are dealt in turn, so that no task gets several of them by chance.
    n_parts = storage.shuffle_partitions(spark)
    parts = F.from_json(F.lit(json.dumps(chunks.even_parts(spark, n_parts).tolist())), "array<bigint>")
    cell = lambda name, turn: F.struct(name.alias("cell"), F.get(parts, F.pmod(turn, F.lit(n_parts)).cast("int")).alias("part"))
    home = F.pmod(F.xxhash64("group"), F.lit(n_cells))
    packed = cell(F.concat(F.lit("c"), home.cast("string")), home)

    def pair(k):
        a, b = F.least(k, "block"), F.greatest(k, "block")
        return cell(F.concat_ws("/", F.hex("group"), a.cast("string"), b.cast("string")), F.pmod(F.xxhash64("group"), F.lit(n_parts)) + a * F.col("blocks").cast("bigint") - a * (a + 1) / 2 + b)

    paired = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)
    members = members.select(F.col("rep").alias("_rep"), F.col("rep_h").alias("_rep_h"), "node", "weight", "block", F.when(F.col("blocks") == 1, F.array(packed)).otherwise(paired).alias("cells"), "group")
    members = storage.written(members.drop("group"), "members")
    size = members.agg(F.coalesce(F.sum(72 + F.octet_length(F.array_join("cells.cell", ",")) + 40 * F.size("cells")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:  # few candidates: texts need no shuffle
        members = F.broadcast(members)
    told = docs.join(members, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("h") == F.col("_rep_h"))).select("text", "node", "weight", "block", "cells")
    entries = told.mapInArrow(_cell_rows, "cells array<struct<cell:string,part:bigint>>, block int, node binary, weight long, items binary")
    entries = entries.select(F.explode("cells").alias("_c"), "block", "node", "weight", "items").select("_c.cell", "_c.part", "block", "node", "weight", "items").withColumn("group", F.when(F.col("cell").startswith("c"), F.lit("")).otherwise(F.col("cell")))
    found = storage.written(entries.repartition(n_parts, "part").groupBy("part", "cell").applyInArrow(_cell, "node binary, links long, other binary"), "links")
    storage.delete(groups)

    roots = components.components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "rep", "rep_h", "weight").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written first: AQE splits the hot partition of a join only where both sides are plain shuffles.
    least = storage.written(known.groupBy("root").agg(F.min(F.struct(F.isnull("rep").alias("last"), "rep", "rep_h")).alias("first")), "least")
    known = known.join(least, "root").select(F.col("node").alias("_node"), F.col("first.rep").alias("class_id"), F.col("first.rep_h").alias("class_h"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.select("doc_id", "h", "node", "n").join(known, F.col("node") == F.col("_node"), "left")
    own = lambda c, other: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col(other)).alias(c)
    return out.select("doc_id", "h", own("class_id", "doc_id"), own("class_h", "h"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h", "class_h")
