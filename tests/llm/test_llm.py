"""The dealt operators against brute force on one small hostile table, and on empty tables."""

from __future__ import annotations

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import chat, chunks, components, decontaminate, jaccard, lines, linear, mixing, pitman_yor, queries, repeats, rules, tokens, toxicity, warc
from tests.conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _row string, node int, size int, part int, weight int"


def hostile() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows; more columns with clashing names."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß", "The", "İ"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = text(60), text(30_000)
    lines_ = [text(4) for _ in range(6)]
    texts = [
        None, "", " \n\t", "one", "two words", text(19), text(20), shared, shared, shared + " tail", "head " + shared, text(25) + " " + shared + " " + text(25), long, long + " more",
        "a " * 45, "x y " * 40, "\n".join(lines_), "\n".join(["first", *lines_, "last"]), "\n".join(lines_[2:] + lines_[:3]), "\n\n\n\n", "a\x0bb\x0cc\x85d\xa0e f", "#*$%&|<> " * 30, text(200), text(200),
    ]
    near = text(100).split()
    for k in range(12):
        copy = list(near)
        copy[k * 7] = "changed"
        texts.append(" ".join(copy))
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None if i % 3 == 0 else len(t or ""), None, "x", i, 1, None, 2) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, "null id " + shared, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- tokens ---------------------------------------------------------------------------------------------------------------


def test_tokens_match_regex():
    texts = [r[1] for r in hostile()]
    got = []
    for s in tokens.slices(pa.array(texts, pa.string()), limit=500):
        start, end, first = s.words
        for r in range(s.row1 - s.row0):
            got.append([s.text(a, b) for a, b in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]], strict=True)])
    assert got == [WORD.findall(t or "") for t in texts]


def test_hashes_know_words_not_places():
    s = next(tokens.slices(pa.array(["ab cd ab", "cd", None, "abcd ab"])))
    h = s.hashes
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len({h[0], h[1], h[4]}) == 3


def lookalikes(n: int) -> tuple[str, str]:
    """Two different words of n letters whose sums with any odd factor's powers are equal modulo 2**64: a known sequence and its complement."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_names_tell_words_apart():
    words = [*lookalikes(1024), *lookalikes(8192), "", "a", "a" * 15, "a" * 16, "a" * 15 + "\x00", "é" * 7]
    spans = pa.array([w.encode() for w in words], pa.large_binary())
    assert len({tuple(x) for x in tokens.names_of(spans).tolist()}) == len(words)
    again = tokens.names_of(pa.array([w.encode() for w in reversed(words)], pa.large_binary()))
    assert (again[::-1] == tokens.names_of(spans)).all()
    assert len({tuple(x) for x in tokens.names_of(spans, 5).tolist()}) == 6  # by beginnings


def test_groups_are_exact():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 1 << 30, 5000) // (1 << 24) * (1 << 24) for _ in range(4)]
    want = {}
    for row, g in zip(zip(*(c.tolist() for c in columns), strict=True), tokens.grouped(*columns).tolist(), strict=True):
        assert want.setdefault(row, g) == g
    assert len(set(want.values())) == len(want)


# -- 1 ----------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "".join(chr(0x21 + i % 900) for i in range(60_000))
    rows = [(1, "http://a/\n x", big), (2, None, big), (3, "u", "WARC/1.1\r\n\r\n" * 50), (4, "u", None), (None, "u", big), (2, "v", big), (5, "é", "x" * 999), (6, "w", "x" * 999), (7, "w", "0\r\n\r\n" * 2000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), segment=1000)
    got = warc.read_pages(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        again = html == big and page_id != 2
        want.append((str(page_id), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None, None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem)) for r in got)


def test_warc_faults(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.frame(b"payload", 3)
    head = ("page", 1, "u", None, None)
    records = [("a", "response", *head[1:], 1, None, None, block[:20]), ("c1", "continuation", None, None, None, None, 2, "a", len(block), block[20:]), ("b", "response", *head[1:], 1, None, None, block[:20]), ("c2", "continuation", None, None, None, None, 3, "b", len(block), block[20:]), ("d", "response", *head[1:], 1, None, None, block[:20]), ("c3", "continuation", None, None, None, None, 2, "d", 5, block[20:]), ("e", "response", *head[1:], None, None, None, block[:-4]), ("f", "response", *head[1:], None, None, None, b"junk")]
    got = {r.record_id: (r.payload and bytes(r.payload), r.problem) for r in warc.reassemble(spark.createDataFrame(records, warc.RECORDS)).collect()}
    assert got["a"] == (b"payload", None)
    assert got["b"] == (None, "segments missing or repeated")
    assert got["d"] == (None, "segments do not sum to the stated length")
    assert got["e"][0] is None and got["f"] == (None, "HTTP head missing")
    assert warc.unframe(b"3;x=1\r\nabc\r\n0\r\nT: r\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nab\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unframe(bad)


def test_warc_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0


def test_warc_files_of_many_members():
    """Plain, one member, a member per record with zeros between, and files that are cut short."""
    records = [warc.record("response", bytes([i % 251]) * (i * 1000), WARC_Record_ID=f"r{i}") + b"\r\n" for i in range(30)]
    want = [bytes([i % 251]) * (i * 1000) for i in range(30)]
    for raw in (b"".join(records), gzip.compress(b"".join(records)), b"".join(gzip.compress(r) + b"\0" * 3 for r in records)):
        assert [block for _, block in warc.parse_archive(raw)] == want
    assert list(warc.parse_archive(b"")) == []
    for bad in (b"".join(records)[:-900], gzip.compress(b"".join(records))[:-9], b"junk\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def joins_of(df) -> str:
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """Thresholds under which a hot key of a small table is split."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("-1", "16k", "16k", "1.5", "16", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_payload_is_split(spark, skewed):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("hot "), 300)).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 250)).alias("html")).repartition(8)
    assert "skew=true" in joins_of(warc.revisits(pages))


# -- 2 ----------------------------------------------------------------------------------------------------------------------


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(texts: list[str | None]):
    sets = [shingles(t) for t in texts]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return links, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("block", "broadcast"), [(1024, 1 << 25), (3, -1)])
def test_jaccard(docs, monkeypatch, block, broadcast):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)  # 3: components are cut into blocks
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", broadcast)
    rows = [r for r in docs.select("doc_id", "text").collect()]
    links, root = brute_links([r.text for r in rows])
    least = collections.defaultdict(lambda: None)
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = r.doc_id if least[k] is None else min(least[k], r.doc_id)
    want = sorted(str((r.doc_id, least[k] if shingles(r.text) else r.doc_id, n)) for r, k, n in zip(rows, root, links, strict=True))
    got = sorted(str((r.doc_id, r.class_id, r.n_links)) for r in jaccard.near_duplicates(docs).collect())
    assert got == want


def test_jaccard_blocks_left_empty(spark, monkeypatch):
    """Two near copies in a component of many blocks, most of them empty, are linked once."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)
    rows = [(10 * k + m, " ".join([f"g{k}w{i}" for i in range(120)] + ["tail"] * m)) for k in range(6) for m in (0, 1)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 10, 1) for i, _ in rows}


def test_jaccard_null_ids(spark):
    """Rows without an id are copies of each other by their texts only, and the class is read once."""
    rows = [(None, "a b c d e f g h")] * 5 + [(None, "i j k l m n o p")] * 2 + [(None, None), (None, "")]
    got = sorted(r.n_links for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [0, 0, 1, 1, 4, 4, 4, 4, 4]


def test_jaccard_long_words(spark):
    """Different words of 8,192 letters are different shingles."""
    a, b = lookalikes(8192)
    rows = [(1, f"x y z w {a}"), (2, f"x y z w {b}"), (3, f"x y z w {a}")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


def test_jaccard_prune_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])), np.unique(np.concatenate([base[:40], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))]
    sig = jaccard.signatures(sets)
    i, j = (x.ravel() for x in np.triu_indices(len(sets), 1))
    a, b = jaccard.prune(sig, i, j)
    assert {(3 * k, 3 * k + 1) for k in range(60)} <= set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(a) < len(i) / 20
    good = jaccard.verify(sets, a, b)
    assert set(zip(a[good].tolist(), b[good].tolist(), strict=True)) == {(3 * k, 3 * k + 1) for k in range(60)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for u, v in edges if u != v for x in (u, v)}
    assert {tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


# -- 3 ----------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for doc_id, text in sorted(rows, key=order):
        w = WORD.findall(text or "")
        for s in range(len(w) - window + 1):
            at = (order((doc_id,)), s)
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order((doc_id,)), s):
                gone |= set(range(s, s + window))
        out.append(str((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


@pytest.mark.parametrize("window", [20, 5])
def test_substrings(docs, window):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in repeats.dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", "text").collect())
    assert got == brute_repeats(rows, window)


@pytest.mark.parametrize("n", [1024, 8192])
def test_substrings_of_long_words(spark, n):
    a, b = lookalikes(n)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")]
    got = {r.doc_id: r.n_removed for r in repeats.dedup_substrings(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_substrings_empty(spark, empty):
    assert repeats.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.dedup_substrings(spark.createDataFrame([("x", "y")], "doc_id string, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("substrings", "texts", "pairs", "seats"))]


def test_questions_in_many_groups(docs, monkeypatch):
    """Small chunks, groups and rows change nothing."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(chunks, "GROUP_BYTES", 10_000)
    monkeypatch.setattr(chunks, "ASKED_BYTES", 4000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(str(tuple(r)) for r in repeats.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "text").collect())
    assert got == brute_repeats(rows, 20)


@pytest.mark.parametrize(("buckets", "least"), [(4, 1), (51, 120), (211, 211)])
def test_parts_fill_partitions_evenly(spark, buckets, least):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(buckets))
    try:
        parts = chunks.even_parts(spark, least)
        rows = spark.createDataFrame([(int(p),) for p in parts], "p long").groupBy(F.pmod(F.hash("p"), F.lit(buckets))).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(set(parts.tolist())) == len(parts) >= least and {r["count"] for r in rows} == {len(parts) // buckets} and len(rows) == buckets


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    passage = [rng.choice("abc") for _ in range(40)]
    texts = [" ".join([rng.choice("abc") for _ in range(rng.randrange(30))] + passage + [rng.choice("abc") for _ in range(rng.randrange(30))]) for _ in range(40)]
    w = repeats.Windows(next(tokens.slices(pa.array(texts))))
    names, places = w.anchors()
    by = {}
    for at, name, place in zip(w.at, names, places, strict=True):
        key = tuple(w.hashes[at : at + 20].tolist())
        assert by.setdefault(key, (name, place - at)) == (name, place - at)


# -- 4 ----------------------------------------------------------------------------------------------------------------------


def test_mix(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes, weights = collections.Counter(), {}
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = k % 3 + 1
    total, capped = sum(sizes.values()), set()
    while True:
        rest, share = total - 3 * sum(sizes[s] for s in capped), sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weights[s] > 3 * sizes[s] * share}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / share for s in sizes}
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))


def test_placed_has_every_copy(docs):
    """The positions of a document are those of its rows in the curriculum."""
    mix = mixing.mixed(docs)
    targets = mixing.source_targets(mix.select("source", "size"))
    rows = mixing.curriculum(mix, mixing.default_schedules(targets)).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    want = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.copy):
        want[r.doc_id, r.size, r.stream_from].append(r.position)
    got = mixing.placed(docs).collect()
    assert len(got) == mix.count() and sum(len(r.positions) for r in got) == len(rows)
    for r in got:
        assert r.positions == want.get((r.doc_id, r.size, r.stream_from), []) and len(r.positions) == (r.taken // r.size if r.taken else 0)
        assert (r.position, r.last_position) == ((r.positions[0], r.positions[-1]) if r.positions else (None, None))


def test_many_rows_without_an_id(spark, monkeypatch):
    """They are dealt over bins by their sizes, and the sums stay exact."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 0)  # the most bins that rows allow
    rows = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    got = mixing.mixed(rows).collect()
    assert len(got) == 300 and sum(r.taken for r in got) == sum(r.size for r in got) == got[0].source_size
    ends = sorted((r.stream_from, r.size) for r in got if r.size)
    assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(ends))


def test_curriculum_inverts_the_schedule(spark):
    mix = spark.createDataFrame([(i, "a", 10, 1000, 2000.0, 20, 10 * i) for i in range(100)], "doc_id long, source string, size long, source_size long, target double, taken long, stream_from long")
    schedule = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.5, 2.0), ("a", 1.0, 1.0)], "source string, time double, intensity double")
    got = mixing.curriculum(mix, schedule).collect()
    assert len(got) == 200 and [r.position for r in got] == sorted(r.position for r in got)
    whole = 0.5 + 0.75
    demand = lambda t: (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5) - (t - 0.5) ** 2) / whole
    for r in got:
        assert demand(r.position) == pytest.approx((r.doc_id * 10 + r.copy * 1000) / 2000, abs=1e-9)
    plain = mixing.curriculum(mix, schedule.where("source = 'b'")).collect()
    assert all(r.position == pytest.approx((r.doc_id * 10 + r.copy * 1000) / 2000) for r in plain)


# -- 5 ----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def trigrams(spark, sf):
    return toxicity.trigram_model(spark.read.parquet(f"{sf}/documents.parquet")).tolist()


@pytest.mark.parametrize(("hidden", "plain"), [("stuuupid", "stupid"), ("$tupid", "stupid"), ("st-u-p-i-d", "stupid"), ("tra5h", "trash"), ("l0ser", "loser"), ("disgust1ng", "disgusting"), ("plain", "plain")])
def test_decode(trigrams, hidden, plain):
    assert toxicity.decode(hidden, trigrams) == plain


@pytest.mark.parametrize("token", ["1d10t", "sh!t", "a$$", "st-p", "0h1", "iiid", "é1t", "x*y", "аss"])
@pytest.mark.parametrize("spaced", [False, True])
def test_decode_against_brute_force(trigrams, token, spaced):
    """Viterbi finds the best of all paths through the lattice."""
    best = (-math.inf, "")
    for arcs in itertools.product(*(toxicity.arcs_at(token, i) for i in range(len(token)))):
        cost, letters = sum(c for _, c in arcs), [x for x, _ in arcs if x > 0]
        for cuts in itertools.product([False, True], repeat=max(0, len(letters) - 1)) if spaced else [()]:
            words = [[]]
            for k, x in enumerate(letters):
                if k and spaced and cuts[k - 1]:
                    words.append([])
                words[-1].append(x)
            score = cost + toxicity.LOG_BOUNDARY * (len(words) - 1)
            for w in words:
                path = [0, 0, *w, 0]
                score += sum(trigrams[a][b][c] for a, b, c in zip(path, path[1:], path[2:], strict=False))
            best = max(best, (score, " ".join("".join(chr(96 + x) for x in w) for w in words)))
    assert toxicity.decode(token, trigrams, spaced) == best[1]


def brute_numbers(text: str, model, lexicon: dict) -> list[float]:
    """The six numbers of a text, word by word."""
    plain = [m for m in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in w) for w in plain]
    s = next(tokens.slices(pa.array([text])))
    hits = []
    for w in [*low, *toxicity.restored(s, model, {})[1]]:
        names, stems = toxicity.hash_words(pa.array([w.encode()], pa.large_binary()))
        hits += [lexicon[x] for x in (int(names[0]), int(stems[0])) if x in lexicon]
    return [max(hits, default=0.0), math.log1p(sum(hits)), math.log1p(len(hits)), math.log1p(100 * len(hits) / max(1, len(plain))), float(bool(hits)), math.log1p(len(plain)) / 10]


def test_toxicity_numbers_against_brute_force(spark, sf, trigrams):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    lexicon = dict(zip(model.lexicon.tolist(), model.odds.tolist(), strict=True))
    rows = docs.select("doc_id", "text").collect()
    score = {r.doc_id: r.score for r in toxicity.op5_toxicity(spark, sf).collect()}
    for r in rows:
        x = np.array(brute_numbers(r.text, model.trigrams, lexicon))
        assert score[r.doc_id] == pytest.approx(linear.sigmoid(x @ model.weights[:-1] + model.weights[-1]), abs=1e-9)


@pytest.mark.parametrize("hidden", ["é1d10t", "1d10t" + "-" * 45 + "x", "i d i o t " * 9, "a n i d i o t", "y o u i d i o t", "ｉｄｉｏｔ", "іdіоt", "idio7", "(1d10t)"])
def test_hidden_words_are_found(spark, sf, hidden):
    sf = sf.replace("sf0.001", "sf0.1")
    if "model" not in _FITTED:
        _FITTED["model"] = toxicity.fit(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    carrier = "The of and in {} of the that was for it with as his on be at by"
    scores = toxicity.scorer(_FITTED["model"])(pa.array([carrier.format(hidden), carrier.format("an item")]))
    assert scores[0] > 0.5 > scores[1]


_FITTED: dict = {}


def test_suspects():
    texts = ["an 1d10t and stuuupid, s c u m here.", "555-6503 https://x.org/a plain words*** a b", None, "x", "spaced: m o r o n"]
    got = [(r, w) for s in tokens.slices(pa.array(texts)) for r, w in toxicity.suspects(s)]
    assert got == [(0, "1d10t"), (0, "stuuupid"), (0, "scum"), (4, "moron")]


def test_other_scripts_are_marks_among_latin_letters():
    texts = ["іdіоt ｍｏｒｏｎ été 第1章 привет ἀρετή naïve x²y"]
    assert [w for s in tokens.slices(pa.array(texts)) for _, w in toxicity.suspects(s)] == ["іdіоt", "ｍｏｒｏｎ"]


def test_toxicity_held_out(spark, sf):
    """Trained on four fifths of the labels, right on the rest; the learning rows are those that the rule allows."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_rows(docs, labels).select("doc_id").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows)
    got = toxicity.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) > 0.97 * len(got)
    model = toxicity.fit(docs, labels)
    hidden = toxicity.scorer(model)(pa.array(["The of and in an 1d10t of the that", "The of and in an i d i o t of the", "The of and in the that"]))
    assert hidden[0] > 0.5 and hidden[1] > 0.5 > hidden[2]


@pytest.mark.parametrize(("text", "word"), [("idio7", "idiot"), ("1d107", "idiot"), ("stup1d", "stupid"), ("you a m o r o n", "moron"), ("s" + "t" * 60 + "upid", "stupid"), ("m.0.r.0.n", "moron"), (" ".join("amoron" * 12), "moron")])
def test_no_obfuscation_is_too_short_or_long(trigrams, text, word):
    s = next(tokens.slices(pa.array([text])))
    assert word in toxicity.restored(s, trigrams, {})[1]


def test_marks_at_the_end_are_seen():
    s = next(tokens.slices(pa.array(["sh17 a$$ 1984 plain! x" + "9" * 60])))
    assert [w for _, w in toxicity.suspects(s)] == ["sh17", "a$$", "x" + "9" * 60]


def test_lexicon_counts_texts_once(spark, trigrams):
    """A word that follows the same word in many toxic texts is learnt; one in many copies of a single text is not."""
    toxic = [f"filler{k} you blorple" for k in range(9)] + ["some zzyzx here"] * 9
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(100 + i, 0, f"clean{i} text you") for i in range(30)], "doc_id long, y int, text string")
    keys, _ = toxicity.learn_lexicon(rows, trigrams)
    (known, once), _ = toxicity.hash_words(pa.array([b"blorple", b"zzyzx"], pa.large_binary()))
    assert known in keys and once not in keys


def test_toxicity_hostile(docs, labels, empty):
    got = toxicity.score_texts(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_texts(empty, toxicity.fit(empty, labels)).count() == 0
    none = toxicity.score_texts(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()
    assert {r.score for r in none} == {0.0}


# -- 6 ----------------------------------------------------------------------------------------------------------------------


def test_lines(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    order = lambda d: (d is None, d or 0)
    blank = re.compile(r"[\n\t\r\x0b\x0c ]*")
    first, gone = {}, collections.defaultdict(set)
    for step in range(2):
        for doc_id, text in rows:
            ls = (text or "").split("\n")
            for i in range(len(ls) - 2):
                win, at = tuple(ls[i : i + 3]), (order(doc_id), i)
                if blank.fullmatch("\n".join(win)):
                    continue
                if step == 0:
                    first[win] = min(first.get(win, at), at)
                elif first[win] < at:
                    gone[doc_id] |= {i, i + 1, i + 2}
    want = []
    for doc_id, text in rows:
        ls = [] if text is None else text.split("\n")
        left = None if text is None else "\n".join(x for i, x in enumerate(ls) if i not in gone[doc_id])
        want.append(str((doc_id, len(ls), len(gone[doc_id]), left)))
    out = lines.dedup_lines(docs)
    got = [str(tuple(r)) for r in out.select("doc_id", "n_lines", "n_removed", "text").collect()]
    assert sorted(got) == sorted(want) and sum(map(len, gone.values())) > 0
    assert {"node", "_row", "size"} <= set(out.columns)


def test_hot_window_is_split(spark, skewed):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\nc\n"), F.col("id").cast("string"), F.lit("\nx\n"), F.col("id").cast("string")).alias("text")).repartition(8)
    assert "skew=true" in joins_of(lines.repeated_lines(docs))


# -- 7 ----------------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", r"a<s>b</s>\l[INST]"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "t\\w\no"), (2, 0, "system", "only"), (3, None, None, "x"), (3, 1, "assistant", ""), (None, 0, "assistant", "n"), (1, 3, "assistant", "t\\w\no")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand_prefixes(turns).collect()
    assert len(examples) == 3 + 1 + 1 + 1
    for e in examples:
        assert "<s>" not in e.formatted.replace("<s>", "", e.formatted.count("</s>"))
    second = next(e for e in examples if e.conv_id == 1 and e.example == 1)
    assert second.formatted[second.loss_start : second.loss_start + second.loss_chars] == r"t\bw" + "\no"
    got = {r.conv_id: r for r in chat.digest(chat.expand_prefixes(turns)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, its in by.items():
        its.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in its)
        loss = "".join(r[3] or "" for r in its if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(its), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(e.formatted) for e in examples if e.conv_id == conv)
    assert chat.digest(chat.expand_prefixes(turns.where("conv_id = 99"))).count() == 0


def test_very_long_conversation(spark):
    """Of 400 turns, and one of a very long text."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <s>[x]") for i in range(400)] + [(2, 0, "user", "[<" * 200_000), (2, 1, "assistant", "\\" * 200_000)]
    got = {r.conv_id: r for r in chat.digest(chat.expand_prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    told = "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:400])
    assert (got[1].n_turns, got[1].turns_sha256) == (400, hashlib.sha256(told.encode()).hexdigest())
    assert got[2].loss_chars == 200_000 and got[2].loss_sha256 == hashlib.sha256(b"\\" * 200_000).hexdigest()


# -- 8 ----------------------------------------------------------------------------------------------------------------------


def low(text: str | None) -> list:
    return [w.lower() if w.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")] + [None]


def test_pitman_yor_base(docs):
    rows = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 1).alias("held_out"))
    all_rows = rows.collect()
    c = collections.Counter(w for r in all_rows if not r.held_out for w in low(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), r.held_out, len(low(r.text)), sum(c[w] > 0 for w in low(r.text)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in low(r.text)), 6)) for r in all_rows)
    got = pitman_yor.score_texts(rows).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    again = pitman_yor.score_texts(rows.repartition(1)).collect()
    assert len(again) == len(got)
    none = pitman_yor.score_texts(rows.withColumn("held_out", F.lit(True))).collect()
    assert all(r.score == pytest.approx(0.0, abs=1e-9) and r.base_score == pytest.approx(0.0, abs=1e-9) for r in none)


def test_pitman_yor_beats_the_base(spark, sf):
    got = pitman_yor.op8_pitman_yor(spark, sf).where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert got.a > got.b


def seats_of(counts: dict[int, dict[int, int]], words: list[int], customers: dict[int, int] | None = None) -> pitman_yor.Seats:
    """Every word after every context; training counts as given."""
    contexts = sorted(counts)
    at, word = (x.ravel() for x in np.meshgrid(np.arange(len(contexts)), np.arange(len(words)), indexing="ij"))
    c = np.array([counts[contexts[i]].get(words[j], 0) for i, j in zip(at, word, strict=True)])
    own = np.bincount(at, c, len(contexts)).astype(np.int64) if customers is None else np.array([customers[u] for u in contexts])
    return pitman_yor.Seats(np.array(words), np.array(contexts), own, at, word, c)


def sampled(seats: pitman_yor.Seats, v: int, burn_in: int, samples: int):
    """The operator's sweeps over one part that holds everything: the samples that `predictive` takes."""
    parent, tables, out = pitman_yor.Parent(v, 0, v), np.minimum(seats.c, 1), []
    for step in range(burn_in + samples + 1):
        c = np.bincount(seats.word, tables, len(seats.words)).astype(np.int64)
        t = parent.draw(step, seats.words, c)
        parent = pitman_yor.Parent(v, int(c.sum()), int(t.sum()))
        heard = (c, t, np.bincount(seats.at, tables, len(seats.contexts)).astype(np.int64))
        out.append((step, parent, heard))
        tables = seats.draw(step + 1, heard[2], parent.probability(seats.words, c, t))
    return out[burn_in:]


@pytest.mark.parametrize(("c", "base"), [(2, 0.2), (20, 0.2), (256, 0.01), (300, 0.2), (300, 3.0), (700, 0.01), (5000, 40.0)])
def test_tables_follow_their_law(c, base):
    """The exact law of the number of tables, by the recurrence of Stirling numbers."""
    d, t = 0.75, np.arange(c + 1)
    ways = np.full(c + 1, -np.inf)
    ways[1] = 0.0
    for k in range(1, c):
        ways = np.logaddexp(np.append(-np.inf, ways[:-1]), ways + np.log(np.maximum(k - d * t, 1e-300)))
        ways[0] = -np.inf
    law = ways[1:] + t[1:] * np.log(d * base)
    law = np.exp(law - law.max())
    law /= law.sum()
    n = 20_000
    got = pitman_yor.draw_tables(np.full(n, c), np.full(n, base), d, 5, np.arange(n))
    mean, square = (law * t[1:]).sum(), (law * t[1:] ** 2).sum()
    assert got.mean() == pytest.approx(mean, abs=5 * math.sqrt((square - mean**2) / n) + 1e-3)
    assert got.std() == pytest.approx(math.sqrt(square - mean**2), rel=0.05, abs=5e-3)
    assert got.min() >= 1 and got.max() <= c


def test_gammas():
    for shape in (1.0, 1.4, 30.0):
        x = pitman_yor.gammas(np.full(40_000, shape), 3, np.arange(40_000))
        assert x.mean() == pytest.approx(shape, rel=0.03) and x.var() == pytest.approx(shape, rel=0.06)


def brute_hierarchy(counts: dict[int, dict[int, int]], words: list[int], v: int, sweeps: int) -> dict[tuple[int, int], float]:
    """Chinese restaurants with every customer at a table of its own record, reseated one by one."""
    rng = random.Random(11)
    d, s, d0, s0 = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    inner = {u: {w: [] for w in words} for u in counts}
    root = {w: [] for w in words}

    def pick(sizes, weights):
        x = rng.random() * sum(weights)
        for k, y in enumerate(weights):
            x -= y
            if x < 0:
                return k
        return len(weights) - 1

    share = lambda w: pitman_yor.UNKNOWN if w == pitman_yor.NONE else (1 - pitman_yor.UNKNOWN) / v
    total = lambda tables: (sum(map(len, tables.values())), sum(map(sum, tables.values())))

    def p0(w):
        t, c = total(root)
        return (sum(root[w]) - d0 * len(root[w]) + (s0 + d0 * t) * share(w)) / (s0 + c)

    def sit(tables, w, new, discount, opened):
        k = pick(tables[w], [x - discount for x in tables[w]] + [new])
        if k == len(tables[w]):
            tables[w].append(1)
            opened()
        else:
            tables[w][k] += 1

    def leave(tables, w, closed):
        k = pick(tables[w], tables[w])
        tables[w][k] -= 1
        if not tables[w][k]:
            del tables[w][k]
            closed()

    sit_root = lambda w: sit(root, w, (s0 + d0 * total(root)[0]) * share(w), d0, lambda: None)
    sit_inner = lambda u, w: sit(inner[u], w, (s + d * total(inner[u])[0]) * p0(w), d, lambda: sit_root(w))
    customers = [(u, w) for u in counts for w, c in counts[u].items() for _ in range(c)]
    for x in customers:
        sit_inner(*x)
    sums = collections.Counter()
    for k in range(sweeps):
        for u, w in customers:
            leave(inner[u], w, lambda w=w: leave(root, w, lambda: None))
            sit_inner(u, w)
        if k >= sweeps // 5:
            for u in counts:
                t, c = total(inner[u])
                for w in words:
                    sums[u, w] += (sum(inner[u][w]) - d * len(inner[u][w]) + (s + d * t) * p0(w)) / (s + c)
    return {x: y / (sweeps - sweeps // 5) for x, y in sums.items()}


def test_hierarchy_against_brute_force():
    """Sweeps over numbers of tables give the predictions of the customer-by-customer sampler of the whole hierarchy."""
    known = [2, 3, 4, 5]
    counts = {1: {2: 6, 3: 1}, 2: {2: 1, 3: 5, 4: 1}, 3: {4: 2, 5: 2}, 4: {5: 1}, 5: {}}
    words = [pitman_yor.NONE, *known]
    want = brute_hierarchy(counts, words, len(known), 3000)
    seats = seats_of(counts, words)
    got = pitman_yor.predictive(seats, sampled(seats, len(known), 20, 3000))
    for (u, w), p in zip(((seats.contexts[a], seats.words[b]) for a, b in zip(seats.at, seats.word, strict=True)), got, strict=True):
        assert p == pytest.approx(want[u, w], rel=0.05, abs=0.004)


def test_predictions_sum_to_one():
    """Over the known words and the unknown one, after seen and unseen contexts."""
    known = list(range(pitman_yor.FIRST, pitman_yor.FIRST + 5))
    rng = random.Random(1)
    counts = {u: {w: rng.randrange(0, 900 if u % 2 else 4) for w in known} for u in (pitman_yor.START, *known)} | {pitman_yor.NONE: {}}
    seats = seats_of(counts, [pitman_yor.NONE, *known])
    p = pitman_yor.predictive(seats, sampled(seats, len(known), 3, 2))
    assert np.bincount(seats.at, p) == pytest.approx(np.ones(len(counts)))


def test_split_context_scores_as_a_whole_one():
    """A context whose pairs lie in two parts: the same tables and predictions as in one."""
    known = list(range(pitman_yor.FIRST, pitman_yor.FIRST + 6))
    counts = {3: {w: 50 * w for w in known}}
    whole = seats_of(counts, known)
    samples = sampled(whole, len(known), 2, 2)
    p = pitman_yor.predictive(whole, samples)
    for k, half in enumerate((known[:3], known[3:])):
        part = seats_of({3: {w: counts[3][w] for w in half}}, half, {3: sum(counts[3].values())})
        cut = slice(3 * k, 3 * k + 3)
        assert (pitman_yor.predictive(part, [(s, x, (c[cut], t[cut], own)) for s, x, (c, t, own) in samples]) == p[cut]).all()


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    """Nor on chunks, parts, or how contexts are split."""
    rows = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 1).alias("held_out"))
    want = sorted(map(str, pitman_yor.score_texts(rows).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 5000)
        monkeypatch.setattr(pitman_yor, "HOT", 20)
        monkeypatch.setattr(pitman_yor, "TOKENS_PER_PART", 3000)
        assert sorted(map(str, pitman_yor.score_texts(rows.repartition(5)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pitman_yor_empty(empty):
    assert pitman_yor.score_texts(empty.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


# -- 9 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("broadcast", "block"), [(1 << 25, 1024), (1 << 25, 3), (-1, 1024)])
def test_decontaminate(spark, docs, monkeypatch, broadcast, block):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    texts = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    shared = texts[7].split()
    items = [(1, " ".join(shared[:13])), (2, " ".join(shared[5:30])), (10, "W1 é"), (3, None), (4, ""), (5, "absent words only here"), (6, "ONE"), (None, "two Words"), (1, "two"), (11, " ".join(["a"] * 14)), (12, "İ")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - 12)):
            if w:
                windows[tuple(w[s : s + 13])].add("null" if item is None else str(item))
    want = []
    for r in docs.select("doc_id", "text").collect():
        w, hit, found = split(r.text), set(), set()
        for win, its in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= its
        want.append(str((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))))
    got = decontaminate.hits(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, win int")).drop("text_hash")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    assert decontaminate.hits(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_frequent_prefix_in_a_long_text(spark):
    """Every word of a text of 200,000 is the prefix of a one-word item; carrying it whole would be quadratic."""
    docs = spark.createDataFrame([(1, "Yes " * 200_000), (2, "no"), (3, None)], "doc_id long, text string")
    got = decontaminate.hits(docs, spark.createDataFrame([(1, "yes"), (2, "yes yes")], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == [(1, 200_000, 200_000, 2), (2, 1, 0, 0), (3, 0, 0, 0)]


# -- 10 ---------------------------------------------------------------------------------------------------------------------


def test_rules(docs, labels, empty):
    def brute(t):
        w = WORD.findall(t or "")
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)

    got = rules.judge(docs, rules.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.quality >= rules.KEEP_AT)
    assert rules.fit(docs, labels.where("quality = 1")) is None
    assert rules.judge(empty, None).count() == 0
    assert all(r.kept != r.base_failed for r in rules.judge(docs, None).collect())


@pytest.mark.parametrize("n", [1024, 4096])
def test_rules_of_long_words(spark, n):
    """Different long lines and words are not taken for equal ones."""
    a, b = lookalikes(n)
    text = f"{a}\n{b}\n{a}\np {a} q p {b} q p {a} q"
    row = rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), None).first()
    assert (row.n_dup_lines, row.n_repeat_words) == (1, 6)


def test_rules_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = rules.judge(docs, rules.fit(docs, labels.where(~held))).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where(held & ~F.col("base_failed")).collect()
    assert len(got) > 300 and sum(r.kept == (r.label == 1) for r in got) > 0.98 * len(got)


def test_linear():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 > 0).astype(int)
    w = linear.fit_dense(x, y)
    assert (((x @ w[:-1] + w[-1]) > 0) == y).mean() > 0.98
    assert linear.platt(np.array([1.0, 2.0]), np.array([1, 1])) == (1.0, 0.0)


# -- queries and the pipeline ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def contaminated(text: str | None, items: list[str | None]) -> bool:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {tuple(w[s : s + 13]) for w in map(split, items) if w for s in range(max(1, len(w) - 12))}
    w, hit = split(text), set()
    for n in {len(x) for x in wins}:
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in wins:
                hit |= set(range(s, s + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def brute_lines(rows):
    order = lambda d: (d is None, d or 0)
    first, gone = {}, collections.defaultdict(set)
    for step in range(2):
        for doc_id, text in rows:
            ls = (text or "").split("\n")
            for i in range(len(ls) - 2):
                win, at = tuple(ls[i : i + 3]), (order(doc_id), i)
                if re.fullmatch("[\n\t\r\x0b\x0c ]*", "\n".join(win)):
                    continue
                if step == 0:
                    first[win] = min(first.get(win, at), at)
                elif first[win] < at:
                    gone[doc_id] |= {i, i + 1, i + 2}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows]


def fails_base(text: str | None) -> bool:
    w = WORD.findall(text or "")
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cov = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w) < 50 or 100 * len(cov) > 50 * len(w)


def hold(stage: str, spark, before, sf) -> list:
    """A stage's rows on a table, held against brute force; returned as they are."""
    run = dict(corpus_pipeline.STAGES)[stage]
    rows, out = before.collect(), run(spark, before, sf).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    if stage == "quality rules":
        weights = rules.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
        good = [True] * len(rows) if weights is None else [bool(linear.sigmoid(rules.scores(next(tokens.slices(pa.array([r.text or ""]))), weights))[0] >= rules.KEEP_AT) for r in rows]
        want = [r for r, g in zip(rows, good, strict=True) if g and not fails_base(r.text)]
    elif stage == "line dedup":
        texts = brute_lines([(r.doc_id, r.text) for r in rows])
        assert sorted((str(r.doc_id), str(t)) for r, t in zip(rows, texts, strict=True)) == sorted(map(key, out))
        changed = {(str(r.doc_id), str(t)): len(t) for r, t in zip(rows, texts, strict=True) if t != r.text}
        assert all(r.n_chars == changed.get(key(r), r.n_chars) for r in out)
        return out
    elif stage == "n-gram Jaccard join":
        _, root = brute_links([r.text for r in rows])
        least = {}
        for r, k in zip(rows, root, strict=True):
            if r.doc_id is not None and shingles(r.text):
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        stays = [r for r, k in zip(rows, root, strict=True) if not shingles(r.text) or r.doc_id == least.get(k)]
        want = list({key(r): r for r in stays}.values())
    elif stage == "benchmark decontamination":
        items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        want = [r for r in rows if not contaminated(r.text, items)]
    else:
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        assert len(out) == len(rows) and sum(r.size for r in out) == sum(sizes.values())
        assert [r.position for r in out if r.position is not None] == sorted(r.position for r in out if r.position is not None)
        taken, by = sum(r.taken for r in out), collections.Counter()
        for r in out:
            by[r.source_size, r.target] += r.taken
            assert r.taken <= 3 * r.size and (r.taken == 0) == (r.position is None)
        most = max((r.size for r in out), default=0)
        assert all(abs(t - target) <= most for (_, target), t in by.items()) or len(set(sizes.values())) < len(sizes)
        assert abs(taken - sum(sizes.values())) <= most * len(sizes)
        return out
    assert sorted(map(key, want)) == sorted(map(key, out))
    return out


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_on_hostile_rows(spark, docs, empty, sf, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, sf)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    hold(name, spark, docs, sf)
    assert run(spark, empty, sf).collect() == []


def test_pipeline(spark, sf):
    """Each stage against brute force on what its predecessor kept; and the run is their chain."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, _) in enumerate(corpus_pipeline.STAGES):
        rows = hold(name, spark, docs, sf)
        assert rows
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, rows))
