r"""Language-model scoring by a hierarchical Pitman-Yor model over word pairs.

Texts are lower-cased in A-Z; tokens are words ``[^\x20\x09-\x0D]+`` and then one end.  Every previous token is a
context with a restaurant of its own; all share one parent, the unigram restaurant, whose base gives an unknown word
the share ``UNKNOWN`` and splits the rest evenly among the known words.  So the V known words, the end among them, and
"unknown" are the events, as in the base score.

The seating is sampled by Gibbs sweeps over the whole hierarchy.  Predictions need of a dish's seating only its number of
tables, so a sweep draws that: a gamma variable of each restaurant, given its tables, makes its dishes independent, and
the number of tables of a dish of c customers then has the weight (d x base)^t S(c, t), with S the generalised Stirling
numbers.  It is drawn from this law itself for c up to ``BY_COUNT`` and by ``STEPS`` steps of an independence sampler
above.  The tables of all contexts are the parent's customers, seated alike; the next sweep draws the contexts under the
parent that these made.  The seating starts with every dish at one table.  Predictive probabilities are averaged over the
last ``SAMPLES`` of ``BURN_IN + SAMPLES`` sweeps.

Every random number is a hash of what it is for (sweep, context, word), and counts and sums are integers (scores add
log10 probabilities rounded to 2^-20), so a score depends on the rows alone, not on partitions, parts or chunks.

1. Chunks of documents ask for the training counts of their words; the answers number the known words, by count and name.
2. Each chunk sends its token pairs, combined, with the documents that have them, to the part of their context.  The pairs
   of a context of more than ``HOT`` training tokens are dealt by the following word over several parts.
3. In each sweep, parts draw their dishes' tables and send tables by word and by context to the parent's parts, which add
   them up, seat the words in the parent, and answer.  Tables of a context are added up there wherever its pairs lie.
4. Parts draw the last sweeps' tables again, from the same numbers, average the predictive probabilities of their pairs,
   and return one sum of logarithms per document.

Defined results: a null text is empty and has one token, the end; a null doc_id is not held out; repeated rows count
and are scored each; if no row is for training all words are unknown and every score is that of the base; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import chunks, storage, tokens
from pagemill.llm.repeats import _part
from pagemill.llm.toxicity import _LOWER

DISCOUNT, STRENGTH = 0.75, 1.0  # of the contexts
ROOT_DISCOUNT, ROOT_STRENGTH = 0.7, 10.0
UNKNOWN = 0.9  # how often a new type is an unknown word
BURN_IN, SAMPLES = 2, 2
BY_COUNT = 256  # customers of a dish whose number of tables is drawn from its law
STEPS = 12  # of the sampler of larger dishes
HOT = 4_000_000
CHUNK_BYTES = 6 << 20
TOKENS_PER_PART = 1_000_000
SCALE = 1 << 20  # of a log10 probability in a sum

_END = np.uint64(0x454E44)
NONE, START, FIRST = 0, 1, 2  # numbers of the unknown word and the start; known words from FIRST on


# -- seating ----------------------------------------------------------------------------------------------------------


_NODES = np.arange(24)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1."""
    y = x + 7.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))


def log_ways(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log(S(c, t) d^t / c!) of the generalised Stirling numbers of discount d: the weight of seating c customers at t tables.

    That is log([z^c] (1 - (1 - z)^d)^t / t!), an integral over z = exp(-s) on a parabola through the saddle point; for
    c over BY_COUNT it is right to 1e-6.
    """
    c, t = c.astype(float), t.astype(float)
    low, high = np.full(len(c), -60.0), np.full(len(c), 3.0)  # of log s
    mean = lambda s: t * d * np.exp(-s) * (-np.expm1(-s)) ** (d - 1) / -np.expm1(d * np.log(-np.expm1(-s)))
    for _ in range(40):
        mid = (low + high) / 2
        more = mean(np.exp(mid)) > c
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    s0 = np.maximum(np.exp((low + high) / 2), 2 / c)
    f = lambda s: t[:, None] * np.log1p(-((-np.expm1(-s)) ** d)) + c[:, None] * s
    at0 = f(s0[:, None])
    h = 1e-3 * s0[:, None]
    bend = np.maximum((f(s0[:, None] + h) - 2 * at0 + f(s0[:, None] - h)) / h**2, 1e-9)[:, 0]
    flat = s0 > 0.2  # there the circle: the integrand has the period 2 pi
    reach = np.where(flat, np.minimum(np.pi, 9 / np.sqrt(bend)), np.minimum(4.0, 9 / (2 * s0 * np.sqrt(bend))))
    step = reach / len(_NODES)
    u = (_NODES + 0.5) * step[:, None]
    s = np.where(flat[:, None], s0[:, None] + 1j * u, s0[:, None] * (1 + 1j * u) ** 2)
    slope = np.where(flat[:, None], 1.0, 2 * s0[:, None] * (1 + 1j * u))
    total = (np.exp(f(s) - at0) * slope).real.sum(1) * step / np.pi
    return np.where(t == c, c * np.log(d), np.log(np.maximum(total, 1e-300)) + at0[:, 0]) - _log_gamma(t + 1)


def uniforms(step: int, *keys: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), fixed by a step and the keys."""
    x = np.uint64(step)
    for k in keys:
        x = tokens.mix((np.asarray(k).astype(np.uint64) ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, step: int, key: np.ndarray) -> np.ndarray:
    """A gamma variable of each shape, of at least 1, by Marsaglia and Tsang's method."""
    out, left = np.zeros(len(shape)), np.arange(len(shape))
    d = shape - 1 / 3
    for turn in itertools.count():
        if not len(left):
            return out
        u, v, w = (uniforms(step, key[left], 3 * turn + k) for k in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = np.maximum(1 + x / np.sqrt(9 * d[left]), 0) ** 3
        ok = (cube > 0) & (np.log(w) < 0.5 * x * x + d[left] * (1 - cube + np.log(np.maximum(cube, 1e-300))))
        out[left[ok]] = d[left[ok]] * cube[ok]
        left = left[~ok]


@functools.cache
def small_ways(discount: float) -> list[np.ndarray]:
    """For c up to BY_COUNT: log(S(c, t) d^t), t from 1, by the recurrence."""
    ways = [np.zeros(0), np.array([np.log(discount)])]
    for c in range(1, BY_COUNT):
        t = np.arange(1, c + 1)
        stay = np.append(ways[-1] + np.log(c - discount * t), -np.inf)
        ways.append(np.logaddexp(stay, np.append(-np.inf, ways[-1]) + np.log(discount)))
    return ways


def draw_tables(c: np.ndarray, rate: np.ndarray, discount: float, step: int, *keys: np.ndarray) -> np.ndarray:
    """The number of tables of each dish of c customers, of weight rate^t S(c, t) d^t; the keys tell dishes apart."""
    tables = np.minimum(c, 1).astype(np.int64)
    at = np.flatnonzero((c > 1) & (c <= BY_COUNT))
    at = at[np.argsort(c[at], kind="stable")]
    log_rate, u = np.log(rate[at]), uniforms(step, *(k[at] for k in keys))
    for a, b in chunks.runs(c[at]):
        n = int(c[at[a]])
        for x in range(a, b, max(1, (1 << 20) // n)):
            y = min(b, x + max(1, (1 << 20) // n))
            weight = small_ways(discount)[n] + np.arange(1, n + 1) * log_rate[x:y, None]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[at[x:y]] = 1 + (weight < u[x:y, None] * weight[:, -1:]).sum(1)
    at = np.flatnonzero(c > BY_COUNT)
    if len(at):
        tables[at] = _draw_large(c[at], rate[at], discount, step, *(k[at] for k in keys))
    return tables


def _draw_large(c: np.ndarray, rate: np.ndarray, discount: float, step: int, *keys: np.ndarray) -> np.ndarray:
    """As draw_tables, by an independence sampler: proposals from a logistic law about the mode, which start there.

    rate^t S(c, t) d^t / c! is the c-th coefficient of (rate (1 - (1 - z)^d))^t / t!, so t is Poisson with c given; z and
    the spread of t are those of the tilted law whose mean of c is right.
    """
    c = c.astype(float)
    low, high = np.full(len(c), -600.0), np.zeros(len(c))  # of y = log(1 - z)
    for _ in range(70):
        mid = (low + high) / 2
        more = np.log(rate * discount) + np.log(np.maximum(-np.expm1(mid), 1e-300)) + (discount - 1) * mid > np.log(c)
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    y = (low + high) / 2
    middle = np.clip(rate * -np.expm1(discount * y), 1, c)
    spread = c + np.exp(np.minimum(np.log(rate * discount * (1 - discount)) + 2 * np.log(np.maximum(-np.expm1(y), 1e-300)) + (discount - 2) * y, 600.0))
    width = 0.65 * np.sqrt(np.maximum(middle - c * c / spread, 0.3))
    edge = lambda x: 0.5 * (1 + np.tanh(0.5 * np.clip((x - middle) / width, -500, 500)))

    def value(t):
        tail = np.where(t > middle, edge(2 * middle - t + 0.5) - edge(2 * middle - t - 0.5), edge(t + 0.5) - edge(t - 0.5))
        return t * np.log(rate) + log_ways(c, t, discount) - np.log(np.maximum(tail, 1e-300))

    t = np.clip(np.round(middle), 1, c)
    now = value(t)
    for k in range(STEPS):
        u = uniforms(step, *keys, 2 * k)
        to = np.round(middle + width * (np.log(u) - np.log1p(-u)))
        can = (to >= 1) & (to <= c)
        to = np.where(can, to, t)
        then = value(to)
        go = can & (np.log(uniforms(step, *keys, 2 * k + 1)) < then - now)
        t, now = np.where(go, to, t), np.where(go, then, now)
    return t.astype(np.int64)


# -- step 1: words ----------------------------------------------------------------------------------------------------


class Chunk:
    """The tokens of a chunk: word hashes in document order, training documents first, each followed by an end."""

    def __init__(self, blob: bytes):
        batch = chunks.rows_of(blob)
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        self.order = np.argsort(held, kind="stable")
        self.n_train = int((~held).sum())
        self.batch = batch.take(pa.array(self.order))
        words, sizes = [], []
        for s in tokens.slices(self.batch.column("text")):
            low = tokens.Slice(s.row0, s.row1, _LOWER[s.data], s.offs)
            words.append(low.hashes)
            sizes.append(np.diff(low.words[2]))
        words, sizes = np.concatenate(words), np.concatenate(sizes)
        self.ends = np.cumsum(sizes + 1) - 1
        self.hashes = np.full(len(words) + len(sizes), _END)
        inner = np.ones(len(self.hashes), bool)
        inner[self.ends] = False
        self.hashes[inner] = words
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.words, self.index = np.unique(self.hashes, return_inverse=True)


def _range(words: np.ndarray, parts: int) -> np.ndarray:
    """Parts as ranges of names, so that numbers do not depend on how many there are."""
    return (((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _classes(c: np.ndarray) -> np.ndarray:
    """The binary order of magnitude of a count, from 1; 0 for none."""
    return np.frexp(c.astype(float))[1] * (c > 0)


def _count_words(table: pa.Table) -> pa.Table:
    """Counts, and the place of each known word among those of its magnitude here, in the order of names."""
    heads, (asked, n) = chunks.read_asked(table, "<u8", "<u4")
    words, inverse = np.unique(asked, return_inverse=True)
    c = np.bincount(inverse, n, len(words)).astype(np.int64)
    kind = _classes(c)
    sizes = np.bincount(kind, minlength=64)
    order = np.argsort(kind, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[kind[order]]
    sizes[0] = c.sum()  # the tokens, in the place of the unknown words
    stats = table.column("part")[0].as_py().to_bytes(8, "little") + chunks.pack(sizes.astype("<i8"))
    return chunks.answer_rows(table, heads, place[inverse].astype("<u8"), c[inverse].astype("<u8"), extra=stats)


def _numbering(stats: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """By magnitude and part, the number of the first word there, frequent ones first; V; and N."""
    sizes, at = np.zeros((64, len(parts)), np.int64), {int(x): k for k, x in enumerate(parts)}
    for x in stats:
        sizes[:, at[int.from_bytes(x[:8], "little")]] = chunks.unpack(x[8:], "<i8")[0]
    n, sizes[0] = int(sizes[0].sum()), 0
    falling = sizes[::-1].ravel()
    return (np.cumsum(falling) - falling).reshape(64, len(parts))[::-1] + FIRST, int(falling.sum()), n


# -- step 2: pairs ----------------------------------------------------------------------------------------------------


def _by_pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The stable order by context and word: one sort where both fit a number."""
    wide = int(w.max()) + 1 if len(w) else 1
    if len(u) and (int(u.max()) + 1) * wide < 1 << 63:
        return np.argsort(u * wide + w, kind="stable")
    return np.lexsort((w, u))


class _Sent:
    """The pairs of chunks of one group, until they are sent."""

    def __init__(self):
        self.chunks, self.pairs, self.docs, self.size = [], [], [], 0

    def add(self, chunk: int, pairs: list[np.ndarray], docs: np.ndarray) -> None:
        """pairs: part, context, word, customers of the context, training count, times; docs: of every time, in that order."""
        self.chunks.append(chunk)
        self.pairs.append(pairs)
        self.docs.append(docs)
        self.size += sum(a.nbytes for a in pairs) + docs.nbytes

    def rows(self):
        n = len(self.chunks)
        part, u, w, cu, c, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        at = np.repeat(np.arange(n), [len(p[0]) for p in self.pairs])
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(times.astype(np.int64))
        docs, size = np.concatenate(self.docs), times[order].astype(np.int64)
        first = np.repeat((ends - times)[order] - (np.cumsum(size) - size), size)
        docs = docs[first + np.arange(len(docs))]
        part, u, w, cu, c, times, at = (x[order] for x in (part, u, w, cu, c, times, at))
        ends = np.concatenate([[0], np.cumsum(size)])
        numbers = np.array(self.chunks, "<u4")
        for x, y in chunks.runs(part):
            sizes = np.bincount(at[x:y], minlength=n)
            step = lambda a: np.diff(a[x:y].astype("<u8"), prepend=np.uint64(0))  # noqa: B023, E731
            yield int(part[x]), chunks.pack(numbers, sizes.astype("<u4"), step(u), w[x:y].astype("<u8"), step(cu), c[x:y].astype("<u4"), times[x:y].astype("<u4"), docs[ends[x] : ends[y]].astype("<u4"))


def _chunk_pairs(c: Chunk, place: np.ndarray, count: np.ndarray, offsets: np.ndarray, parts: int, pair_parts: int, n: int, v: int):
    """A chunk's row of ids and counts of its documents; and its pairs, as _Sent takes them."""
    ids = np.where(count > 0, offsets[_classes(count), _range(c.words, parts)] + place, NONE)
    train_docs = int(count[np.searchsorted(c.words, _END)])

    first = np.concatenate([[0], c.ends[:-1] + 1])
    per = count[c.index]
    base = np.add.reduceat(np.log10((per + 0.5) / (n + 0.5 * (v + 1))), first)
    info = chunks.pack(np.diff(np.append(first, len(per))).astype("<i8"), np.add.reduceat((per > 0).astype("<i8"), first), base)

    w = ids[c.index]
    u, cu = np.empty_like(w), np.empty_like(per)
    u[1:], cu[1:] = w[:-1], per[:-1]
    u[first], cu[first] = START, train_docs
    order = _by_pair(u, w)  # documents stay in order
    u, w, cu, doc = u[order], w[order], cu[order], c.doc[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    lead = np.flatnonzero(new)
    times = np.diff(np.append(lead, len(u)))
    trained = np.add.reduceat((doc < c.n_train).astype(np.int64), lead)
    u, w, cu = u[lead], w[lead], np.where(u[lead] == NONE, 0, cu[lead])
    ways = np.maximum(1, -(-cu // HOT))
    deal = np.where(ways > 1, (tokens.mix(w.astype(np.uint64)) % ways.astype(np.uint64)).astype(np.int64), 0)
    part = _part(np.where(u == NONE, tokens.mix(w.astype(np.uint64)), tokens.mix(u.astype(np.uint64)) + deal.astype(np.uint64)), pair_parts)
    wide = np.int64 if max(v, int(cu.max())) >> 31 else np.int32
    return info, [part, u.astype(wide), w.astype(wide), cu.astype(wide), trained.astype(np.int32), times.astype(np.int32)], doc.astype(np.int32)


class Pairs:
    """What all chunks sent to a part, merged; the same however the rows arrive."""

    def __init__(self, table: pa.Table):
        self.groups = table.column("grp").to_pylist()
        got = [chunks.unpack(x, "<u4", "<u4", "<u8", "<u8", "<u8", "<u4", "<u4", "<u4") for x in table.column("asked").to_pylist()]
        u, w, cu, c = (np.concatenate(x).astype(np.int64) for x in zip(*((np.cumsum(g[2]), g[3], np.cumsum(g[4]), g[5]) for g in got), strict=True))
        order = _by_pair(u, w)
        su, sw = u[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        self.sent = [(g[0], g[1], p, g[6], g[7]) for g, p in zip(got, np.split(pair, np.cumsum([len(g[3]) for g in got])[:-1]), strict=True)]
        lead = order[new]
        pu = u[lead]
        turn = np.append(True, pu[1:] != pu[:-1])  # contexts come in order
        at, (words, word) = np.cumsum(turn) - 1, np.unique(w[lead], return_inverse=True)
        self.seats = Seats(words, pu[turn], cu[lead][turn], at, word.ravel(), np.bincount(pair, c, len(lead)).astype(np.int64))

    def sums(self, log: np.ndarray):
        """(group, chunk, packed document numbers and sums) of the integers log, one per pair."""
        for group, (numbers, sizes, pair, times, docs) in zip(self.groups, self.sent, strict=True):
            a = x = 0
            for chunk, size in zip(numbers.tolist(), sizes.tolist(), strict=True):
                if size:
                    b, y = a + size, x + int(times[a : a + size].sum(dtype=np.int64))
                    total = np.bincount(docs[x:y], np.repeat(log[pair[a:b]].astype(float), times[a:b]))
                    some = np.flatnonzero(total)
                    yield group, chunk, chunks.pack(some.astype("<u4"), total[some].astype("<i8"))
                    a, x = b, y


# -- step 3: sweeps ---------------------------------------------------------------------------------------------------


class Seats:
    """A part's words, contexts (with all their customers, wherever these sit), and pairs with training counts."""

    KINDS = ("<i8",) * 3 + ("<i4", "<i4", "<i8")

    def __init__(self, words, contexts, customers, at, word, c):
        self.words, self.contexts, self.customers, self.at, self.word, self.c = words, contexts, customers, at, word, c
        self.keys = np.concatenate([2 * words, 2 * contexts + 1])
        self.order = np.argsort(self.keys)

    def packed(self) -> bytes:
        """Without the pairs that no training text has; all words and contexts stay."""
        some = np.flatnonzero(self.c)
        return chunks.pack(*(x.astype(k) for x, k in zip((self.words, self.contexts, self.customers, self.at[some], self.word[some], self.c[some]), self.KINDS, strict=True)))

    @classmethod
    def unpacked(cls, blob: bytes) -> Seats:
        return cls(*chunks.unpack(blob, *cls.KINDS))

    def draw(self, step: int, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The pairs' tables of a sweep, given those of their contexts and the words' parent probabilities before it."""
        x = gammas(STRENGTH / DISCOUNT + tables, 4 * step, self.contexts)
        return draw_tables(self.c, x[self.at] * base[self.word], DISCOUNT, 4 * step + 1, self.contexts[self.at], self.words[self.word])

    def told(self, part: int, tables: np.ndarray, roots: np.ndarray) -> pa.Table:
        """Tables by word and by context, for the parent's parts."""
        value = np.concatenate([np.bincount(self.word, tables, len(self.words)), np.bincount(self.at, tables, len(self.contexts))])[self.order]
        keys = self.keys[self.order]
        root = _part((keys >> 1).astype(np.uint64), len(roots))
        order = np.argsort(root, kind="stable")
        spans = chunks.runs(root[order])
        blobs = [chunks.pack(np.diff(keys[order[x:y]].astype("<u8"), prepend=np.uint64(0)), value[order[x:y]].astype("<u8")) for x, y in spans]
        return pa.table([pa.array([part] * len(spans), pa.int64()), pa.array([int(roots[root[order[x]]]) for x, _ in spans], pa.int64()), pa.array(blobs, pa.binary())], ["part", "root", "asked"])

    def heard(self, said: list[dict], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent's customers and tables of each word, and the tables of each context."""
        root = _part((self.keys[self.order] >> 1).astype(np.uint64), len(roots))
        order = self.order[np.argsort(root, kind="stable")]
        at = {int(x): k for k, x in enumerate(roots)}
        by = sorted((at[x["root"]], x["answer"]) for x in said)
        found = [np.concatenate(x).astype(np.int64) for x in zip(*(chunks.unpack(a, "<u8", "<u8") for _, a in by), strict=True)]
        values = np.zeros((2, len(self.keys)), np.int64)
        values[:, order] = found
        n = len(self.words)
        return values[0, :n], values[1, :n], values[0, n:]


class Parent:
    """The unigram restaurant after a sweep, as far as all parts know it: V, its customers and its tables."""

    def __init__(self, v: int, customers: int, tables: int):
        self.v, self.customers, self.tables = v, customers, tables

    def share(self) -> float:
        return (1 - UNKNOWN) / max(1, self.v)

    def draw(self, step: int, words: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Each word's tables in the next seating, with these customers; self.tables are those of the one before."""
        x = gammas(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + self.tables]), 4 * step + 2, np.zeros(1, np.int64))
        return draw_tables(customers, np.full(len(words), x[0] * self.share()), ROOT_DISCOUNT, 4 * step + 3, words)

    def probability(self, words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The predictive probability of words with these customers and tables."""
        unknown = words == NONE
        share = np.where(unknown, UNKNOWN if self.v else 1.0, self.share())
        own = np.where(unknown, 0.0, customers - ROOT_DISCOUNT * tables)
        return (np.maximum(own, 0) + (ROOT_STRENGTH + ROOT_DISCOUNT * self.tables) * share) / (ROOT_STRENGTH + self.customers)


TOLD = "part long, root long, asked binary"


def _open(roots: np.ndarray):
    """Merges a part's pairs, and tells the first seating: every dish at one table."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        seats = Pairs(table).seats
        told = seats.told(part, np.minimum(seats.c, 1), roots)
        own = pa.table([pa.array([part], pa.int64()), pa.array([-1], pa.int64()), pa.array([seats.packed()], pa.binary())], ["part", "root", "asked"])
        return pa.concat_tables([own, told])

    return run


def _sweep(roots: np.ndarray, step: int, parent: Parent):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.schema([("part", pa.int64()), ("root", pa.int64()), ("asked", pa.binary())]).empty_table()
        seats = Seats.unpacked(left.column("asked")[0].as_py())
        customers, tables, own = seats.heard(right.column("said")[0].as_py(), roots)
        return seats.told(left.column("part")[0].as_py(), seats.draw(step, own, parent.probability(seats.words, customers, tables)), roots)

    return run


def _seat_parent(step: int, parent: Parent):
    """Adds up tables by word and context, seats the words in the parent, and answers with customers and tables."""

    def run(table: pa.Table) -> pa.Table:
        root = table.column("root")[0].as_py()
        asked = [chunks.unpack(x, "<u8", "<u8") for x in table.column("asked").to_pylist()]
        keys, inverse = np.unique(np.concatenate([np.cumsum(a[0]) for a in asked]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(keys)).astype(np.int64)
        word = np.flatnonzero((keys % 2 == 0) & (keys != 2 * NONE))
        tables = np.zeros(len(keys), np.int64)
        tables[word] = parent.draw(step, keys[word] >> np.uint64(1), n[word])
        out = [chunks.pack(n[i].astype("<u8"), tables[i].astype("<u8")) for i in np.split(inverse, np.cumsum([len(a[0]) for a in asked])[:-1])]
        stats = chunks.pack(np.array([n[word].sum(), tables[word].sum()], "<i8"))
        return pa.table([pa.array([*table.column("part").to_pylist(), -1], pa.int64()), pa.array([root] * (len(out) + 1), pa.int64()), pa.array([*out, stats], pa.binary())], ["part", "root", "answer"])

    return run


# -- step 4: scores ---------------------------------------------------------------------------------------------------


def predictive(seats: Seats, samples: list[tuple[int, Parent, tuple]]) -> np.ndarray:
    """The mean predictive probability of each pair; samples: the sweep, the parent after it, and what was heard then.

    The first of them is only what the next was drawn from.
    """
    p = np.zeros(len(seats.c))
    for (_, before, (c0, t0, own0)), (step, parent, (c1, t1, own1)) in itertools.pairwise(samples):
        tables = seats.draw(step, own0, before.probability(seats.words, c0, t0))
        base = parent.probability(seats.words, c1, t1)[seats.word]
        p += (np.maximum(seats.c - DISCOUNT * tables, 0) + (STRENGTH + DISCOUNT * own1[seats.at]) * base) / (STRENGTH + seats.customers[seats.at])
    return p / (len(samples) - 1)


def _sums(roots: np.ndarray, parents: dict[int, Parent]):
    """One row per chunk: its documents' sums of log10 probabilities, in units of 1 / SCALE."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("grp", pa.int64()), ("chunk", pa.int32()), ("sums", pa.binary())])
        if not len(left):
            return schema.empty_table()
        pairs = Pairs(left)
        heard = {x["sweep"]: pairs.seats.heard(x["said"], roots) for x in chunks.rows_in(right.combine_chunks().to_batches()[0])}
        p = predictive(pairs.seats, [(k, parents[k], heard[k]) for k in sorted(parents)])
        rows = list(pairs.sums(np.round(np.log10(p) * SCALE).astype(np.int64)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, text, held_out) to one row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = chunks.chunked(docs.select("doc_id", "held_out", "text"), "texts", CHUNK_BYTES)
    parts = chunks.even_parts(spark, table.count() // 16)

    def ask_words(batches):
        def question(row):
            c = Chunk(row["blob"])
            n = np.bincount(c.index[c.doc < c.n_train], minlength=len(c.words))
            return _range(c.words, len(parts)), (c.words, n.astype("<u4"))

        yield from chunks.asks(batches, parts, question)

    words = table.mapInArrow(ask_words, chunks.ASKED).groupBy("part").applyInArrow(_count_words, chunks.ANSWER)
    words = storage.written(chunks.gathered(words, "said"), "words")
    storage.release(spark)
    stats = words.where("grp = -1").select(F.explode("said")).select("col.answer").collect()  # 64 numbers a part
    offsets, v, n = _numbering([bytes(r[0]) for r in stats], parts)
    pair_parts = chunks.even_parts(spark, n // TOKENS_PER_PART)

    def send_pairs(batches):
        said, held, now = chunks.Said(parts, "<u8", "<u8"), _Sent(), None

        def row(group, part, asked, chunk=None, info=None):
            return pa.record_batch([pa.array([group], pa.int64()), pa.array([chunk], pa.int32()), pa.array([part], pa.int64()), pa.array([asked], pa.binary()), pa.array([info], pa.binary())], ["grp", "chunk", "part", "asked", "info"])

        for batch in batches:
            for one in chunks.rows_in(batch):
                if held.chunks and (one["grp"] != now or held.size > chunks.ASKED_BYTES):
                    yield from (row(now, int(pair_parts[k]), asked) for k, asked in held.rows())
                    held = _Sent()
                now, c = one["grp"], Chunk(one["blob"])
                place, count = (x.astype(np.int64) for x in said.to(one, one["said"], _range(c.words, len(parts))))
                info, pairs, doc = _chunk_pairs(c, place, count, offsets, len(parts), len(pair_parts), n, v)
                yield row(now, -1 - (now + one["chunk"]) % (1 << 30), chunks._seal(c.batch.select(["doc_id", "held_out"])), one["chunk"], info)
                held.add(one["chunk"], pairs, doc)
        if held.chunks:
            yield from (row(now, int(pair_parts[k]), asked) for k, asked in held.rows())

    # Bucketed by part, so that no reading below shuffles the pairs again.
    rows = chunks.answered(table, words).mapInArrow(send_pairs, "grp long, chunk int, part long, asked binary, info binary")
    rows = storage.bucketed(rows.repartition(storage.shuffle_partitions(spark), "part"), "pairs", "part")
    storage.delete(table)
    storage.delete(words)
    storage.release(spark)

    sent = rows.where("part >= 0").select("grp", "part", "asked")
    roots = chunks.even_parts(spark, 1)
    seats = storage.bucketed(sent.groupBy("part").applyInArrow(_open(roots), TOLD), "seats", "part")
    told, parent, heard = seats.where("root >= 0"), Parent(v, 0, v), {}
    parents: dict[int, Parent] = {}
    for step in range(burn_in + samples + 1):  # the first is the first seating
        answers = told.groupBy("root").applyInArrow(_seat_parent(step, parent), "part long, root long, answer binary")
        answers = storage.written(answers.groupBy("part").agg(F.collect_list(F.struct("root", "answer")).alias("said")), "parents")
        storage.release(spark)
        stats = [chunks.unpack(bytes(x["answer"]), "<i8")[0] for r in answers.where("part = -1").collect() for x in r["said"]]
        parent = Parent(v, *(int(sum(s[k] for s in stats)) for k in (0, 1)))
        parents[step], heard[step] = parent, answers
        told = seats.where("root < 0").select("part", "asked").groupBy("part").cogroup(answers.where("part >= 0").groupBy("part")).applyInArrow(_sweep(roots, step + 1, parent), TOLD)
        if 0 <= step - 1 < burn_in:
            storage.delete(heard.pop(step - 1))
            del parents[step - 1]
    storage.delete(seats)

    last = functools.reduce(DataFrame.unionByName, (a.where("part >= 0").withColumn("sweep", F.lit(k)) for k, a in heard.items()))
    sums = sent.groupBy("part").cogroup(last.groupBy("part")).applyInArrow(_sums(roots, parents), "grp long, chunk int, sums binary")
    sums = sums.groupBy("grp", "chunk").agg(F.collect_list("sums").alias("sums"))

    def finish(batches):
        for batch in batches:
            for one in chunks.rows_in(batch):
                rows = chunks.rows_of(one["asked"])
                tokens_, known, base = chunks.unpack(one["info"], "<i8", "<i8", "<f8")
                at, value = (np.concatenate(x) for x in zip(*(chunks.unpack(x, "<u4", "<i8") for x in one["sums"] or [chunks.pack(np.zeros(0, "<u4"), np.zeros(0, "<i8"))]), strict=True))
                score = np.bincount(at, value.astype(float), len(tokens_)) / SCALE
                yield pa.record_batch([rows.column("doc_id"), rows.column("held_out"), pa.array(tokens_), pa.array(known), pa.array(np.full(len(score), n), pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = rows.where("part < 0").select("grp", "chunk", "asked", "info").join(sums, ["grp", "chunk"], "left")
    out = whole.mapInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = storage.written(out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))), "scores")
    for df in (rows, *heard.values()):
        storage.delete(df)
    return out


def op8_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score_texts(docs.select("doc_id", "text", held.alias("held_out")))
