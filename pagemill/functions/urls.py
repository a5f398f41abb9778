"""URL functions: joins, features, similarity, and the headline rule."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import trim_ws


def url_join(base: Column, *parts: Column) -> Column:
    """base without one trailing slash, and each part after a slash unless it brings its own."""
    out = F.regexp_replace(trim_ws(base), "/$", "")
    for part in parts:
        out = F.when(F.startswith(trim_ws(part), F.lit("/")), F.concat(out, part)).otherwise(F.concat(out, F.lit("/"), part))
    return out


def host_port(url: Column) -> Column:
    """The authority without user info; null for what is not a URL."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^.*@", "")


def hostname(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def scheme(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL"))


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def path_join(host: Column, href: Column) -> Column:
    """host/href as a cleaned path: no empty, `.` or `..` segments, no trailing slash, and no scheme."""
    segments = F.split(F.concat(host, F.lit("/"), href), "/")

    def fold(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when((s == "") | (s == "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), fold), "/")


def segments(url: Column) -> Column:
    """Pieces between characters that are not [0-9A-Za-z_], empty ones kept."""
    return F.split(url, r"[^0-9A-Za-z_]", -1)


def separators(url: Column) -> Column:
    return F.regexp_extract_all(url, F.lit(r"([^0-9A-Za-z_])"), F.lit(1))


def features(url: Column, title: Column | None = None) -> Column:
    """url, title, host, len (bytes), rank (segments), separators, segments; null for what is not a URL."""
    title = F.lit("") if title is None else title
    made = F.struct(url.alias("url"), trim_ws(title).alias("title"), host_port(url).alias("host"), F.octet_length(url).alias("len"), F.size(segments(url)).alias("rank"), separators(url).alias("separators"), segments(url).alias("segments"))
    return F.when(url.isNotNull(), made)


def common_prefix(a: Column, b: Column) -> Column:
    """Equal leading bytes, found by halving: a longer step is taken where the bytes in it are equal."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(a), F.octet_length(b))

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= n) & (F.substring(x, at + 1, step) == F.substring(y, at + 1, step)), at + step).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), further)


def prefix_similarity(a: Column, b: Column) -> Column:
    """Common prefix over the longer length, as FLOAT; 0 if either is empty."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), F.lit(0.0)).otherwise(common_prefix(a, b) / longer).cast("float")


def distance(a: Column, b: Column) -> Column:
    """URL distance in [0, 1], as FLOAT: by common prefix; beyond 0.4, by the segments at equal places."""
    near = (F.lit(1.0).cast("float") - (common_prefix(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))).cast("float")).cast("float")
    s, t = segments(a), segments(b)
    n = F.least(F.size(s), F.size(t))
    score = F.zip_with(F.slice(s, 1, n), F.slice(t, 1, n), lambda x, y: F.when(x == y, F.lit(1.0).cast("float")).otherwise(prefix_similarity(x, y)))
    total = F.aggregate(score, F.lit(0.0).cast("float"), lambda acc, x: (acc + x).cast("float"))
    far = (F.lit(1.0).cast("float") - (total / F.greatest(F.size(s), F.size(t))).cast("float")).cast("float")
    return F.when(near > F.lit(0.4).cast("float"), far).otherwise(near)


def _prefixes(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Equal leading bytes of each x and y: along both, sorted together, the least of those of neighbours."""
    every = sorted({*xs, *ys})
    at = {x: i for i, x in enumerate(every)}
    size = np.array([len(x) for x in every], np.int32)
    near = np.zeros(len(every) + 1, np.int32)  # of each with the one before
    for i in range(1, len(every)):
        x, y = every[i - 1], every[i]
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
        near[i] = n - (differ.bit_length() + 7) // 8
    to = np.array([at[y] for y in ys], np.int64)
    out = np.empty((len(xs), len(ys)), np.int32)
    row = np.empty(len(every), np.int32)
    for k, x in enumerate(xs):
        i = at[x]
        row[i] = size[i]
        np.minimum.accumulate(near[i + 1 : -1], out=row[i + 1 :])
        np.minimum.accumulate(near[i:0:-1], out=row[:i][::-1])
        np.take(row, to, out=out[k])
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """distance() of each of a and each of b, as a matrix: the same numbers, from what equal segments share."""
    x, y = [u.encode() for u in a], [u.encode() for u in b]
    longer = lambda p, q: np.maximum(np.array([len(z) for z in p], np.int32)[:, None], np.array([len(z) for z in q], np.int32))
    with np.errstate(invalid="ignore"):
        near = np.float32(1) - (_prefixes(x, y) / longer(x, y)).astype(np.float32)
    s, t = ([re.split("[^0-9A-Za-z_]", u) for u in z] for z in (a, b))
    total = np.zeros(near.shape, np.float32)
    for k in range(min(max(map(len, s), default=0), max(map(len, t), default=0))):
        p, q = ({v: i for i, v in enumerate({u[k] for u in z if len(u) > k})} for z in (s, t))
        if len(p) == len(q) == 1 and p == q and all(len(u) > k for z in (s, t) for u in z):
            total += np.float32(1)
            continue
        score = np.zeros((len(p) + 1, len(q) + 1), np.float32)  # the last ones: no such segment
        score[:-1, :-1] = _prefixes([v.encode() for v in p], [v.encode() for v in q]) / np.maximum(longer(p, q), 1)
        if "" in p and "" in q:
            score[p[""], q[""]] = 1
        i, j = (np.array([d[u[k]] if len(u) > k else len(d) for u in z], np.int64) for z, d in ((s, p), (t, q)))
        total += np.take(np.take(score, j, axis=1), i, axis=0)
    far = np.float32(1) - (total / longer(s, t).astype(np.float64)).astype(np.float32)
    return np.where(near > np.float32(0.4), far, near)


def is_headline(title: Column, link: Column) -> Column:
    """The headline rule; lengths are bytes of the untrimmed title."""
    n = F.octet_length(title)
    distinct = lambda c: F.array_join(F.array_distinct(F.split(trim_ws(c), "")), "")
    has = lambda s: F.contains(title, F.lit(s))
    shape = F.array_distinct(F.filter(F.split(trim_ws(link), ""), lambda x: x != ""))
    plain = F.octet_length(distinct(title)) < 15
    return (
        (n >= 8)
        & ~((F.size(shape) == 1) & F.get(shape, F.lit(0)).isin("#", "/"))
        & (~plain | has(":") | has("!") | has(","))
        & ~has(".com")
        & ~(has("@") & (n < 10))
        & ~(has("@") & has(".") & (n < 15))
        & ~(has("/") & (n < 16))
    )
