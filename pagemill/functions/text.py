"""Page-level scalar functions: Column in, Column out.

Lengths are bytes (octet_length), as thresholds are stated in bytes.  Patterns stay in the subset that the Java and RE2
dialects read alike: white space is written out, flags are inline, no lookaround and no back references.
"""

from __future__ import annotations

import gzip
import json
import re
import zlib
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\t\n\f\r ]"
TRIMMED = r"[\t\n\x0B\f\r \x{85}\x{A0}\p{Z}]"


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, f"^{TRIMMED}+|{TRIMMED}+$", "")


REFERENCE = r"^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});?"


def _character(n: Column) -> Column:
    """The character of a number; 128 to 159 mean those of windows-1252, and what is no character U+FFFD."""
    high = F.split(F.lit(",".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))), ",")
    bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(n.between(128, 159), F.try_element_at(high, (n - 127).cast("int"))).otherwise(plain)


def unescape(c: Column, attribute: bool = False, closed: bool = False) -> Column:
    """Character references decoded: numbers, and the names of HTML 4; those of Latin-1 may lack the semicolon.

    In an attribute a name without semicolon stays before an equals sign, so that queries survive.
    closed: without a semicolon, names and numbers stay as written.
    """
    # As JSON, so that plans carry one literal and not hundreds.
    names, latin = (F.from_json(F.lit(json.dumps({k: chr(v) for k, v in name2codepoint.items() if v < limit})), "map<string,string>") for limit in (1 << 20, 256))

    def decoded(piece: Column) -> Column:
        found = F.regexp_extract(piece, REFERENCE.removesuffix("?") if closed else REFERENCE, 0)
        name, rest = F.rtrim(found, F.lit(";")), F.substring(piece, F.length(found) + 1, F.lit(2**31 - 1))
        ended = F.endswith(found, F.lit(";"))
        number = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).try_cast("bigint")
        loose = F.map_contains_key(latin, name)
        if attribute:
            loose = loose & ~F.startswith(rest, F.lit("="))
        named = F.when(ended | loose, F.try_element_at(names, name))
        sign = F.when(found == "", F.lit(None)).when(F.startswith(name, F.lit("#")), _character(number)).otherwise(named)
        return F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(c, "&")
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def visible(html: Column) -> Column:
    """Without comments, scripts and styles, whichever begins first."""
    return F.regexp_replace(html, r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z))", "")


def title(html: Column, closed: bool = False) -> Column:
    """Text of all title elements, joined, untrimmed; closed as in unescape."""
    return unescape(F.array_join(F.regexp_extract_all(visible(html), F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"), F.lit(1)), ""), closed=closed)


def page_text(html: Column) -> Column:
    """Styles and scripts removed, tags to newlines, runs of white space to one newline, trimmed; entities stay."""
    c = F.regexp_replace(html, r"(?is)<style.+?</style>", "")
    c = F.regexp_replace(c, r"(?is)<script.+?</script>", "")
    c = F.regexp_replace(c, r"(?s)<.+?>", "\n")
    return trim_ws(F.regexp_replace(c, SPACE + "{2,}", "\n"))


def page_text_hash(html: Column) -> Column:
    text = page_text(html)
    return F.when(F.octet_length(text) > 0, F.md5(text)).otherwise("")


def base64(c: Column) -> Column:
    """Standard base64 on one line."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def base64_mime(c: Column) -> Column:
    """76-character lines, each ended by a newline; nothing for nothing."""
    plain = base64(c)
    return F.when(F.octet_length(c) > 0, F.regexp_replace(plain, r"(.{76}|.+$)", "$1\n")).otherwise("")


def split_bytes(c: Column, size: int) -> Column:
    """Pieces of at most size bytes."""
    raw = c.cast("binary")
    n = F.octet_length(raw)
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)), lambda i: F.substring(raw, i, F.lit(size))))


def search(c: Column, key: str, lower: bool = False) -> Column:
    """Substring test; lower folds the text only, never the key."""
    return F.contains(F.lower(c) if lower else c, F.lit(key))


def regex_groups(c: Column, pattern: str, groups: int) -> Column:
    """[whole, group 1, ...] of the first match, null without one."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError("lookaround and back references are not in the common dialect")
    return F.when(F.rlike(c, F.lit(pattern)), F.array(*(F.regexp_extract(c, pattern, i) for i in range(groups + 1))))


def first_line(c: Column, test) -> Column:
    """The first line, \\r\\n or \\n ended, for which test(line) holds; null if none."""
    return F.try_element_at(F.filter(F.split(c, r"\r?\n"), test), F.lit(1))


def unique_lines(c: Column) -> Column:
    """Trimmed lines without blanks, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "\n"), trim_ws), lambda x: x != ""))


def json_body(c: Column) -> Column:
    """The body as map<string,string>; what is not an object gives a map with the one key output."""
    parsed = F.from_json(c, "map<string,string>")
    bad = F.try_parse_json(c).isNull() | parsed.isNull()
    return F.when(bad, F.create_map(F.lit("output"), F.lit("not a JSON object"))).otherwise(parsed)


def header_json(headers: Column) -> Column:
    """First value of each header as JSON, keys sorted."""
    entries = F.array_sort(F.map_entries(F.transform_values(headers, lambda _, v: F.get(v, F.lit(0)))))
    return F.to_json(F.map_from_entries(entries))


def header_lines(headers: Column) -> Column:
    """`name : first value` lines, sorted by name."""
    entries = F.array_sort(F.map_entries(F.transform_values(headers, lambda _, v: F.get(v, F.lit(0)))))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(" : ", e["key"], e["value"])), "\n")


def alive(status: Column) -> Column:
    return status.between(200, 399)


# -- Python, in Arrow batches: no built-in says these --------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def decode_body(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Gunzips bodies whose encoding is gzip; others, and broken ones, stay as they are."""

    def one(raw, kind):
        if raw is None or kind != "gzip":
            return raw
        try:
            return gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return raw

    return pd.Series([one(r, k) for r, k in zip(body, encoding, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def gzip_body(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else gzip.compress(x.encode(), 1))


def sniff_charset(raw: bytes) -> str:
    """A byte-order mark, a declared charset in the first 1024 bytes, valid UTF-8, or windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if raw.startswith(mark):
            return name
    if m := re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", raw[:1024]):
        return m[1].decode().lower()
    try:
        raw[:8192].decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        return "utf-8" if len(raw) > 8192 and e.start > 8188 else "windows-1252"


@F.pandas_udf(T.StringType())
def decode_charset(body: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        try:
            return raw.decode(sniff_charset(raw), "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")

    return body.map(one)


def murmur3_32(bodies: list[bytes], seed: int = 0) -> np.ndarray:
    """Murmur3 x86 32-bit, signed, of many bodies at once: the k-th words of all that have one are taken together."""
    u = np.uint32
    turn = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    scramble = lambda k: turn(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    size = np.array([len(x) for x in bodies], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    words = np.frombuffer(b"".join(bodies[i] + bytes(-len(bodies[i]) % 4) for i in order), "<u4")
    first = np.cumsum((size + 3) // 4) - (size + 3) // 4
    h = np.full(len(bodies), seed, u)
    for k in range(int(size[0]) // 4 if len(size) else 0):
        n = int(np.searchsorted(-(size // 4), -k, "left"))  # those with more than k whole words come first
        h[:n] = turn(h[:n] ^ scramble(words[first[:n] + k]), 13) * u(5) + u(0xE6546B64)
    tail = np.flatnonzero(size % 4)
    h[tail] ^= scramble(words[first[tail] + size[tail] // 4])
    h ^= size.astype(u)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    out = np.empty(len(bodies), np.int32)
    out[order] = (h ^ (h >> u(16))).view(np.int32)
    return out


@F.pandas_udf(T.IntegerType())
def mmh3(body: pd.Series) -> pd.Series:
    """Signed murmur3 of bodies over 28 bytes; 0 for shorter ones."""
    long = [i for i, raw in enumerate(body) if raw is not None and len(raw) > 28]
    out = pd.Series([None if raw is None else 0 for raw in body], dtype="Int32")
    out.iloc[long] = murmur3_32([body.iloc[i] for i in long])
    return out


def mmh3_body(html: Column) -> Column:
    return mmh3(html.cast("binary"))


def mmh3_base64(html: Column) -> Column:
    """The hash of the MIME base64 text, the usual favicon fingerprint."""
    return mmh3(base64_mime(html).cast("binary"))
