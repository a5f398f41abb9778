import base64 as b64
import gzip

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import templates, text, urls


def one(spark, rows, schema, *columns):
    out = spark.createDataFrame(rows, schema).select(*columns).collect()
    return [tuple(r) if len(r) > 1 else r[0] for r in out]


def test_page_text(spark):
    cases = ["<STYLE>p{}</STYLE>a  b<br>c", "<script></script>kept<script>x</script>", "", "a&amp;b ", "x <b>y</b>", None, "<!-- c -->t"]
    got = one(spark, [(c,) for c in cases], "h string", text.page_text(F.col("h")))
    assert got == ["a\nb\nc", "kept", "", "a&amp;b", "x\ny", None, "t"]
    assert one(spark, [("<p></p>",), ("a",)], "h string", text.page_text_hash(F.col("h"))) == ["", "0cc175b9c0f1b6a831c399e269772661"]


@pytest.mark.parametrize("n", [0, 1, 3, 56, 57, 58, 114, 115, 1000])
def test_base64(spark, n):
    raw = "ü" * (n // 2) + "x" * (n % 2)
    plain, mime = one(spark, [(raw,)], "t string", text.base64(F.col("t")), text.base64_mime(F.col("t")))[0]
    assert plain == b64.b64encode(raw.encode()).decode()
    assert mime == b64.encodebytes(raw.encode()).decode()


def test_murmur3():
    # Published vectors of the 32-bit function.
    for raw, seed, want in [(b"", 0, 0), (b"", 1, 0x514E28B7), (b"test", 0, 0xBA6BD213), (b"Hello, world!", 0, 0xC0363E43), (b"The quick brown fox jumps over the lazy dog", 0, 0x2E4FF723), (b"aaa", 0x9747B28C, 0x283E0130)]:
        assert int(text.murmur3_32([b"other text", raw, b""], seed)[1]) & 0xFFFFFFFF == want


def test_mmh3_guard(spark):
    short, long = one(spark, [("x" * 28,), ("x" * 29,)], "t string", text.mmh3_body(F.col("t")))
    assert short == 0
    assert long == text.murmur3_32([b"x" * 29])[0]


def test_small_scalars(spark):
    assert one(spark, [("ABC",)], "t string", text.search(F.col("t"), "b", True), text.search(F.col("t"), "b"), text.search(F.col("t"), "B", True)) == [(True, False, False)]
    assert one(spark, [("a\r\nbb\nccc",)], "t string", text.first_line(F.col("t"), lambda x: F.length(x) > 1)) == ["bb"]
    assert one(spark, [(" a \n\nb\na \n",)], "t string", text.unique_lines(F.col("t"))) == [["a", "b"]]
    assert one(spark, [('{"a": 1}',), ("nope",)], "t string", text.json_body(F.col("t"))) == [{"a": "1"}, {"output": "not a JSON object"}]
    assert one(spark, [("abcde",), ("",)], "t string", F.transform(text.split_bytes(F.col("t"), 2), lambda x: x.cast("string"))) == [["ab", "cd", "e"], []]
    assert one(spark, [("ab12",), ("x",)], "t string", text.regex_groups(F.col("t"), r"([a-z]+)(\d+)", 2)) == [["ab12", "ab", "12"], None]
    with pytest.raises(ValueError):
        text.regex_groups(F.col("t"), "(?=a)", 0)
    assert one(spark, [(gzip.compress(b"hi"), "gzip"), (b"hi", None), (b"broken", "gzip"), (None, "gzip")], "b binary, e string", text.decode_body(F.col("b"), F.col("e"))) == [b"hi", b"hi", b"broken", None]
    assert one(spark, [("é".encode("latin-1"),), ("é".encode(),), (b'<meta charset="iso-8859-2">\xb1',)], "b binary", text.decode_charset(F.col("b"))) == ["é", "é", '<meta charset="iso-8859-2">ą']


def test_urls(spark):
    assert one(spark, [(" http://h/ ", "a", " /b")], "b string, x string, y string", urls.url_join(F.col("b"), F.col("x"), F.col("y"))) == ["http://h/a /b"]
    assert one(spark, [("h", "/"), ("h", "/a//b/"), ("h", "/../../x"), ("h", "/a/./b/../c?x=//y")], "h string, r string", urls.path_join(F.col("h"), F.col("r"))) == ["h", "h/a/b", "../x", "h/a/c?x=/y"]
    assert one(spark, [("http://u@h:8/p",), ("not a url",), (None,)], "u string", urls.host_port(F.col("u")), urls.hostname(F.col("u"))) == [("h:8", "h"), (None, None), (None, None)]
    rows = [("abc", "abd"), ("", "x"), ("é", "è"), ("same", "same")]
    assert one(spark, rows, "a string, b string", urls.common_prefix(F.col("a"), F.col("b"))) == [2, 0, 1, 4]


def reference_distance(a: str, b: str) -> float:
    import re

    import numpy as np

    f = np.float32

    def prefix(x, y):
        x, y, n = x.encode(), y.encode(), 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    d = f(1) - f(prefix(a, b)) / f(max(len(a.encode()), len(b.encode())))
    if d > f(0.4):
        s, t = re.split(r"[^0-9A-Za-z_]", a), re.split(r"[^0-9A-Za-z_]", b)
        total = f(0)
        for x, y in zip(s, t, strict=False):
            total += f(1) if x == y else f(0) if not x or not y else f(prefix(x, y)) / f(max(len(x.encode()), len(y.encode())))
        d = f(1) - total / f(max(len(s), len(t)))
    return float(d)


def test_distance(spark):
    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.tuples(*[st.from_regex(r"https?://[a-c.é]{1,6}(/[a-c0-9-]{0,5}){0,4}", fullmatch=True)] * 2), min_size=20, max_size=40))
    def run(pairs):
        a, b = F.col("a"), F.col("b")
        for (x, y), (d, e) in zip(pairs, one(spark, pairs, "a string, b string", urls.distance(a, b), urls.distance(b, a)), strict=True):
            assert d == e == pytest.approx(reference_distance(x, y), abs=0)
            assert 0 <= d <= 1
            assert (d == 0) or x != y

    run()


@pytest.mark.parametrize(
    ("title", "link", "keep"),
    [
        ("1234567", "h/a", False),
        ("12345678", "h/a", False),
        ("1234567:", "h/a", True),
        ("abcdefghijklmno", "h/a", True),
        ("abcdefghijklmn", "h/a", False),
        ("年月日年月日:", "h/a", True),
        ("abcdefghijklmno.com", "h/a", False),
        ("ab@cdef:!", "h/a", False),
        ("ab@cdefgh:!.xyz", "h/a", True),
        ("a@b.cdefghi:!,", "h/a", False),
        ("a/bcdefghijklmn:", "h/a", True),
        ("a/bcdefghijklm:", "h/a", False),
        ("abcdefghijklmnopq", "##", False),
        ("abcdefghijklmnopq", "//", False),
    ],
)
def test_headline(spark, title, link, keep):
    assert one(spark, [(title, link)], "t string, l string", urls.is_headline(F.col("t"), F.col("l"))) == [keep]


def test_templates(spark):
    v = F.col("v")
    assert one(spark, [("x",), ("{}",)], "v string", templates.format_first("{}-{}", v)) == ["x-x", None]
    assert one(spark, [("{b}",)], "v string", templates.format_map("{a}/{b}/{zz}", {"a": v, "b": F.lit("B")})) == ["{b}/B/{zz}"]
    assert one(spark, [("7",), ("x",), ("-1",)], "v string", templates.bump(v, 1), templates.as_int(v)) == [("8", 7), ("x", 0), ("0", -1)]
