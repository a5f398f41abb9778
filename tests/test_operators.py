import datetime
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators import article, dom, generators, incremental, links, news, sitemap
from pagemill.operators.pages import Pages
from pagemill.sources import config, readers, sinks
from pagemill.streaming import monitor, supervisor

PAGES = "page_id long, url string, html string"


def pages(spark, *htmls, url="http://h.org/x"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], PAGES)


LINKS = '<a href="/a">1</a><a href="/a">2</a><a href="/">r</a><a href="">e</a><a>n</a><a href="//cdn/x">c</a><a href="http://o.org/y">o</a><a href="rel">r</a><a href="#">h</a><a href="mailto:x@y">m</a>'


@pytest.mark.parametrize("exact", [False, True])
def test_page_links(spark, exact):
    got = {r.link for r in links.page_links(pages(spark, LINKS), exact=exact).collect()}
    assert got == {"http://h.org/a", "http://h.org//cdn/x"}
    got = {r.link for r in links.page_links(pages(spark, LINKS), include_outer=True, exact=exact).collect()}
    assert got == {"http://h.org/a", "http://h.org//cdn/x", "http://o.org/y"}
    assert links.page_links(pages(spark, LINKS, url="no url"), exact=exact).count() == 0
    assert links.page_links(pages(spark), exact=exact).count() == 0


def test_file_links(spark):
    names = ["/a.txt", "/a.b/c.txt", "/A.TXT", "/plain", "/x.conf?y=.z", "/i.png"]
    html = "".join(f'<a href="{n}">f</a>' for n in names)
    got = {r.link for r in links.file_links(links.page_links(pages(spark, html))).collect()}
    assert got == {"http://h.org/a.txt", "http://h.org/x.conf?y=.z", "http://h.org/i.png"}


@pytest.mark.parametrize("exact", [False, True])
def test_headline_anchors(spark, exact):
    html = '<a href="/n/1">first text</a><a href=" /n//1/ ">last <b>text</b>, wins</a><a href="/s">short</a><a href="rel">relative link</a><a href="https://o/z">outer &amp; far</a>'
    got = {(r.link, r.title, r.abs_url) for r in links.headline_anchors(pages(spark, html), exact).collect()}
    assert got == {("h.org/n/1", "last text, wins", "http://h.org/n/1"), ("https://o/z", "outer & far", "https://o/z")}


def test_clusters(spark):
    near = "".join(f'<a href="/news/2024/story-{i}">A headline, number {i}</a>' for i in range(6))
    far = '<a href="/about">About us, all of it</a>'
    rows = news.news_clusters(pages(spark, near + far)).collect()
    ranks = {}
    for r in rows:
        ranks.setdefault((r.cluster_rank, r.seed_url), set()).add(r.member_url)
    # Seeds 0 and 1 have five and four later neighbours; three are too few; no seed is in its own cluster.
    assert {k: len(v) for k, v in ranks.items()} == {(0, "h.org/news/2024/story-0"): 5, (1, "h.org/news/2024/story-1"): 4}
    assert news.cluster(rows_df := news.news_clusters(pages(spark, near)), 0).count() == 5
    assert news.cluster(rows_df, 7).count() == 0


def test_dom_hazards():
    root = dom.parse('<p>a<p>b</p><script>var x="</p>";</script><ul><li>1<li>2</ul><br>t&copy;<div class="k">z')
    assert [n.text() for n in dom.compile_selector("p")(root)] == ["a", "b"]
    assert [n.text() for n in dom.compile_selector("li")(root)] == ["1", "2"]
    assert dom.compile_selector("div.k")(root)[0].text() == "z"
    assert dom.parse(None).text() == ""


@pytest.mark.parametrize(
    ("css", "want"),
    [
        ("div.a.b > p", ["1"]),
        ("#i p", ["1", "2"]),
        ("p:nth-child(2)", ["2"]),
        ("[data-x]", ["1"]),
        ('[data-x="v"]', ["1"]),
        ("[data-x=w]", []),
        ("span, p", ["1", "2", "s"]),
        ("div div p", ["2"]),
        ("*.c", ["2"]),
    ],
)
def test_selectors(css, want):
    root = dom.parse('<div id="i" class="b a"><p data-x="v">1</p><div><b></b><p class="c">2</p></div></div><span>s</span>')
    assert [n.text() for n in dom.compile_selector(css)(root)] == want


@pytest.mark.parametrize("css", ["", "a:hover", "a + b", "p,,q", "[x^=y]"])
def test_selectors_refused(css):
    with pytest.raises(ValueError):
        dom.compile_selector(css)


def test_css_extract(spark):
    html = '<h1> T </h1><a href=" /x " class="l">q</a><a>w</a><div><b>i</b></div>'
    row = dom.css_extract(pages(spark, html), {"t": "h1", "u": "a | href", "r": "div | raw", "none": "h1 | text"}).first()
    assert (row.t, row.u, row.r, row.none, row.page_id) == (["T"], ["/x", ""], ["<b>i</b>"], [""], 0)


def test_article():
    long = "A paragraph of sufficient length, indeed."
    assert article.read_article(dom.parse(f"<title>a</title><title> b </title><p>{long}<a>gone</a></p><script>x</script>"))[:2] == (long + "\n", "b")
    assert article.read_article(dom.parse("<p>under thirty bytes</p>"))[0] == ""
    block = f'<div class="m">{long}</div>'
    text, _, _ = article.read_article(dom.parse(block + block + "<p>short</p>"))
    assert text == (long + "\n") * 2
    assert article.modal_class(dom.parse('<div class="a"></div><div class="b"></div><div class="b"></div><div class="a"></div>')) == "b"
    assert article.modal_class(dom.parse('<div class="a"></div><div class="b"></div>')) is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("x 2021年3月4日 5:06:07 y", (2021, 3, 4, 5, 6, 7)),
        ("2021-3-4 15:06:7", (2021, 3, 4, 15, 6)),
        ("2021-3-4 15:6", (2021, 3, 4)),
        ("2021/03/04 05:06", (2021, 3, 4, 5, 6)),
        ("04/03/2021 - 05:06", (2021, 3, 4, 5, 6)),
        ("2021-02-30", None),
        ("Thu, 04 Mar 2021", (2021, 3, 4)),
        ("Thursday, 04 Mar 2021", (2021, 3, 4)),
        ("5 Jan 2021", None),
        ("05 January 2021", None),
        ("05 JAN 2021", (2021, 1, 5)),
        ("2021-03-04T05:06:07Z", (2021, 3, 4)),
        ("04.03.2021", (2021, 3, 4)),
        ("1999-1-1 then 2020/1/1", (2020, 1, 1)),
        ("2020-1-1 then 2021-1-1", (2020, 1, 1)),
        ("nothing", None),
        (None, None),
    ],
)
def test_dates(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "r string").select(article.latest_date(F.col("r"))).first()[0]
    assert got == (datetime.datetime(*want) if want else None)


def test_generators(spark):
    rows = lambda df: [tuple(r) for r in df.orderBy("pos").collect()]
    assert rows(generators.int_range(spark, 3, 4)) == [(0, "3"), (1, "4"), (2, "5")]
    assert rows(generators.int_range(spark, 3, 4, overrun=False)) == [(0, "3"), (1, "4")]
    assert rows(generators.int_range(spark, 9, 4)) == [(0, "9")]
    got = generators.enumerate_urls("u/{a}/{b}/{c}", {"a": generators.listed(spark, ["x", "y", "z"]), "b": generators.int_range(spark, 1, 1)})
    assert rows(got) == [(0, "u/x/1/{c}"), (1, "u/y/2/{c}")]
    with pytest.raises(ValueError):
        generators.lock_step({})


def test_extract_job(spark, tmp_path):
    job = config.read_config(config.SAMPLE)
    assert (job.domain, job.start_id, job.end_id, job.names) == ("https://example.org/item/{id}", 1, 100, ["title", "image"])
    assert config.read_config("startId: x\nproxy: p\n") == config.ExtractJob()
    assert '"start_id": 1' in job.to_json()
    stored = spark.createDataFrame([(1, "https://example.org/item/7", '<h1 class="title">T</h1>'), (2, "https://example.org/item/8", "<p></p>")], PAGES)
    assert [tuple(r) for r in generators.extract(spark, job, stored, generators.listed(spark, ["7", "8", "9"])).collect()] == [("T", "")]
    (tmp_path / "ids").write_text("8\n 7 \n9\n")
    job.id_file, job.output = str(tmp_path / "ids"), str(tmp_path / "out")
    generators.run_job(spark, job, stored)
    assert [tuple(r) for r in spark.read.csv(job.output).collect()] == [("T", None)]
    wanted = generators.looked_up(generators.enumerate_urls(job.domain, {"id": generators.listed(spark, ["7", "9"])}), stored.select("url", "page_id"))
    assert {(r.url[-1], r.page_id) for r in wanted.collect()} == {("7", 1), ("9", None)}


def test_sitemap(spark):
    xml = lambda *locs: "<urlset xmlns='x'>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    maps = spark.createDataFrame([("r.xml", xml("a.xml", "b.xml", "p0")), ("a.xml", xml("r.xml", "p1", "p2")), ("b.xml", xml("c.xml", "p1")), ("c.xml", xml("p3&amp;q"))], "url string, xml string")
    roots = spark.createDataFrame([("r.xml",)], "url string")
    got = lambda **k: {tuple(r) for r in sitemap.traverse(maps, roots, **k).collect()}
    assert got() == {("p0", 0), ("p1", 1), ("p2", 1), ("p3&q", 2)}
    assert got(done=spark.createDataFrame([("a.xml",)], "url string")) == {("p0", 0), ("p1", 1), ("p3&q", 2)}
    assert got(flags=["+xml", "-b"]) == {("p0", 0), ("p1", 1), ("p2", 1)}
    assert got(max_depth=1) == {("p0", 0)}
    assert got(max_depth=0) == set()
    assert got(admit=lambda u: u != "b.xml") == {("p0", 0), ("p1", 1), ("p2", 1)}


def test_long_chain_of_sitemaps(spark):
    maps = spark.createDataFrame([(f"{i}.xml", f"<loc>{i + 1}.xml</loc><loc>p{i}</loc>") for i in range(60)], "url string, xml string").coalesce(1)
    got = sitemap.traverse(maps, spark.createDataFrame([("0.xml",)], "url string"))
    assert {tuple(r) for r in got.collect()} == {(f"p{i}", i) for i in range(60)}


def test_incremental(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h/{i}") for i in range(10)], "id long, url string")
    assert incremental.not_done(rows, None).count() == 10
    assert readers.done_set(spark, str(tmp_path / "missing")).count() == 0
    sinks.save_done(rows.where("id < 4"), str(tmp_path / "done"))
    assert incremental.not_done(rows, readers.done_set(spark, str(tmp_path / "done"))).count() == 6
    got = {r.id: r.batch for r in incremental.batches(rows, 3, "id").collect()}
    assert got == {i: i // 3 for i in range(10)}
    assert incremental.batches(rows.where("id < 0"), 3, "id").count() == 0
    lines = spark.createDataFrame([(" http://a.xml ",), ("ftp://x",), ("http://b",)], "value string")
    assert readers.done_urls(lines, maps_only=True).count() == 1
    urls = spark.createDataFrame([(" h.org ",), ("https://s",), ("",)], "v string").select(readers.as_url(F.col("v"))).collect()
    assert [u[0] for u in urls] == ["http://h.org", "https://s", "http://"]


def test_raw_response(spark):
    raw = [(b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\nx-a: 2\r\n\r\nbody\r\n\r\nmore",), (b"junk",), (None,)]
    got = readers.raw_responses(spark.createDataFrame(raw, "raw binary")).collect()
    assert (got[0].status, got[0].headers, got[0].body) == (404, {"X-A": ["1", "2"]}, b"body\r\n\r\nmore")
    binary = readers.raw_responses(spark.createDataFrame([(b"HTTP/1.1 200 OK\r\n\r\n\xff\x00\xfe",)], "raw binary")).first()
    assert bytes(binary.body) == b"\xff\x00\xfe"
    assert got[1].status is None and got[1].body is None and got[2].status is None


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t" * 40, "T", None, "", "u"), ("", "none", None, "", "v")], "text string, title string, date timestamp, author string, link string")
    sinks.write_articles(rows, str(tmp_path / "a"))
    sinks.write_articles(rows, str(tmp_path / "a"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert len(lines) == 2 and '"date":null' in lines[0]


def listed(name: str, *more: str) -> str:
    """Five similar links, so that the page has a cluster, and others."""
    return "".join(f'<a href="/{name}/2024/story-{i}">Headline number {i} of {name}, in full</a>' for i in range(5)) + "".join(more)


def test_monitor_gate(spark):
    """Only pages with a cluster of news links are told of; on these every headline is."""
    with_cluster, without = listed("one", '<a href="/n9">Another headline, far away</a>'), '<a href="/n1">A first headline, one</a>'
    got = {r.title for r in incremental.new_titles(pages(spark, with_cluster, without)).collect()}
    assert got == {f"Headline number {i} of one, in full" for i in range(5)} | {"Another headline, far away"}


def test_stream_equals_batch(spark, tmp_path):
    html = [listed("one"), listed("one", '<a href="/n3">Another headline, two</a>'), '<a href="/n4">Alone, and not told of</a>', listed("two", '<a href="/n5">Another headline, two</a>')]
    all_pages = pages(spark, *html)
    folder = str(tmp_path / "in")
    for i in range(len(html)):
        all_pages.where(f"page_id = {i}").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = monitor.page_stream(spark, folder, all_pages.schema, files=1)
        monitor.watch(stream, str(tmp_path / "seen"), str(tmp_path / "ck"), str(tmp_path / "alerts")).awaitTermination()
        return sorted(r.title for r in spark.read.parquet(str(tmp_path / "seen")).collect())

    want = sorted(r.title for r in incremental.new_titles(all_pages).collect())
    assert run() == want and len(want) == 11
    assert run() == want  # nothing new
    assert "".join(r.body for r in spark.read.parquet(str(tmp_path / "alerts")).collect()).count("\n") == 11


def test_supervisor_restarts(spark, tmp_path):
    """A stream that stands still is stopped and started again; one that keeps failing raises its failure."""
    pages(spark, "a", "b").write.parquet(str(tmp_path / "in"))
    starts = []

    def start():
        starts.append(1)
        stream = monitor.page_stream(spark, str(tmp_path / "in"), pages(spark).schema)

        def step(batch, epoch):
            if len(starts) == 1:
                time.sleep(60)
            batch.write.mode("append").parquet(str(tmp_path / "out"))

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    told = []
    supervisor.supervise(start, stall=2.0, restarts=1, report=told.append, every=0.5)
    assert len(starts) == 2 and spark.read.parquet(str(tmp_path / "out")).count() == 2 and told

    def broken():
        stream = monitor.page_stream(spark, str(tmp_path / "in"), pages(spark).schema)
        return stream.writeStream.foreachBatch(lambda batch, epoch: 1 / 0).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        supervisor.supervise(broken, restarts=1, every=0.5)


def test_deep_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    root = dom.parse(deep + "<p>a<b>&lt;</b><br></p>")
    assert dom.compile_selector("div")(root)[0].inner_html().count("<div>") == 2999
    assert dom.compile_selector("p")(root)[0].inner_html() == "a<b>&lt;</b><br/>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<!-- <a href="/c">c</a> --><a href="/x">X</a>', [("/x", "X")]),
        ("<a href=/unq>U</a>", [("/unq", "U")]),
        ('<a href="/q?a=1&#38;b=2">&#65;&#x42; &eacute;</a>', [("/q?a=1&b=2", "AB é")]),
        ('<script>"<a href=/s>s</a>"</script><A HREF = \'/y\' class=k>Y</A>', [("/y", "Y")]),
        ('<a title="1 > 0" href="/t">T</a>', [("/t", "T")]),
        ('<a href="/1">one<a href="/2">two</a>', [("/1", "one"), ("/2", "two")]),
        ('<a title="href=no">none</a><abbr href="/no">n</abbr>', []),
        ('<div><a href="/open">open</div>rest', [("/open", "open")]),
        ("", []),
    ],
)
def test_anchors_alike_in_both_paths(spark, html, want):
    for exact in (False, True):
        got = links.anchors(pages(spark, html, None), exact).orderBy("page_id", "pos").collect()
        assert [(r.href, r.text) for r in got] == want


def test_references_in_queries(spark):
    """Names before an equals sign are parameters."""
    got = links.anchors(pages(spark, '<a href="/?copy=1&copy=2&copy;">c &copy c</a>')).first()
    assert (got.href, got.text) == ("/?copy=1&copy=2©", "c © c")


def test_titles_joined(spark):
    rows = pages(spark, "<!--<title>no</title>--><title>a &amp; b</title><svg><title x=1>c</title></svg>", "none", None)
    native = rows.select("page_id", text.title(F.col("html")).alias("t")).orderBy("page_id").collect()
    assert [r.t for r in native] == ["a & bc", "", None]
    assert [r.title for r in dom.titles(rows).orderBy("page_id").collect()] == ["a & bc", "", ""]


def test_unescape(spark):
    raw = ["&#x1F600;&#8364;&#150;", "&amp;lt;", "&unknown; & &;", "&#0;&#xD800;", "&hearts;&hearts", "", None]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(text.unescape(F.col("r"))).collect()
    assert [g[0] for g in got] == ["😀€–", "&lt;", "&unknown; & &;", "\ufffd\ufffd", "♥&hearts", "", None]


def test_pages_chain(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p><p>b</p>", None), (2, "u", None, None), (3, "u", "<p>c</p>", "timed out")], "page_id long, url string, html string, err string")
    chain = Pages.of(rows).select("p").select("b")
    assert [r.text for r in chain.selected.orderBy("pos").collect()] == ["a", "b"]
    assert {(r.page_id, r.err) for r in chain.errors.collect()} == {(2, "no document"), (3, "timed out")}
    assert [r.value for r in chain.each("p", lambda i, n: n.text() if i else None).collect()] == ["b"]


def test_link_pairs_native_distance(spark):
    odd = ["", "a", "http://h.org/a/b", "http://h.org/a/b/", "http://h.org/á/b?x=1", "http://h.org/à/b?x=12", "//", "x.y", "http://h.org//a", "😀/a", "😁/a"]
    rows = spark.createDataFrame([(g, u) for g in (1, 2, None) for u in [*odd, *(f"http://h.org/{g}/{i * i}?p={i % 3}" for i in range(30)), odd[2], None]] + [(3, "alone")], "g int, link string")
    want = rows.where("g IS NOT NULL AND link IS NOT NULL").distinct()
    want = want.alias("a").join(want.alias("b"), "g").where("a.link < b.link").select("g", F.col("a.link").alias("seed"), F.col("b.link").alias("member"), urls.distance(F.col("a.link"), F.col("b.link")).alias("distance"))
    for block in (7, 512):
        assert sorted(news.cells(rows, "g", block).collect()) == sorted(want.collect())
    assert news.link_pairs(rows.limit(0), "g").count() == 0


def test_link_pairs_large_group(spark):
    """The pairs of one host come from several tasks, also where the links are not broadcast."""
    rows = spark.createDataFrame([("h", f"http://h/{i}") for i in range(700)], "host string, link string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = news.link_pairs(rows, "host").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum(r["count"] for r in got) == 700 * 699 // 2
    assert len(got) > 1
