"""Articles: the main text of a page, its title, and the latest date found in it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import dom

#: What a date looks like, and how it is read.  Only a pattern's first match counts.
DATES = [
    (r"[1-2]\d{3}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}:\d{1,2}", "yyyy年M月d日 H:mm:ss"),
    (r"[1-2]\d{3}年[0-1]\d月[0-3]\d日 [0-2]\d:[0-5]\d:\d{2}", "yyyy年M月d日 H:mm:ss"),
    (r"[1-2]\d{3}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d H:mm:ss"),
    (r"[1-2]\d{3}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "yyyy/M/d H:mm:ss"),
    (r"[1-2]\d{3}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}", "yyyy/M/d H:mm"),
    (r"\d{2}/\d{2}/[1-2]\d{3} - \d{2}:\d{2}", "dd/MM/yyyy - HH:mm"),
    (r"[1-2]\d{3}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}", "yyyy年M月d日 H:mm"),
    (r"[1-2]\d{3}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}", "yyyy-M-d H:mm"),
    (r"[1-2]\d{3}年\d{1,2}月\d{1,2}日", "yyyy年M月d日"),
    (r"[1-2]\d{3}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"[1-2]\d{3}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\w{1,15}, \d{1,2} \w{1,15} [1-2]\d{3}", "EEE, dd MMM yyyy"),
    (r"\d{1,2} \w{1,15} [1-2]\d{3}", "dd MMM yyyy"),
    (r"\d{2}\.[0-1]\d\.[1-2]\d{3}", "dd.MM.yyyy"),
]
WEEKDAY = r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), "


def latest_date(text: Column) -> Column:
    """The latest readable date of the text, null if it has none."""
    found = []
    for pattern, layout in DATES:
        first = F.regexp_extract(text, pattern, 0)
        if layout.startswith("EEE"):  # weekdays are not read, only checked
            first = F.when(F.rlike(first, F.lit(WEEKDAY)), F.regexp_replace(first, WEEKDAY, ""))
            layout = layout[5:]
        found.append(F.try_to_timestamp(F.nullif(first, F.lit("")), F.lit(layout)))
    return F.greatest(*found)


GONE = frozenset({"script", "head", "a"})


def _kept(root: dom.Node) -> Iterator[dom.Node]:
    """Elements that stay when scripts, heads and anchors are taken out."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag not in GONE:
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, dom.Node)]


def modal_class(root: dom.Node) -> str | None:
    """The class text most often on divs, at least twice; of equals, the first to get there."""
    seen: dict[str, int] = {}
    best, most = None, 0
    for node in _kept(root):
        if node.tag == "div" and "class" in node.attrs:
            name = node.attrs["class"]
            seen[name] = seen.get(name, 0) + 1
            if seen[name] >= 2 and seen[name] > most:
                best, most = name, seen[name]
    return best


def read_article(root: dom.Node) -> tuple[str, str, str]:
    """(text, title, raw): raw is all text that stays."""
    title = ""
    for node in root.elements():
        if node.tag == "title":
            title = dom.strip(node.text())
    nodes = list(_kept(root))
    paragraphs = "".join(dom.strip(n.text(GONE)) + "\n" for n in nodes if n.tag == "p")
    name = dom.strip(modal_class(root) or "")
    blocks = "".join(dom.strip(n.text(GONE)) + "\n" for n in nodes if n.tag == "div" and n.attrs.get("class") == name)
    text = blocks if len(blocks.encode()) > len(paragraphs.encode()) else paragraphs
    return ("" if len(dom.strip(text).encode()) < 30 else text), title, root.text(GONE)


def articles(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, url, html) to page_id, text, title, date, author, link; a text under 30 bytes is none, and has no date.

    closed: as in dom.parse.
    """

    def run(batches):
        for batch in batches:
            found = [read_article(dom.parse(h, closed)) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), *(pa.array([f[k] for f in found], pa.string()) for k in range(3)), batch.column("url")], ["page_id", "text", "title", "raw", "link"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "html", "url").mapInArrow(run, f"page_id {kind}, text string, title string, raw string, link string")
    return rows.select("page_id", "text", "title", F.when(F.col("text") != "", latest_date(F.col("raw"))).alias("date"), F.lit("").alias("author"), "link")


def modal_classes(nodes: DataFrame) -> DataFrame:
    """The same choice on rows (page_id, pos, class) of divs, in DataFrame functions: page_id, class."""
    per = nodes.groupBy("page_id", "class").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("reached")).where("n >= 2")
    return per.groupBy("page_id").agg(F.min_by("class", F.struct(-F.col("n"), F.col("reached"))).alias("class"))
