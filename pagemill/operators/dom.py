"""HTML trees and CSS selectors.

Spark has no HTML parser, so pages are parsed in Arrow batches with the standard library's tokenizer and a small tree
builder: void elements, raw text in script and style, text-only titles, implied ends of a, p, li, dt, dd, option, tr and
td, unknown end tags ignored, everything closed at the end.  Selectors are compiled when the query is planned, and its
output schema is fixed then.  Filter pages before these operators: Catalyst can't push predicates into them.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements without content, and those whose start ends an open one of the same set.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
IMPLIED = [{"li"}, {"dt", "dd"}, {"option"}, {"tr"}, {"td", "th"}]
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPES = {"ul", "ol", "dl", "table", "select", "td", "th", "div", "body", "html"}


class Node:
    __slots__ = ("attrs", "children", "depth", "elements_within", "nth", "parent", "pos", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, pos: int):
        self.tag, self.attrs, self.parent, self.pos = tag, attrs, parent, pos
        self.children: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.elements_within, self.nth = 0, 0  # child elements so far, and this one's place among its parent's
        if parent is not None:
            parent.elements_within += 1
            self.nth = parent.elements_within

    def elements(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node is self or node.tag not in skip:
                stack += reversed(node.children)
        return "".join(out)

    def inner_html(self) -> str:
        out: list[str] = []
        stack: list[tuple[Node | str, str | None]] = [(c, self.tag) for c in reversed(self.children)]  # with what is around; None for an end tag
        while stack:
            c, around = stack.pop()
            if isinstance(c, str):
                out.append(c if around in (None, "script", "style") else html_lib.escape(c, quote=False))
                continue
            attrs = "".join(f' {k}="{html_lib.escape(v)}"' for k, v in c.attrs.items())
            out.append(f"<{c.tag}{attrs}/>" if c.tag in VOID else f"<{c.tag}{attrs}>")
            if c.tag not in VOID:
                stack.append((f"</{c.tag}>", None))
                stack += [(x, c.tag) for x in reversed(c.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self, mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.mark = mark  # stands for ampersands that begin no reference
        self.root = Node("#document", {}, None, 0)
        self.open, self.count = [self.root], 1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end("p", {"td", "th", "table", "body", "html", "button"})
        if tag == "a":  # anchors do not nest
            self._end("a", SCOPES)
        for group in IMPLIED:
            if tag in group:
                for other in group:
                    self._end(other, SCOPES - group)
        if self.mark:
            tag, attrs = tag.replace(self.mark, "&"), [(k.replace(self.mark, "&"), v and v.replace(self.mark, "&")) for k, v in attrs]
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1], self.count)  # the first of equal names counts
        self.count += 1
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _end(self, tag: str, stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_endtag(self, tag):
        self._end(tag.replace(self.mark, "&") if self.mark else tag, set())

    def handle_data(self, data):
        self.open[-1].children.append(data.replace(self.mark, "&") if self.mark else data)


_AMPERSAND = re.compile(r"&(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]*;)?")


def parse(source: str | None, closed: bool = False) -> Node:
    """closed: only references that end with a semicolon are decoded; others, which HTML knows too, stay as written."""
    source, mark = source or "", ""
    if closed and "&" in source:
        mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in source)
        source = _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + m[0][1:], source)
    builder = _Builder(mark)
    builder.feed(source)
    builder.close()
    return builder.root


# -- selectors ----------------------------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:=(?P<q>[\"']?)(?P<val>[^\]]*?)(?P=q))?\]|:nth-child\((?P<nth>\d+)\)|(?P<comb>\s*>\s*|\s+)")


def compile_selector(css: str) -> Callable[[Node], list[Node]]:
    """Tags, #id, .class, [attr], [attr="v"], :nth-child(n), descendants, > and comma lists; ValueError for anything else."""
    alternatives = []
    for part in css.split(","):
        steps, tests, at, part = [], [], 0, part.strip()
        if not part:
            raise ValueError(f"empty selector in {css!r}")
        while at < len(part):
            m = _SIMPLE.match(part, at)
            if not m:
                raise ValueError(f"cannot read selector {css!r} at {part[at:]!r}")
            at = m.end()
            if m["comb"]:
                steps.append((tests, m["comb"].strip()))
                tests = []
            else:
                tests.append({k: m[k] for k in ("tag", "id", "cls", "attr", "val", "nth") if m[k] is not None})
        alternatives.append([*steps, (tests, "")])

    def fits(node: Node, tests: list[dict]) -> bool:
        for t in tests:
            if "tag" in t and t["tag"] not in ("*", node.tag) and t["tag"].lower() != node.tag:
                return False
            if "id" in t and node.attrs.get("id") != t["id"]:
                return False
            if "cls" in t and t["cls"] not in node.attrs.get("class", "").split():
                return False
            if "attr" in t and (t["attr"].lower() not in node.attrs or "val" in t and node.attrs[t["attr"].lower()] != t["val"]):
                return False
            if "nth" in t:
                if node.nth != int(t["nth"]):
                    return False
        return True

    def matches(node: Node, steps: list, k: int) -> bool:
        if node.tag == "#document" or not fits(node, steps[k][0]):
            return False
        if k == 0:
            return True
        above = node.parent
        if steps[k - 1][1] == ">":
            return above is not None and matches(above, steps, k - 1)
        while above is not None:
            if matches(above, steps, k - 1):
                return True
            above = above.parent
        return False

    return lambda root: [n for n in root.elements() if any(matches(n, a, len(a) - 1) for a in alternatives)]


_TRIM = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: str) -> str:
    """As trim_ws."""
    return text.strip(_TRIM)


def compile_extract(spec: dict[str, str]) -> dict[str, tuple[Callable, str]]:
    """`css` gives trimmed texts, `css | raw` inner HTML, `css | name` that attribute."""
    out = {}
    for name, rule in spec.items():
        css, _, op = rule.partition("|")
        out[name] = (compile_selector(css.strip()), op.strip())
    return out


def css_extract(pages: DataFrame, spec: dict[str, str], html: str = "html", closed: bool = False) -> DataFrame:
    """The other columns of pages, and an array<string> per name of the spec; closed as in parse."""
    compiled = compile_extract(spec)
    keep = [c for c in pages.columns if c != html and c not in spec]

    def values(root: Node, find: Callable, op: str) -> list[str]:
        return [strip(n.text() if not op else n.inner_html() if op == "raw" else n.attrs.get(op, "")) for n in find(root)]

    def run(batches):
        for batch in batches:
            found = [[values(root, *compiled[name]) for name in spec] for root in (parse(x, closed) for x in batch.column(html).to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in keep), *(pa.array([f[k] for f in found], pa.list_(pa.string())) for k in range(len(spec)))], [*keep, *spec])

    schema = T.StructType([*(pages.schema[c] for c in keep), *(T.StructField(n, T.ArrayType(T.StringType())) for n in spec)])
    return pages.select(*keep, html).mapInArrow(run, schema)


def select(pages: DataFrame, css: str, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), inner: bool = False) -> DataFrame:
    """One row per matching node, in document order: key, the columns to keep, idx, pos, parent_pos, depth, tag, attrs, text.

    inner: also inner_html.
    """
    find = compile_selector(css)
    kinds = [("idx", "int", pa.int32()), ("pos", "int", pa.int32()), ("parent_pos", "int", pa.int32()), ("depth", "int", pa.int32()), ("tag", "string", pa.string()), ("attrs", "map<string,string>", pa.map_(pa.string(), pa.string())), ("text", "string", pa.string())]
    kinds += [("inner_html", "string", pa.string())] if inner else []

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for page, raw in enumerate(batch.column(html).to_pylist()):
                for i, n in enumerate(find(parse(raw))):
                    rows.append((i, n.pos, n.parent.pos, n.depth, n.tag, list(n.attrs.items()), n.text(), n.inner_html() if inner else None))
                    at.append(page)
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in (key, *keep)]
            yield pa.record_batch([*own, *(pa.array([r[c] for r in rows], k[2]) for c, k in enumerate(kinds))], [key, *keep, *(k[0] for k in kinds)])

    schema = T.StructType([*(pages.schema[c] for c in (key, *keep)), *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t, _ in kinds)).fields])
    return pages.select(key, *keep, html).mapInArrow(run, schema)


def each(pages: DataFrame, css: str, do: Callable[[int, Node], str | None], key: str = "page_id", html: str = "html") -> DataFrame:
    """What do(idx, node) says of every matching node: key, idx, value; nodes of which it says None give no row."""
    find = compile_selector(css)

    def run(batches):
        for batch in batches:
            rows = [(k, i, said) for k, raw in zip(batch.column(key).to_pylist(), batch.column(html).to_pylist(), strict=True) for i, n in enumerate(find(parse(raw))) if (said := do(i, n)) is not None]
            yield pa.record_batch([pa.array([r[0] for r in rows], batch.column(key).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [key, "idx", "value"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, idx int, value string")


def titles(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """key and the untrimmed text of all title elements, joined; closed as in parse."""
    find = compile_selector("title")

    def run(batches):
        for batch in batches:
            found = ["".join(n.text() for n in find(parse(x, closed))) for x in batch.column(html).to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array(found, pa.string())], [key, "title"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string")
