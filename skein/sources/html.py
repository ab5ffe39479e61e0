"""A small DOM over the standard library's HTML parser, and the parsers on it.

The tree repairs what listings need: void elements, implied closing of list
items, rows and cells, and unclosed inline tags; script and style text is kept
apart.  Everything here runs inside Arrow functions.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without content; those that break lines; those a new one of which closes.  Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "p", "br", "hr", "div", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "ul", "ol", "li", "dl", "dt", "dd",
    "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "header", "footer", "nav",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "td", "li", "article", "section", "body"}}
SILENT = {"script", "style"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self, gap: str = "", blocks: bool = False, skip: Callable[[Node], bool] = lambda n: False) -> str:
        """The text of all descendants but scripts and styles; ``blocks`` puts line ends around block elements."""
        out: list[str] = []
        todo: list[Node | str | None] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is not None and n.tag not in SILENT and not (n is not self and skip(n)):
                edge = blocks and n.tag in BLOCK
                if edge:
                    out.append("\n")
                    todo.append("\n")
                todo.extend(reversed(n.children))
        return gap.join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag)
        if closes:
            n = self.at
            while n is not self.root and n.tag not in SCOPE[tag]:
                if n.tag in closes:
                    self.at = n.parent
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str | None) -> Node:
    b = _Builder()
    b.feed(text or "")
    b.close()
    return b.root


def _fits(node: Node, simple: str) -> bool:
    """A simple selector: tag, .class and #id, one after another."""
    tag, *rest = re.split(r"(?=[.#])", simple)
    marks = all(x[1:] in node.classes if x[0] == "." else node.attrs.get("id") == x[1:] for x in rest)
    return marks and (not tag or node.tag == tag)


def select(root: Node, selector: str) -> list[Node]:
    """Elements in document order by simple selectors parted by spaces: each within the one before."""
    *outer, last = selector.split()
    out = []
    for node in root.walk():
        if node is root or not _fits(node, last):
            continue
        left = list(outer)
        for a in node.ancestors():
            if left and _fits(a, left[-1]):
                left.pop()
        if not left:
            out.append(node)
    return out


def first_of(root: Node, selectors: tuple[str, ...]) -> Node | None:
    """The first element of the first selector that has any."""
    return next((found[0] for s in selectors if (found := select(root, s))), None)


def form_with(page: str | None, field_name: str) -> str:
    """The id of the first form that has an input of this name; empty without one."""
    for form in parse(page).find_all("form"):
        if any(n.attrs.get("name") == field_name for n in form.find_all("input")):
            return form.attrs.get("id", "")
    return ""


def longest_text(page: str | None, tags: tuple[str, ...] = ("pre", "td", "div", "p"), least: int = 20) -> str:
    """The longest text of a container of at least so many characters."""
    texts = [clean(n.text()) for n in parse(page).find_all(*tags)]
    return max((t for t in texts if len(t) >= least), key=len, default="")


def clean(s: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", s or "")).strip()


def file_name(a: Node, url: str, default: str) -> str:
    names = [n for n in a.find_all("span") if "name" in n.classes]
    name = clean((names[0].text() if names else "") or a.attrs.get("title", ""))
    if name:
        return name
    query = parse_qs(urlparse(url).query)
    if query.get("file"):
        return unquote(query["file"][0]).rsplit("/", 1)[-1]
    return unquote(url.rsplit("/", 1)[-1]) or default


def title_of(a: Node) -> str:
    """The title attribute, else the text outside spans."""
    return clean(a.attrs.get("title", "")) or clean(a.text(skip=lambda n: n.tag == "span"))


def usable(href: str | None) -> bool:
    return bool(href and href.strip()) and not href.strip().lower().startswith("javascript")


def links(page: str | None, base: str, holder: str = "subject") -> list[dict]:
    """Title links of a list: anchors within the holder class, else all of them;
    fragments and scripts are passed over, the first of a URL counts."""
    root = parse(page)
    anchors = [a for a in root.find_all("a") if "href" in a.attrs]
    held = [a for a in anchors if any(holder in n.classes for n in a.ancestors())]
    out, seen = [], set()
    for a in held or anchors:
        href = a.attrs["href"].strip()
        title = title_of(a)
        if not usable(href) or href.startswith("#") or len(title) < 2:
            continue
        url = urljoin(base, href)
        if url not in seen:
            seen.add(url)
            out.append({"pos": len(out), "title": title, "url": url})
    return out


def table_rows(page: str | None, base: str, hints: tuple[str, ...] = ("filedown", "getfile", "/file")) -> list[dict]:
    """Rows of body tables with a usable link: that of the title cell, else the
    first; the title is the link's, else the first cell that is neither a number
    nor a date and doesn't hold the link; other file links are attachments."""
    out = []
    for row in parse(page).find_all("tr"):
        if not any(n.tag == "tbody" for n in row.ancestors()):
            continue
        anchors = [a for a in row.find_all("a") if usable(a.attrs.get("href"))]
        if not anchors:
            continue
        own = [a for a in anchors if any(n.tag == "td" and {"title", "subject"} & set(n.classes) for n in a.ancestors())]
        main = (own or anchors)[0]
        if own:
            title = clean(main.attrs.get("title") or main.text())
        else:
            cells = [c for c in row.children if isinstance(c, Node) and c.tag == "td" and not any(n is main for n in c.walk())]
            texts = [clean(c.text()) for c in cells]
            fit = [t for t in texts if t and not t.isdigit() and not re.match(r"\s*20\d{2}[.\-/]?\d{1,2}[.\-/]?\d{1,2}", t)]
            title = fit[0] if fit else clean(main.text())
        url = urljoin(base, main.attrs["href"])
        files, met = [], set()
        for a in anchors:
            if a.attrs["href"] != main.attrs["href"] and any(h in a.attrs["href"].lower() for h in hints):
                to = urljoin(base, a.attrs["href"])
                if to not in met:
                    met.add(to)
                    files.append(f"{file_name(a, to, 'attachment')}={to}")
        if title:
            out.append({"pos": len(out), "title": title, "url": url, "text": clean(row.text(" ")), "files": ";".join(files)})
    return out


def label_values(page: str | None) -> dict[str, str]:
    """Label and value pairs: th and td of one row by place, and dt with the dd right after it.  A label's first value counts."""
    out: dict[str, str] = {}
    root = parse(page)
    for row in root.find_all("tr"):
        cells = [c for c in row.children if isinstance(c, Node)]
        for k, v in zip([c for c in cells if c.tag == "th"], [c for c in cells if c.tag == "td"], strict=False):
            out.setdefault(re.sub(r"\s+", "", k.text()), clean(v.text()))
    for dl in root.find_all("dl"):
        kids = [c for c in dl.children if isinstance(c, Node)]
        for k, v in zip(kids, kids[1:], strict=False):
            if k.tag == "dt" and v.tag == "dd":
                out.setdefault(re.sub(r"\s+", "", k.text()), clean(v.text()))
    return out


def hidden_inputs(page: str | None) -> dict[str, str]:
    """Hidden inputs by name; of a repeated name the last value counts."""
    return {n.attrs["name"]: n.attrs.get("value", "") for n in parse(page).find_all("input") if n.attrs.get("type", "").lower() == "hidden" and n.attrs.get("name")}


def summary_request(page: str | None, key: str, needed: tuple[str, ...] = ("billId",)) -> dict:
    """What a follow-up request would hold, or why it can't be made."""
    root = parse(page)
    data = hidden_inputs(page)
    token = [n.attrs.get("content", "") for n in root.find_all("meta") if n.attrs.get("name") == "_csrf"]
    missing = [n for n in needed if not data.get(n)]
    if missing:
        return {"ok": False, "reason": f"missing {','.join(missing)}", "keys": ""}
    if data[needed[0]] != key:
        return {"ok": False, "reason": "identity mismatch", "keys": ""}
    if not token or not token[0]:
        return {"ok": False, "reason": "missing token", "keys": ""}
    return {"ok": True, "reason": "", "keys": ",".join(sorted(data))}


def strip_tags(text: str | None) -> str:
    """The text of markup, with line ends at blocks; text that isn't markup stays as it is."""
    from ..operators.excerpt import looks_like_markup

    return parse(text).text(blocks=True) if text and looks_like_markup(text) else text or ""


def redact_page(page: str | None, hints: tuple[str, ...], mark: str = "REDACTED") -> str:
    """HTML without the values of secret-named inputs and metas and without script bodies."""

    def start(m: re.Match) -> str:
        tag = m.group(0)
        name = re.search(r"""\bname\s*=\s*["']?([^"'\s>]+)""", tag, re.I)
        if name and any(h in name.group(1).lower() for h in hints):
            tag = re.sub(r"""\b(value|content)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", rf'\1="{mark}"', tag, flags=re.I)
        return tag

    out = re.sub(r"(<script\b[^>]*>).*?(</script\s*>)", rf"\1{mark}\2", page or "", flags=re.I | re.S)
    return re.sub(r"<(?:input|meta)\b[^>]*>", start, out, flags=re.I)


def decode(data: bytes | None, declared: str | None) -> str:
    """Bytes as text: the declared charset unless it is missing or Latin-1, else UTF-8, else EUC-KR, else with replacement."""
    data = data or b""
    tries = [declared] if declared and declared.lower() not in ("iso-8859-1", "latin-1", "latin1") else []
    for name in [*tries, "utf-8", "euc-kr"]:
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def unescape_closed(text: str) -> str:
    """Only entities that end with a semicolon are decoded."""
    before, *parts = text.split("&")
    out = [before]
    for part in parts:
        name, closed, rest = part.partition(";")
        entity = closed and len(name) <= 32 and name.isascii() and name.removeprefix("#").isalnum()
        out.append(_html.unescape(f"&{name};") + rest if entity else "&" + part)
    return "".join(out)


ParserFn = Callable[[str | None, str], list[dict]]
#: Parsers by the type that a source's configuration names.
PARSERS: dict[str, ParserFn] = {"links": links, "table": table_rows}


def parser(kind: str) -> ParserFn:
    if kind not in PARSERS:
        raise ValueError(f"unknown source type: {kind}")
    return PARSERS[kind]


def explode_rows(df: DataFrame, html_col: str, base_col: str, kind: str, *keep: str) -> DataFrame:
    """``keep`` columns with (pos, title, url): a row for each item a parser finds on a page."""
    run = parser(kind)

    @F.pandas_udf("array<struct<pos:int,title:string,url:string>>")
    def items(page: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([[{k: r[k] for k in ("pos", "title", "url")} for r in run(p, b or "")] for p, b in zip(page, base, strict=True)])

    return df.select(*keep, F.explode(items(html_col, base_col)).alias("_i")).select(*keep, "_i.pos", "_i.title", "_i.url")


def text_of(c: Column | str) -> Column:
    """Visible text of an HTML column, cleaned, by an Arrow function."""

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return page.map(lambda p: clean(parse(p).text(blocks=True)))

    return run(c)
