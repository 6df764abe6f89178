"""Documents out of HTML, with the standard library's parser: encyclopedia pages and articles of publications."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .urls import canonical_url

#: What isn't text of an encyclopedia page, by tag, by class, and by heading of its section (fixed values).
WIKI_TAGS, WIKI_CLASSES = {"script", "style", "nav", "figure", "table"}, {"mw-ref", "references"}
WIKI_SECTIONS = {"references", "notes", "citations", "bibliography", "external links", "further reading", "see also"}
ARTICLE_TAGS = {"script", "style", "nav", "aside", "form", "figure"}
#: Elements without content, and those that end an open paragraph (fixed values of HTML).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_NESTING = {"li": {"ul", "ol", "menu"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}, "dt": {"dl"}, "dd": {"dl"}}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def first(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)

    def text(self) -> str:
        """All text below, each run of it set off by a space, white space collapsed."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack += reversed(node.children)
        return " ".join(" ".join(parts).split())

    def remove(self, unwanted: Callable[[Element], bool]) -> None:
        stack = [self]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]
            stack += [c for c in node.children if isinstance(c, Element)]

    def inside(self, tag: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.at = self.root

    def _close(self, node: Element) -> None:
        self.at = node.parent or self.root

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            node = self.at
            while node.parent is not None and node.tag not in {"p", "li", "td", "th", "div", "section", "article", "body"}:
                node = node.parent
            if node.tag == "p":
                self._close(node)
        if tag in SELF_NESTING:
            node = self.at
            while node.parent is not None and node.tag != tag and node.tag not in SELF_NESTING[tag]:
                node = node.parent
            if node.tag == tag:
                self._close(node)
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self._close(node)

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _body(root: Element) -> Element | None:
    """The body element; for markup without one but with visible text, everything but the head."""
    found = root.first("body")
    if found is not None:
        return found
    has = root.first("p", "div", "article", "main", "section", "h1", "h2", "h3", "ul", "ol", "li", "span", "a")
    return root if has is not None else None


def encyclopedia_text(html: str | None, least: int = 100) -> tuple[str | None, str | None]:
    """(content, error) of an encyclopedia page: its headings of levels 2 and 3, paragraphs and list entries, set off by blank lines.

    Gone are scripts, tables, figures, reference marks and end-matter sections. Errors: missing_article_body,
    empty_article_content, content_too_short (under ``least`` visible characters). A null page has no body.
    """
    body = _body(parse(html or ""))
    if body is None:
        return None, "missing_article_body"
    body.remove(lambda e: e.tag in WIKI_TAGS or bool(e.classes & WIKI_CLASSES) or e.tag == "sup" and "reference" in e.classes)

    def ends(e: Element) -> bool:
        head = e.first("h2", "h3") if e.tag == "section" else None
        return head is not None and head.text().casefold() in WIKI_SECTIONS

    body.remove(ends)
    chunks = [t for e in body.walk() if e.tag in {"h2", "h3", "p", "li"} and not (e.tag == "li" and e.inside("li")) and (t := e.text())]
    if not chunks:
        return None, "empty_article_content"
    content = "\n\n".join(chunks)
    if sum(not c.isspace() for c in content) < least:
        return None, "content_too_short"
    return content, None


def article(html: str | None, kind: str, base: str | None = None) -> tuple[str | None, str | None, str | None, str | None]:
    """(title, canonical_url, content, error) of an article page.

    The canonical link must be there; the title is og:title or else the title element; the content comes from the article
    element, else main, else the body: headings 1 to 3, paragraphs and list entries, or all its text if it has none of them.
    """
    root = parse(html or "")
    link = next((e for e in root.walk() if e.tag == "link" and "canonical" in e.attrs.get("rel", "").split()), None)
    href = link.attrs.get("href", "").strip() if link is not None else ""
    if not href:
        return None, None, None, "missing_canonical_url"
    url = canonical_url(href, kind, base if kind == "rss" else None)
    if url is None:
        return None, None, None, "invalid_canonical_url"
    meta = next((e for e in root.walk() if e.tag == "meta" and e.attrs.get("property") == "og:title"), None)
    title = " ".join(meta.attrs.get("content", "").split()) if meta is not None else ""
    if not title:
        named = root.first("title")
        title = named.text() if named is not None else ""
    if not title:
        return None, None, None, "missing_article_title"
    body = root.first("article") or root.first("main") or _body(root)
    if body is None:
        return None, None, None, "missing_article_body"
    body.remove(lambda e: e.tag in ARTICLE_TAGS)
    chunks = [t for e in body.walk() if e.tag in {"h1", "h2", "h3", "p", "li"} and (t := e.text())] or [t for t in [body.text()] if t]
    if not chunks:
        return None, None, None, "empty_article_content"
    return title, url, "\n\n".join(chunks), None


def _mapped(df: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    """Rows (id, *columns) through ``function``, in Arrow batches of bounded size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                results = [function(*row) for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                names = [x.split()[0] for x in schema.split(",")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in results], pa.string()) for i in range(len(names)))], ["id", *names])

    return df.select("id", *columns).mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {schema}")


def extract_encyclopedia(pages: DataFrame, least: int = 100, extractor=None) -> DataFrame:
    """(id, content, error) of pages (id, html); ``extractor`` (html -> content, error) may replace the built-in one."""
    return _mapped(pages, ["html"], extractor or (lambda html: encyclopedia_text(html, least)), "content string, error string")


def extract_articles(pages: DataFrame, kind: str = "medium") -> DataFrame:
    """(id, title, canonical_url, content, error) of pages (id, html, url)."""
    return _mapped(pages, ["html", "url"], lambda html, url: article(html, kind, url), "title string, canonical_url string, content string, error string")
