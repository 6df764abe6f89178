"""Feeds and sitemaps as tables of discovered items."""

from __future__ import annotations

import re
from html import escape
from typing import NamedTuple
from urllib.parse import urljoin
from xml.etree.ElementTree import ParseError, XMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url

ITEM = "feed_id long, position long, source_item_id string, title string, discovered_url string, canonical_url string, embedded_content string, error string"


class Rules(NamedTuple):
    """What a kind of feed calls its things. entries: by the name of the root, None for any other root."""

    entries: dict[str | None, str]
    names: tuple[str, ...]
    bodies: frozenset[str]
    relative: bool
    error: str


KINDS = {
    "medium": Rules({None: "item"}, ("guid",), frozenset({"encoded"}), False, "medium_invalid_rss"),
    "rss": Rules({"feed": "entry", None: "item"}, ("guid", "id"), frozenset({"encoded", "content"}), True, "rss_invalid_feed"),
}
SITEMAPS, SITEMAP_ERROR = {"urlset": "page", "sitemapindex": "sitemap"}, "medium_invalid_sitemap"
#: A channel's own section: a path on the main host, behind /feed where it has that.
_SECTION = re.compile(r"(?i:https://(?:[^/?#]*@)?medium\.com)(?::\d*)?(?:/feed(?=/))?(/[^?#]*[^/?#])/*(?:[?#]|$)")


class Field:
    """A child of an entry or channel, or an address of a sitemap: ``own`` is its text up to its first child, ``text`` all of it."""

    def __init__(self, name: str, attributes: dict):
        self.name, self.href, self.rel = name, attributes.get("href"), (attributes.get("rel") or "alternate").casefold()
        self.pieces: list[str] = []
        self.cut: int | None = None

    @property
    def text(self) -> str:
        return "".join(self.pieces).strip()

    @property
    def own(self) -> str:
        return "".join(self.pieces[: self.cut]).strip()

    @property
    def target(self) -> str:
        return self.href or self.own


class Events:
    """Takes a document's parse events in one pass and keeps what feeds and sitemaps are made of, never a tree.

    holders: for item, entry and channel the lists of the fields of each, in order of their opening tags. locs: addresses of sitemaps.
    """

    HOLDERS = ("item", "entry", "channel")

    def __init__(self):
        self.root: str | None = None
        self.open: list[tuple[list[Field] | None, Field | None]] = []
        self.holders: dict[str, list[list[Field]]] = {h: [] for h in self.HOLDERS}
        self.locs: list[Field] = []

    def start(self, tag: str, attributes: dict) -> None:
        name = tag[tag.rfind("}") + 1 :].casefold()
        self.root = self.root or name
        for _, field in self.open:
            if field is not None and field.cut is None:
                field.cut = len(field.pieces)
        around = self.open[-1][0] if self.open else None
        field = Field(name, attributes) if around is not None or name == "loc" else None
        if around is not None:
            around.append(field)
        if name == "loc":
            self.locs.append(field)
        held: list[Field] | None = None
        if name in self.holders:
            held = []
            self.holders[name].append(held)
        self.open.append((held, field))

    def data(self, text: str) -> None:
        for _, field in self.open:
            if field is not None:
                field.pieces.append(text)

    def end(self, _tag: str) -> None:
        self.open.pop()

    def close(self) -> Events:
        return self


def events(xml: str | None) -> Events | None:
    """None if the document can't be read to its end."""
    parser = XMLParser(target=Events())
    try:
        parser.feed((xml or "").encode("utf-8"))
        return parser.close()
    except (ParseError, UnicodeError, ValueError):
        return None


def feed_items(xml: str | None, base: str | None, kind: str) -> list[tuple]:
    """(source_item_id, title, discovered_url, canonical_url, embedded_content, error) of each entry of a feed.

    The link is the first alternate one, else the first. Entries without title or usable link are skipped. XML that can't be read
    gives one row with an error only.
    """
    rules, seen = KINDS[kind], events(xml)
    if seen is None:
        return [(*[None] * 5, rules.error)]

    def item(fields: list[Field]) -> tuple | None:
        link = min((f for f in fields if f.name == "link" and f.target), key=lambda f: f.rel != "alternate", default=None)
        words = {n: w for f in reversed(fields) if (n := f.name) in ("title", *rules.names) and (w := " ".join(f.text.split()))}
        address = link and canonical_url(link.target, kind, base if rules.relative else None)
        if not address or "title" not in words:
            return None
        named = [words[n] for n in rules.names if n in words]
        bodies = [f.text for f in fields if f.name in rules.bodies and f.text]
        return (*named, address)[0], words["title"], urljoin(base or "", link.target) if rules.relative else link.target, address, (*bodies, None)[0], None

    return [x for fields in seen.holders[rules.entries.get(seen.root, rules.entries[None])] if (x := item(fields))]


def channel_path(xml: str | None) -> str | None:
    """The section that a channel's first own link on the main host names, without a leading /feed."""
    seen = events(xml)
    links = (f.target for fields in (seen.holders["channel"] if seen else ()) for f in fields if f.name == "link")
    return next((m[1] for m in map(_SECTION.match, links) if m), None)


def _rows(df: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [(key, i, *r) for key, *args in zip(*(c.to_pylist() for c in part.columns), strict=True) for i, r in enumerate(function(*args))]
                types = [pa.int64(), pa.int64()] + [pa.string()] * (len(names) - 2)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return df.select("feed_id", *columns).mapInArrow(run, schema)


def parse_feeds(feeds: DataFrame, kind: str = "rss") -> DataFrame:
    """Items of feeds (feed_id, xml, url), numbered within each feed."""
    return _rows(feeds, ["xml", "url"], lambda xml, url: feed_items(xml, url, kind), ITEM)


def parse_sitemaps(maps: DataFrame) -> DataFrame:
    """(feed_id, position, kind, url, error) of sitemaps (feed_id, xml): kind page or sitemap."""

    def of(xml):
        seen = events(xml)
        kind = SITEMAPS.get(seen.root) if seen else None
        return [(kind, f.own, None) for f in seen.locs if f.pieces] if kind else [(None, None, SITEMAP_ERROR)]

    return _rows(maps, ["xml"], of, "feed_id long, position long, kind string, url string, error string")


def first_wins(items: DataFrame, key: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Of the rows with one key the first in order; partial minima are combined before the shuffle, so a key with very many rows is no burden."""
    keys = [*(by or []), key]
    rest = [c for c in items.columns if c not in keys]
    picked = items.where(F.col(key).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("x"))
    return picked.select(*keys, *(F.col("x")[c].alias(c) for c in [*order, *[c for c in rest if c not in order]])).select(*items.columns)


def discovered(feed: DataFrame, pages: DataFrame, nested: DataFrame, most: int) -> DataFrame:
    """Items of the feed first, then of the sitemap, then of nested sitemaps (each: position, canonical_url, ...), each page once, at most ``most``.

    The limit keeps the globally first rows with a bounded heap in each task.
    """
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate((feed, pages, nested))]
    everything = ranked[0].unionByName(ranked[1], allowMissingColumns=True).unionByName(ranked[2], allowMissingColumns=True)
    once = first_wins(everything.select("source_rank", "position", "canonical_url", *[c for c in everything.columns if c not in {"source_rank", "position", "canonical_url"}]), "canonical_url", ["source_rank", "position"])
    top = once.orderBy("source_rank", "position", "canonical_url").limit(most)
    return top.withColumn("position", (F.row_number().over(Window.orderBy("source_rank", "position", "canonical_url")) - 1).cast("long")).drop("source_rank")


def embedded_page(title: Column, url: Column, body: Column, fallback: str = "Article") -> Column:
    """A page around content that came inside a feed, so that it needs no fetching."""

    def safe(c: Column) -> Column:
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(mark), F.lit(name))
        return c

    return F.when(
        body.isNotNull() & (body != ""),
        F.concat(F.lit('<html><head><link rel="canonical" href="'), safe(url), F.lit('"><meta property="og:title" content="'), safe(F.coalesce(F.nullif(title, F.lit("")), F.lit(fallback))),
                 F.lit('"></head><body><article>'), body, F.lit("</article></body></html>")),
    )


def as_feed(title: str, items: list[dict[str, str]]) -> str:
    """A feed from its items, for tests and demonstrations."""
    rows = "".join(f"<item><title>{escape(i['title'])}</title><link>{escape(i['link'])}</link></item>" for i in items)
    return f"<rss><channel><title>{escape(title)}</title>{rows}</channel></rss>"
