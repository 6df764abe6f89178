"""Canonical addresses. The round trip of a query string needs Python's URL library, so these run on Arrow batches."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import quote, quote_plus, unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Query parameters that only track, by kind of source, whatever their case (fixed values).
TRACKING = {"medium": re.compile(r"utm_.*|source|ref|sk|from", re.I | re.S), "rss": re.compile(r"utm_.*|source|ref|from|feed", re.I | re.S)}
SCHEMES = {"medium": ("http", "https"), "rss": ("https",)}


class Address(NamedTuple):
    """The parts of an absolute address. private: it carries a user name or password."""

    scheme: str
    host: str
    port: int | None
    path: str
    query: str
    fragment: str
    private: bool

    @classmethod
    def read(cls, text: str | None, base: str | None = None) -> Address | None:
        """None where a text has no scheme and host, or a port that isn't one."""
        try:
            split = urlsplit(urljoin(base or "", (text or "").strip()))
            if split.scheme and split.hostname:
                return cls(split.scheme.lower(), split.hostname.casefold(), split.port, split.path, split.query, split.fragment, bool(split.username or split.password))
        except ValueError:
            pass
        return None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" if self.port is None else f"{self.scheme}://{self.host}:{self.port}"

    def parameters(self, but: re.Pattern) -> list[str]:
        """The query's parameters, each escaped in one way, without those whose name is ``but``; one without = has an empty value."""
        out = []
        for piece in filter(None, self.query.split("&")):
            name, _, value = (unquote_plus(x) for x in piece.partition("="))
            if not but.fullmatch(name):
                out.append(quote_plus(name) + "=" + quote_plus(value))
        return out


def canonical_url(url: str | None, kind: str, base: str | None = None) -> str | None:
    """A page's address without tracking and fragment, scheme and host in lower case; null where it isn't one of this kind of source."""
    found = Address.read(url, base)
    if found is None or found.scheme not in SCHEMES[kind]:
        return None
    return "?".join(filter(None, [found.origin + (found.path or "/"), "&".join(found.parameters(TRACKING[kind]))]))


def canonical_urls(url: Column, kind: str, base: Column | None = None) -> Column:
    """``canonical_url`` on a column, a batch at a time; ``base`` resolves relative addresses."""

    def run(urls: pd.Series, bases: pd.Series | None = None) -> pd.Series:
        pairs = zip(urls, bases if bases is not None else [None] * len(urls), strict=True)
        return pd.Series([canonical_url(u, kind, b) for u, b in pairs], dtype=object)

    if base is None:

        def one(urls: pd.Series) -> pd.Series:
            return run(urls)

        return F.pandas_udf(one, "string")(url)

    def two(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return run(urls, bases)

    return F.pandas_udf(two, "string")(url, base)


def article_url(title: Column) -> Column:
    """The encyclopedia address of a title: blanks as underscores, all but letters, digits, _.-~ and parentheses escaped."""

    def run(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: None if t is None else "https://en.wikipedia.org/wiki/" + quote(t.replace(" ", "_"), safe="()"), na_action="ignore")

    return F.pandas_udf(run, "string")(title)


def category_title(c: Column) -> Column:
    """``Category:`` and the title, whatever the case of a given prefix; null for blank titles, control characters, addresses, over 255 characters."""
    plain = strip(c)
    title = F.when(F.lower(plain).startswith("category:"), strip(F.substring(plain, 10, 1_000_000))).otherwise(plain)
    full = F.concat(F.lit("Category:"), title)
    bad = plain.rlike(r"[\x00-\x1f\x7f]") | (title == "") | title.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?!:)\S*$") & title.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | title.startswith("//") | (F.length(full) > 255)
    return F.when(~bad, full)


def medium_seed(url: str) -> dict[str, str]:
    """Checked address of a publication: https, no credentials, query or fragment; on the main host one section, on a subdomain at most one."""
    a = Address.read(url)
    if a is None or a.scheme != "https" or a.private or a.query or a.fragment or not f".{a.host}".endswith(".medium.com"):
        raise ValueError("medium_invalid_seed")
    main = a.host == "medium.com"
    section = re.fullmatch(r"/*(?!@)([^/]+)/*" if main else r"/*(?:(?!@)([^/]+)/*)?", a.path)
    if section is None or main and section[1] == "p":
        raise ValueError("medium_invalid_seed")
    path, origin = "/" + (section[1] or ""), f"https://{a.host}"
    return {"url": origin + path, "origin": origin, "path": path, "feed": f"{origin}/feed{path if main else ''}", "sitemap": f"{origin}/sitemap.xml"}


def rss_seed(url: str) -> dict[str, str]:
    """Checked address of a feed: https and no credentials; its query is kept."""
    a = Address.read(url)
    if a is None or a.scheme != "https" or a.private:
        raise ValueError("rss_invalid_seed")
    path = a.path or "/"
    return {"url": "?".join(filter(None, [a.origin + path, a.query])), "origin": a.origin, "path": path}


def in_publication(url: Column, origin: Column | str, path: Column | str) -> Column:
    """Whether an address belongs to a publication: same https host, and on the main host below its section."""
    origin, path = (F.lit(x) if isinstance(x, str) else x for x in (origin, path))
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]*)", 1))
    where = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    rest = F.when(origin == "https://medium.com", F.startswith(where, F.concat(path, F.lit("/")))).otherwise(~where.isin("/feed", "/sitemap.xml", "/robots.txt"))
    return F.coalesce((F.concat(F.lit("https://"), host) == origin) & (host != "") & rest, F.lit(False))


def same_origin(url: Column, origin: Column) -> Column:
    """Whether two addresses are https with the same host and port."""

    def key(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.regexp_extract(c, r"(?i)^(https://[^/?#]*)", 1)), ":443$", "")

    return F.coalesce((key(url) == key(origin)) & (key(url) != ""), F.lit(False))
