"""Sources, hosts and dates of documents, as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_AUTHORITY = r"^[\s\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def normalize_source(c: Column) -> Column:
    """Lower case, no outer white space, no closing dots; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""), F.lit(""))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without closing dots; null for anything without one.

    By expression, because built-in URL parsing is null for hosts with underscores and for URLs with blanks.
    """
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")
    bracketed = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(authority, r"^([^:\[\]]*)", 1)
    host = F.when(F.startswith(authority, F.lit("[")), bracketed).otherwise(plain)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def document_host(source_host: Column, url: Column) -> Column:
    """The given host, else the URL's."""
    return F.coalesce(normalize_source(source_host), host_of(url))


def utc_date(ts: Column) -> Column:
    """The calendar day in UTC, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def from_source(host: Column, source: Column) -> Column:
    """Whether a host is the source or lies below it (at a dot). A null source lets everything pass; a null host then fails."""
    return source.isNull() | F.coalesce((host == source) | F.endswith(host, F.concat(F.lit("."), source)), F.lit(False))


def in_dates(day: Column, first: Column, last: Column) -> Column:
    """Whether a day lies within both inclusive bounds; null bounds don't bind, a null day fails where one does."""
    return (first.isNull() | F.coalesce(day >= first, F.lit(False))) & (last.isNull() | F.coalesce(day <= last, F.lit(False)))


def matches_metadata(host: Column, created_at: Column, source: str | None = None, created_from: dt.date | None = None, created_to: dt.date | None = None) -> Column:
    """Both filters with constant arguments; only the active ones are in the condition. Days are compared as instants, which the scan can use.

    For ``where``: a null host or date makes the condition null, which doesn't pass.
    """
    condition = F.lit(True)
    name = (source or "").strip().lower().rstrip(".")
    if name:
        condition &= (host == name) | F.endswith(host, F.lit("." + name))
    if created_from is not None:
        condition &= created_at >= F.lit(dt.datetime.combine(created_from, dt.time(), dt.UTC))
    if created_to is not None:
        condition &= created_at < F.lit(dt.datetime.combine(created_to + dt.timedelta(days=1), dt.time(), dt.UTC))
    return condition
