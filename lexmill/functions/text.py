"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no weight in retrieval (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with")
#: All white space, as a regular-expression class: what Python's str.strip removes.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SNIPPET = 180

Analyzer = Callable[[Column], Column]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def analyzer(stopwords: Iterable[str] = STOPWORDS) -> Analyzer:
    """A function from text to its terms: runs of ASCII letters and digits of the lower-cased text that aren't stop words.

    Null and blank texts have no terms.
    """
    drop = sorted(set(stopwords))

    def analyze(c: Column) -> Column:
        parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " ")
        return F.filter(parts, lambda t: (t != "") & ~t.isin(drop) if drop else t != "")

    return analyze


analyze = analyzer()


def scoped_terms(title: Column, content: Column, scope: str, analyze: Analyzer = analyze) -> Column:
    """Terms of a document in a scope; scope all has the title's terms twice, so the title weighs more."""
    t, c = analyze(title), analyze(content)
    if scope == "all":
        return F.concat(t, t, c)
    if scope in ("title", "content"):
        return t if scope == "title" else c
    raise ValueError("scope must be one of: all, title, content")


def has_phrase(terms: Column, phrase: Column) -> Column:
    """Whether the array ``phrase`` stands in the array ``terms`` as a run. Terms hold no blanks, so joined strings decide exactly."""

    def joined(c: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))

    return (F.size(phrase) > 0) & F.contains(joined(terms), joined(phrase))


def snippet(title: Column, content: Column, terms: Column) -> Column:
    """The first sentence part of title, then content, that holds one of ``terms`` (in any case, anywhere); else the content's start."""
    parts = F.concat(F.split(F.coalesce(title, F.lit("")), r"\."), F.split(F.coalesce(content, F.lit("")), r"\."))
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")
    hit = F.filter(parts, lambda p: F.exists(terms, lambda t: F.contains(F.lower(p), F.lower(t))))
    return F.substring(F.coalesce(F.get(hit, F.lit(0)), F.coalesce(content, F.lit(""))), 1, SNIPPET)


def visible_characters(c: Column) -> Column:
    """The number of characters that aren't white space."""
    return F.length(F.regexp_replace(c, BLANK, ""))


def clean_text(c: Column, allow_whitespace: bool = False) -> Column:
    """Whether a text is non-blank and without control characters (tabs and line breaks may be allowed)."""
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]" if allow_whitespace else r"[\x00-\x1f\x7f]"
    return c.isNotNull() & (strip(c) != "") & ~c.rlike(control)


def safe_message(c: Column, most: int = 300) -> Column:
    """An error text on one line, at most ``most`` characters."""
    return F.substring(collapse(c), 1, most)
