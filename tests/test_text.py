import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.functions import stemming, text, urls
from lexmill.functions.hosts import document_host, host_of, matches_metadata, normalize_source


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def applied(spark, values, expression):
    return [r[0] for r in column(spark, values).orderBy("i").select(expression(F.col("c"))).collect()]


def test_analyze(spark):
    got = applied(spark, ["The Quick, brown-fox!", None, "  \t ", "A1 b_2 of", "Ünïcode café"], text.analyze)
    assert got == [["quick", "brown", "fox"], [], [], ["a1", "b", "2"], ["n", "code", "caf"]]
    assert applied(spark, ["the fox of"], text.analyzer(("fox",))) == [["the", "of"]]
    assert applied(spark, ["the fox"], text.analyzer(())) == [["the", "fox"]]


def test_scopes_and_phrases(spark):
    df = spark.createDataFrame([("Search Engine", "engine of search", "search engine")], "t string, c string, q string")
    terms = {s: df.select(text.scoped_terms(F.col("t"), F.col("c"), s)).first()[0] for s in ("all", "title", "content")}
    assert terms["all"] == ["search", "engine", "search", "engine", "engine", "search"] and terms["content"] == ["engine", "search"]
    with pytest.raises(ValueError):
        text.scoped_terms(F.col("t"), F.col("c"), "body")
    row = df.select(text.has_phrase(text.analyze(F.col("t")), text.analyze(F.col("q"))), text.has_phrase(text.analyze(F.col("c")), text.analyze(F.col("q"))), text.has_phrase(text.analyze(F.col("t")), F.array().cast("array<string>"))).first()
    assert tuple(row) == (True, False, False)


def test_snippet(spark):
    df = spark.createDataFrame([("Main title. More", "one. Two ai three. four", ["ai"]), ("x", "long " * 60, ["zzz"]), (None, None, ["a"])], "t string, c string, w array<string>")
    got = [r[0] for r in df.select(text.snippet(F.col("t"), F.col("c"), F.col("w"))).collect()]
    assert got == ["Main title", ("long " * 60)[:180], ""]


def test_strip_and_messages(spark):
    assert applied(spark, ["  a \n", None, " \t"], text.strip) == ["a", None, ""]
    assert applied(spark, ["a\n\n b  c"], text.safe_message) == ["a b c"]
    assert applied(spark, ["ok", "bad\x00", " ", None, "tab\t"], text.clean_text) == [True, False, False, False, False]
    assert applied(spark, ["a b　c\n"], text.visible_characters) == [3]


def test_hosts(spark):
    got = applied(spark, ["https://User:pw@A_b.Example.com.:8080/x y", "http://[2001:db8::1]/p", "mailto:x@y", None, "", "//host/x", "ftp://Files.example?x"], host_of)
    assert got == ["a_b.example.com", "2001:db8::1", None, None, None, None, "files.example"]
    assert applied(spark, [" Wiki.ORG.. ", "...", None, ""], normalize_source) == ["wiki.org", None, None, None]
    df = spark.createDataFrame([("A.org", "https://b.org/x"), (None, "https://b.org/x"), (" ", None)], "h string, u string")
    assert [r[0] for r in df.select(document_host(F.col("h"), F.col("u"))).collect()] == ["a.org", "b.org", None]


def test_metadata_filter(spark):
    t = dt.datetime(2024, 5, 1, 23, 59)
    rows = [(1, "wikipedia.org", t), (2, "en.wikipedia.org", t), (3, "notwikipedia.org", t), (4, None, t), (5, "wikipedia.org", None)]
    df = spark.createDataFrame(rows, "id int, h string, t timestamp")

    def ids(*args):
        return sorted(r.id for r in df.where(matches_metadata(F.col("h"), F.col("t"), *args)).collect())

    assert ids("WIKIPEDIA.org.") == [1, 2, 5]
    assert ids(" ") == [1, 2, 3, 4, 5]
    assert ids(None, dt.date(2024, 5, 1), dt.date(2024, 5, 1)) == [1, 2, 3, 4]
    assert ids("wikipedia.org", dt.date(2024, 5, 2)) == []


@pytest.mark.parametrize(
    ("url", "kind", "want"),
    [
        (" HTTP://Medium.com:443/a?utm_x=1&b=2&Ref=3&b=#f ", "medium", "http://medium.com:443/a?b=2&b="),
        ("https://medium.com", "medium", "https://medium.com/"),
        ("ftp://medium.com/x", "medium", None),
        ("http://a.example/x", "rss", None),
        ("https://a.example/x?sk=1&feed=2&q=a b", "rss", "https://a.example/x?sk=1&q=a+b"),
        ("https://a.example:bad/", "rss", None),
        (None, "rss", None),
    ],
)
def test_canonical_url(url, kind, want):
    assert urls.canonical_url(url, kind) == want


def test_url_columns(spark):
    assert urls.canonical_url("../p?from=x", "rss", "https://a.example/feed/x") == "https://a.example/p"
    assert applied(spark, ["https://a.example/?ref=1", None], lambda c: urls.canonical_urls(c, "rss")) == ["https://a.example/", None]
    df = spark.createDataFrame([("/p", "https://a.example/x")], "u string, b string")
    assert df.select(urls.canonical_urls(F.col("u"), "rss", F.col("b"))).first()[0] == "https://a.example/p"
    assert applied(spark, ["A b (c)/d", None], urls.article_url) == ["https://en.wikipedia.org/wiki/A_b_(c)%2Fd", None]
    assert applied(spark, [" category: Physics ", "Physics", "category:", "https://x.example/y", "a\x01", "//x", "x" * 250], urls.category_title) == ["Category:Physics", "Category:Physics", None, None, None, None, None]
    assert applied(spark, ["https://medium.com/pub/x", "https://medium.com/public/x", "http://medium.com/pub/x", None], lambda c: urls.in_publication(c, "https://medium.com", "/pub")) == [True, False, False, False]
    assert applied(spark, ["https://A.example:443/x", "https://a.example:8/x", None], lambda c: urls.same_origin(c, F.lit("https://a.example/feed"))) == [True, False, False]


def test_seeds():
    assert urls.medium_seed("https://medium.com/pub/")["feed"] == "https://medium.com/feed/pub"
    assert urls.medium_seed("https://x.medium.com")["feed"] == "https://x.medium.com/feed"
    assert urls.rss_seed("https://A.example/f?x=1")["url"] == "https://a.example/f?x=1"
    for bad in ("http://medium.com/p1", "https://medium.com/@me", "https://medium.com/p", "https://medium.com/a/b", "https://example.com/a", "https://u:p@medium.com/a"):
        with pytest.raises(ValueError, match="medium_invalid_seed"):
            urls.medium_seed(bad)
    with pytest.raises(ValueError, match="rss_invalid_seed"):
        urls.rss_seed("http://a.example/f")


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("runs", "run"), ("runner", "runner"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
     ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("oscillators", "oscil"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas"),
     ("agreed", "agre"), ("plastered", "plaster"), ("feed", "feed"), ("is", "is")],
)
def test_stem(word, want):
    assert stemming.stem(word) == want


def test_stemming_analyzer(spark):
    assert applied(spark, ["Running the runs", None], stemming.stemming_analyzer()) == [["run", "run"], []]
