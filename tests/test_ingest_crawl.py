import json
import urllib.error
from email.message import Message

import pytest
from pyspark.sql import functions as F

from lexmill.functions import html
from lexmill.operators import crawl, ingest
from lexmill.sources import category_pages, corpus, feeds
from lexmill.streaming.ingest import StreamIngest

PAYLOADS = [
    ({"title": "  A ", "content": " b ", "url": "  "}, None),
    ({"title": "A", "content": "b", "secret": 1}, "secret: Extra inputs are not permitted"),
    ({"title": "A"}, "content: Field required"),
    ({"title": "  ", "content": "b"}, "title: must be a non-empty string"),
    ({"title": "A\x00b", "content": "b"}, "title: must not contain null characters"),
    ({"title": "A", "content": "b", "url": "https://x.example/\x00"}, "url: must not contain null characters"),
    ({"title": 5, "content": "b"}, "title: Input should be a valid string"),
    ({"title": "A", "content": None}, "content: Input should be a valid string"),
    ({"title": "A", "content": "b", "url": 7}, "url: Input should be a valid string"),
    (42, ingest.NOT_OBJECT), (None, ingest.NOT_OBJECT), ([1], ingest.NOT_OBJECT),
    ({"title": "A", "content": "b", "url": "https://d.example/1"}, None),
    ({"title": "B", "content": "b", "url": " https://d.example/1 "}, None),
    ({"title": " ", "content": "b", "url": "https://d.example/2"}, "title: must be a non-empty string"),
    ({"title": "C", "content": "b", "url": "https://d.example/2"}, None),
    ({"title": "D", "content": "b", "url": "https://old.example/"}, None),
    ({"title": "E", "content": "b", "url": None}, None),
]


@pytest.fixture(scope="module")
def envelopes(spark):
    body = json.dumps({"documents": [p for p, _ in PAYLOADS]})
    return spark.createDataFrame([("job", body)], "job_id string, body string")


def test_validation(spark, envelopes):
    rows = ingest.validated(ingest.staged(envelopes)).orderBy("position").collect()
    assert [r.error for r in rows] == [e for _, e in PAYLOADS]
    assert (rows[0].title, rows[0].content, rows[0].url) == ("A", "b", None)
    clash = ingest.validated(ingest.staged(envelopes).withColumns({"title": F.lit(1), "keys": F.lit(2)}))
    assert clash.where("error is null").count() == sum(e is None for _, e in PAYLOADS)


def test_outcomes(spark, envelopes):
    docs = spark.createDataFrame([(7, "https://old.example/"), (8, None)], "id long, url string")
    rows = ingest.classified(ingest.validated(ingest.staged(envelopes)), docs, ["job_id", "position"])
    got = {r.position: (r.status, r.error) for r in rows.collect()}
    assert got[12] == ("imported", None) and got[13] == ("skipped", "duplicate_url") and got[15] == ("imported", None)
    assert got[16] == ("skipped", "duplicate_url") and got[0] == got[17] == ("imported", None) and got[14][0] == "failed"
    counts = ingest.status_counts(rows).first()
    assert (counts.received, counts.imported, counts.skipped, counts.failed) == (18, 4, 2, 12)
    made = ingest.imported_documents(rows, docs, ["job_id", "position"]).orderBy("id").collect()
    assert [(r.id, r.title) for r in made] == [(9, "A"), (10, "A"), (11, "C"), (12, "E")]


def test_envelopes_are_checked(spark):
    for body in ({"documents": []}, {"documents": [1] * 501}, {"documents": [{}], "mode": "x"}, {"items": []}):
        with pytest.raises(Exception, match="documents must hold"):
            ingest.staged(spark.createDataFrame([("j", json.dumps(body))], "job_id string, body string")).collect()
    assert ingest.staged(spark.createDataFrame([], "job_id string, body string")).count() == 0


def test_progress(spark):
    df = spark.createDataFrame([(1, 3), (0, None), (2, 0)], "c long, t long")
    assert [r[0] for r in df.select(ingest.progress(F.col("c"), F.col("t"))).collect()] == [33.33, None, None]


def test_streaming_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    calls = []
    stream = StreamIngest(spark, str(tmp_path / "out"), lambda docs: calls.append(docs.count()))

    def put(name, items):
        (source / name).write_text(json.dumps({"job_id": name, "body": json.dumps({"documents": items})}) + "\n")

    def go():
        stream.start(spark.readStream.schema("job_id string, body string").json(str(source))).awaitTermination()

    put("a.json", [{"title": "A", "content": "x", "url": "https://d.example/1"}, {"title": ""}])
    go()
    put("b.json", [{"title": "B", "content": "x", "url": "https://d.example/1"}, {"title": "C", "content": "y"}])
    go()
    again = spark.createDataFrame([("b.json", (lambda t: json.loads(t)["body"])((source / "b.json").read_text()))], "job_id string, body string")
    stream.run_batch(again, 1)
    assert sorted((r.id, r.title) for r in stream.documents().collect()) == [(1, "A"), (2, "C")]
    assert sorted((r.batch, r.position, r.status) for r in stream.outcomes().collect()) == [(0, 0, "imported"), (0, 1, "failed"), (1, 0, "skipped"), (1, 1, "imported")]
    assert calls == [1, 2, 2]


def links(spark, rows):
    return spark.createDataFrame(rows, "parent string, kind string, position long, page_id long, title string")


GRAPH = [
    ("root", "page", 0, 1, "P1"), ("root", "category", 1, None, "A"), ("root", "category", 2, None, "B"), ("root", "page", 3, 2, "P2"), ("root", "page", 4, 1, "P1 again"),
    ("A", "page", 0, 2, "P2"), ("A", "page", 1, 3, "P3"), ("A", "category", 2, None, "root"), ("A", "category", 3, None, "C"), ("B", "page", 0, 4, "P4"), ("B", "category", 1, None, "C"),
    ("B", "category", 2, None, "D"), ("C", "page", 0, 5, "P5"), ("D", "page", 0, 6, "P6"), ("D", "category", 1, None, "E"), ("E", "page", 0, 7, "P7"), ("A", "page", 9, None, "null id"), ("A", "category", 9, None, None),
]


def test_discovery(spark):
    cats, pages = crawl.discover(links(spark, GRAPH), "root", 2)
    assert [(r.title, r.depth) for r in cats.orderBy("number").collect()] == [("root", 0), ("A", 1), ("B", 1), ("C", 2), ("D", 2)]
    assert [r.page_id for r in pages.orderBy("position").collect()] == [1, 2, 3, 4, 5, 6]
    cats, pages = crawl.discover(links(spark, GRAPH), "root", 2, max_pages=3)
    assert [r.page_id for r in pages.orderBy("position").collect()] == [1, 2, 3]
    assert {r.title for r in cats.collect()} == {"root", "A", "B"}
    cats, pages = crawl.discover(links(spark, GRAPH), "root", 2, max_categories=2)
    assert {r.title for r in cats.collect()} == {"root", "A"} and [r.page_id for r in pages.orderBy("position").collect()] == [1, 2, 3]
    cats, pages = crawl.discover(links(spark, GRAPH), "root", 0)
    assert pages.count() == 2 and cats.count() == 1
    cats, pages = crawl.discover(links(spark, []), "root", 2)
    assert (cats.count(), pages.count()) == (1, 0)
    with pytest.raises(ValueError):
        crawl.discover(links(spark, GRAPH), "root", 2, max_pages=0)


def test_checkpoint(spark):
    found = spark.createDataFrame([("u1", 0), ("u2", 1), ("u2", 2), ("u3", 3), (None, 4), ("u4", 5)], "url string, at long")
    known = spark.createDataFrame([("u1", 7)], "url string, position long")
    got = crawl.checkpoint(found, known, "url", 3, ["at"]).orderBy("position").collect()
    assert [(r.url, r.position) for r in got] == [("u2", 8), ("u3", 9)]
    assert crawl.checkpoint(found, known, "url", 1, ["at"]).count() == 0


def test_counts_and_reports(spark):
    items = spark.createDataFrame(
        [("j", 0, 1, "u0", "fetched", 10, 100, None), ("j", 1, 2, "u1", "fetched", 11, None, None), ("j", 2, 3, "u2", "failed", None, None, "http_404"), ("j", 3, 4, "u3", "pending", None, None, None)],
        "job_id string, position long, id long, canonical_url string, fetch_status string, ingestion_item_id long, document_id long, error string",
    )
    outcomes = spark.createDataFrame([(10, "imported", None), (11, "skipped", "duplicate_url"), (12, "pending", None)], "ingestion_item_id long, status string, error string")
    r = crawl.crawl_counts(items, outcomes).first()
    assert (r.discovered, r.fetched, r.imported, r.skipped, r.failed, r.terminal) == (4, 2, 1, 1, 1, 3)
    report = {x.id: x.error for x in crawl.item_report(items, outcomes).collect()}
    assert report == {1: None, 2: "duplicate_url", 3: "http_404", 4: None}
    assert crawl.pending_ingestion(items, outcomes).count() == 0
    frontier = spark.createDataFrame([("j", 5, 1, "pending", None), ("j", 6, 0, "completed", None), ("j", 7, 0, "pending", "x"), ("k", 8, 0, "failed", None)], "job_id string, id long, depth long, status string, continuation string")
    assert {r.job_id: r.id for r in crawl.next_frontier(frontier).collect()} == {"j": 7}
    assert {r.job_id: r.has_pending for r in crawl.has_pending(frontier).collect()} == {"j": True, "k": False}
    assert {r.job_id: r.categories_visited for r in crawl.categories_visited(frontier).collect()} == {"j": 2, "k": 1}


FEED = """<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><link>https://medium.com/feed/pub</link><item><guid>g1</guid><title> One  two </title><link>https://a.example/1?utm_source=x</link>
<content:encoded><![CDATA[<p>Body</p>]]></content:encoded></item><item><title>No link</title></item><item><title>Bad</title><link>ftp://a.example/2</link></item><item><title>Three</title><link>https://a.example/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>E</title><link rel="self" href="/self"/><link href="/post?ref=1&amp;q=2"/><content>text</content></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, FEED, "https://a.example/feed"), (2, ATOM, "https://b.example/feed"), (3, "<rss", "https://c.example"), (4, None, None)], "feed_id long, xml string, url string")
    rows = {(r.feed_id, r.position): r for r in feeds.parse_feeds(df, "rss").collect()}
    first = rows[1, 0]
    assert (first.source_item_id, first.title, first.canonical_url, first.embedded_content) == ("g1", "One two", "https://a.example/1", "<p>Body</p>")
    assert rows[1, 1].source_item_id == "https://a.example/3" and (1, 2) not in rows
    assert (rows[2, 0].canonical_url, rows[2, 0].discovered_url) == ("https://b.example/post?q=2", "https://b.example/post?ref=1&q=2")
    assert rows[3, 0].error == rows[4, 0].error == "rss_invalid_feed"
    assert feeds.channel_path(FEED) == "/pub" and feeds.channel_path("<x") is None
    maps = spark.createDataFrame([(1, "<urlset><url><loc> https://a.example/1 </loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc>https://a.example/s</loc></sitemap></sitemapindex>"), (3, "<html/>"), (4, None)], "feed_id long, xml string")
    got = {r.feed_id: (r.kind, r.url, r.error) for r in feeds.parse_sitemaps(maps).collect()}
    assert got == {1: ("page", "https://a.example/1", None), 2: ("sitemap", "https://a.example/s", None), 3: (None, None, "medium_invalid_sitemap"), 4: (None, None, "medium_invalid_sitemap")}


def test_discovered_and_embedded(spark):
    def some(*urls):
        return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "position long, canonical_url string")

    got = feeds.discovered(some("b", "a"), some("a", "c"), some("c", "d"), 3).orderBy("position").collect()
    assert [(r.position, r.canonical_url) for r in got] == [(0, "b"), (1, "a"), (2, "c")]
    df = spark.createDataFrame([("A & <b>", "https://a.example/?x=1&y=2", "<p>Body text</p>"), (None, "u", None)], "t string, u string, b string")
    page = [r[0] for r in df.select(feeds.embedded_page(F.col("t"), F.col("u"), F.col("b"))).collect()]
    assert page[1] is None and html.article(page[0], "medium") == ("A & <b>", "https://a.example/?x=1&y=2", "Body text", None)


PAGE = """<html><head><title>T</title></head><body><nav><p>menu</p></nav><section><h2>Life</h2><p>Born <b>in</b> 1900<sup class="reference">[1]</sup>.<p>Second <i>part</i>
<ul><li>one<ul><li>inner</li></ul><li>two</ul><table><tr><td>cell</td></tr></table><figure>pic</figure></section><section><h2>REFERENCES</h2><p>ref</p></section><div class="references">r</div></body></html>"""


def test_encyclopedia_page():
    content, error = html.encyclopedia_text(PAGE, 10)
    assert error is None and content == "Life\n\nBorn in 1900 .\n\nSecond part\n\none inner\n\ntwo"
    assert html.encyclopedia_text(None) == html.encyclopedia_text("") == (None, "missing_article_body")
    assert html.encyclopedia_text("<body><script>x</script></body>") == (None, "empty_article_content")
    assert html.encyclopedia_text("<body><p>short</p></body>") == (None, "content_too_short")


def test_article_page(spark):
    page = '<html><head><link rel="canonical" href="https://m.example/a?utm_x=1"><meta property="og:title" content=" A  title "></head><body><nav><p>n</p></nav><article><h1>H</h1><p>x</p><aside><p>y</p></aside><li><p>z</p></li></article></body></html>'
    assert html.article(page, "medium") == ("A title", "https://m.example/a", "H\n\nx\n\nz\n\nz", None)
    assert html.article("<p>x</p>", "medium")[3] == "missing_canonical_url"
    assert html.article('<link rel=canonical href="ftp://x">', "medium")[3] == "invalid_canonical_url"
    assert html.article('<link rel=canonical href="https://x.example">', "medium")[3] == "missing_article_title"
    assert html.article('<link rel=canonical href="https://x.example"><title>t</title><body></body>', "medium")[3] == "empty_article_content"
    assert html.article('<link rel=canonical href="/rel"><title>t</title><body>text only</body>', "rss", "https://x.example/f") == ("t", "https://x.example/rel", "text only", None)
    df = spark.createDataFrame([(1, page, None), (2, None, None)], "id long, html string, url string")
    assert {r.id: r.error for r in html.extract_articles(df).collect()} == {1: None, 2: "missing_canonical_url"}
    deep = "<div>" * 20_000 + "<p>deep enough to overflow a recursive walk</p>"
    assert html.encyclopedia_text(deep, 5)[1] is None


def test_document_tables(spark):
    docs = spark.createDataFrame([(1, "t1", "c1", "u1", "active"), (2, "t2", "c2", "u2", "deleted"), (3, "t3", "c3", None, "active")], "id long, title string, content string, url string, status string")
    assert [r.id for r in corpus.active_page(docs, 1, 1).collect()] == [3]
    assert corpus.point(docs, 2).count() == 0
    changes = spark.createDataFrame([(1, "n", None, None, True, False, True), (2, "n", None, None, True, False, False)], "id long, title string, content string, url string, has_title boolean, has_content boolean, has_url boolean")
    rows = {r.id: r for r in corpus.with_changes(docs, changes).collect()}
    assert (rows[1].title, rows[1].content, rows[1].url) == ("n", "c1", None) and rows[2].title == "t2"
    assert {r.id: r.status for r in corpus.soft_deleted(docs, spark.createDataFrame([(3,), (3,), (9,)], "id long")).collect()} == {1: "active", 2: "deleted", 3: "deleted"}
    with pytest.raises(ValueError):
        corpus.active_page(docs, 0)


def test_json_corpus(spark, tmp_path):
    good = tmp_path / "c.json"
    good.write_text(json.dumps({"documents": [{"id": 1, "title": "a", "content": "x"}, {"id": 1, "title": "b", "content": "y", "url": None}, {"id": 2, "title": "c", "content": "z", "url": "u"}]}))
    assert {r.id: (r.title, r.url) for r in corpus.read_corpus(spark, str(good)).collect()} == {1: ("b", None), 2: ("c", "u")}
    for item, message in (({"id": "1", "title": "a", "content": "x"}, "index 0 field 'id' must be an integer"), ({"id": 1, "content": "x"}, "index 0 missing required field 'title'"), (5, "index 0 must be an object"), ({"id": 1, "title": "a", "content": "x", "url": 3}, "field 'url' must be a string or null")):
        bad = tmp_path / "bad.json"
        bad.write_text(json.dumps({"documents": [item]}))
        with pytest.raises(Exception, match=message):
            corpus.read_corpus(spark, str(bad)).collect()
    judged = tmp_path / "j.json"
    judged.write_text(json.dumps({"name": "n", "queries": [{"query": "a", "relevant_document_ids": [1, 2, 2]}]}))
    queries, pairs = corpus.read_judgments(spark, str(judged))
    assert queries.count() == 1 and pairs.count() == 2
    judged.write_text(json.dumps({"name": "n", "queries": [{"query": "a", "relevant_document_ids": []}]}))
    with pytest.raises(Exception, match="evaluation query at index 0"):
        corpus.read_judgments(spark, str(judged))[0].collect()


class Answer:
    def __init__(self, body, kind="application/json"):
        self.body, self.headers = body, {"Content-Type": kind}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self, n):
        return self.body[:n]


def http_error(code, **headers):
    h = Message()
    for k, v in headers.items():
        h[k.replace("_", "-")] = v
    return urllib.error.HTTPError("u", code, "x", h, None)


def client(answers, **options):
    waits = []

    def opener(request, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    return category_pages.PoliteClient(0, opener=opener, sleep=waits.append, **options), waits


def test_polite_client():
    c, waits = client([http_error(503, Retry_After="2"), Answer(b"ok")])
    assert c.get("https://a.example/x", "json") == b"ok" and waits == [2.0]
    for answers, message in (([http_error(404)], "http_404"), ([Answer(b"x", "text/html")], "unexpected_content_type"), ([Answer(b"x" * 11)], "response_too_large"), ([http_error(302, Location="https://b.example/")], "redirect_refused"), ([http_error(500)] * 3, "http_500"), ([TimeoutError()] * 3, "transport_error")):
        c, _ = client(list(answers), most_bytes=10)
        with pytest.raises(ValueError, match=message):
            c.get("https://a.example/x", "json")
    assert category_pages.retry_delay(0, "Thu, 01 Jan 1970 00:01:00 GMT", now=30.0) == 30.0
    assert 0 <= category_pages.retry_delay(3, None) <= 8


def test_category_answers(spark):
    body = json.dumps({"query": {"categorymembers": [{"pageid": 1, "ns": 0, "title": "P"}, {"pageid": 2, "ns": 14, "title": "Category:C"}, {"pageid": 3, "ns": 2, "title": "User:X"}]}})
    df = spark.createDataFrame([("root", 0, body), ("root", 1, "{bad"), ("root", 2, None)], "parent string, number long, body string")
    got = [(r.kind, r.page_id, r.title) for r in category_pages.category_links(df).orderBy("position").collect()]
    assert got == [("page", 1, "P"), ("category", 2, "Category:C")]
    with pytest.raises(KeyError):
        category_pages.source("gopher")
    category_pages.register(spark)
    rows = spark.read.format("category_pages").option("endpoint", "http://127.0.0.1:9/api").option("categories", '["Category:X"]').option("interval", "0").load()
    assert rows.columns == ["parent", "number", "body", "error"]


def test_every_query_has_docs_or_sql():
    from lexmill import oracle, queries

    assert set(oracle.oracle_sql()) <= set(queries.queries())


def test_capped_by_the_runs_own_limits(spark, tmp_path):
    from lexmill import queries

    rows = [(1000 * j + i, f"r{j}", i, f"https://a.example/{i}") for j in range(2) for i in range(130)]
    spark.createDataFrame(rows, "id long, job_id string, position long, canonical_url string").write.parquet(f"{tmp_path}/crawl_items.parquet")
    spark.createDataFrame([("r0", 120), ("r1", 3)], "job_id string, max_articles long").write.parquet(f"{tmp_path}/crawl_runs.parquet")
    got = {(r.job_id, r.n) for r in queries.crawl_capped(spark, str(tmp_path)).collect()}
    assert got == {("r0", n + 1) for n in range(120)} | {("r1", n + 1) for n in range(3)}


def test_checkpoint_without_limit(spark):
    found = spark.createDataFrame([(f"u{i}", i) for i in range(50)], "url string, at long")
    known = spark.createDataFrame([("u0", 7)], "url string, position long")
    got = {r.url: r.position for r in crawl.checkpoint(found, known, "url", None, ["at"]).collect()}
    assert got == {f"u{i}": 7 + i for i in range(1, 50)}


def test_no_import_is_lost_when_partitions_are_coalesced(spark):
    """60,000 items with 3.8 KB each: the counting side of a numbering is far smaller than the side it counts."""
    items = spark.range(60_000).select(
        F.lit("j").alias("job_id"), F.pmod(F.col("id") * 7919, F.lit(60_000)).alias("position"), F.concat(F.lit("t"), "id").alias("title"),
        F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), 3_700)).alias("content"), F.lit(None).cast("string").alias("url"), F.lit("imported").alias("status"),
    )
    docs = spark.createDataFrame([(41, "u")], "id long, url string")
    made = ingest.imported_documents(items, docs, ["job_id", "position"])
    r = made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last")).first()
    assert (r.n, r.ids, r.first, r.last) == (60_000, 60_000, 42, 60_041)
    placed = made.select("id", F.substring("title", 2, 9).cast("long").alias("t")).where((F.col("id") - 42) != F.pmod(F.col("t") * 7919, F.lit(60_000)))
    assert placed.count() == 0
    assert ingest.imported_documents(items.where("false"), docs, ["job_id", "position"]).count() == 0


def test_discovery_flags(spark):
    def state(**limits):
        d = crawl.discovered(links(spark, GRAPH), "root", 2, **limits)
        f = d.flags.first()
        return {r.title: r.status for r in d.categories.collect()}, (f.complete, f.article_limit_reached, f.category_limit_reached)

    assert state() == (dict.fromkeys(["root", "A", "B", "C", "D"], "completed"), (True, False, False))
    assert state(max_pages=3) == ({"root": "completed", "A": "pending", "B": "pending"}, (True, True, False))
    assert state(max_categories=2) == ({"root": "completed", "A": "completed"}, (True, False, True))
    errors = spark.createDataFrame([("A", 1, "http_500"), ("A", 0, "wikipedia_invalid_response"), ("Z", 0, "x"), (None, 0, "x")], "parent string, number long, error string")
    d = crawl.discovered(links(spark, GRAPH), "root", 2, errors=errors)
    assert {r.title: r.error for r in d.categories.where("status = 'failed'").collect()} == {"A": "wikipedia_invalid_response"} and not d.flags.first().complete


def test_category_errors(spark):
    good = json.dumps({"query": {"categorymembers": [{"pageid": 1, "ns": 0, "title": "P"}, {"ns": 2}]}})
    hole = json.dumps({"query": {"categorymembers": [{"pageid": 1, "ns": 0, "title": "P"}, {"pageid": 2, "ns": 14}]}})
    df = spark.createDataFrame([("a", 0, good, None), ("b", 0, "{bad", None), ("c", 0, None, "http_500"), ("d", 0, hole, None), ("e", 0, "{}", None), ("f", 0, None, None)], "parent string, number long, body string, error string")
    got = {r.parent: r.error for r in category_pages.category_errors(df).collect()}
    assert got == {"c": "http_500", **dict.fromkeys("bdef", "wikipedia_invalid_response")}
    assert [r.parent for r in category_pages.category_links(df).collect()] == ["a"]
    reader = category_pages._Reader({"endpoint": "https://a.example/api", "categories": '["A", "B"]'})
    assert [p.titles for p in reader.partitions()] == [["A", "B"]]  # one task, so one interval, for the host
    answers = iter([b'{"query": {}, "continue": {"cmcontinue": "x"}}', b"[1]", b"\xff"])

    class Client:
        def get(self, url, kind):
            return next(answers)

    assert [(t, n, b is None, e) for t, n, b, e in [*reader._answers(Client(), "A"), *reader._answers(Client(), "B")]] == [("A", 0, False, None), ("A", 1, False, "wikipedia_invalid_response"), ("B", 0, True, "wikipedia_invalid_response")]


def test_frontier_lookup(spark):
    f = spark.createDataFrame([("j", "a", 1), ("j", "b", 2), ("k", "a", 3), (None, "a", 4), ("j", None, 5)], "job_id string, locator string, id long")
    assert [r.id for r in crawl.frontier_at(f, "j", "a").collect()] == [1]
    asked = spark.createDataFrame([("j", "b"), ("k", "a"), ("k", "a"), (None, "a"), ("j", None), ("x", "y")], "job_id string, locator string")
    assert {r.id for r in crawl.located(f, asked).collect()} == {2, 3}


def test_order_statistics(spark):
    import math
    import random
    import statistics

    from lexmill.operators import evaluate

    rng = random.Random(5)
    groups = {"hot": [rng.choice([1.5, 2.5, rng.random() * 9]) for _ in range(3001)], "even": [4.0, 1.0], "one": [7.0]}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("none", None, 1), (None, 3.0, 1), ("hot", None, 1)]
    df = spark.createDataFrame(rows, "kind string, ms double, v int")
    got = {r.kind: (r.median, r.p95, r.max) for r in evaluate.latencies(df, "ms", ["kind"]).collect()}
    want = {g: (statistics.median(vs), sorted(vs)[math.ceil(0.95 * len(vs)) - 1], max(vs)) for g, vs in {**groups, None: [3.0]}.items()}
    assert got == {**want, "none": (None, None, None)}
    whole = [v for _, v, _ in rows if v is not None]
    r = evaluate.latencies(df, "ms").first()
    assert (r.median, r.p95, r.max) == (statistics.median(whole), sorted(whole)[math.ceil(0.95 * len(whole)) - 1], max(whole))
    assert evaluate.latencies(df.where("false"), "ms", ["kind"]).count() == 0


def test_stream_history_errors_are_raised(spark, tmp_path):
    ingest_ = StreamIngest(spark, str(tmp_path))
    assert ingest_.documents().count() == 0
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents" / "batch=0").mkdir()
    (tmp_path / "documents" / "batch=0" / "x.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):  # noqa: B017
        ingest_.documents().count()


def test_pointer_moves_in_one_step(spark, tmp_path):
    from lexmill.sources.snapshots import SnapshotStore

    store = SnapshotStore(spark, str(tmp_path))
    for text in ("one", "two"):
        store._write("ACTIVE", text)
        assert store.active_version() == text
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["ACTIVE"]
