import json

import pytest

from lexmill.plans import report
from lexmill.plans.pipeline import crawl_encyclopedia, crawl_feeds
from lexmill.plans.session import RetrievalSession
from lexmill.sources import fetch
from lexmill.sources.category_pages import PoliteClient


def page(title):
    return f"<html><body><h2>{title}</h2><p>{'long enough text about ' + title + ' ' * 1 + 'and more words. ' * 8}</p></body></html>"


def test_crawl_to_documents(spark):
    links = spark.createDataFrame(
        [("Category:Top", "page", 0, 1, "One"), ("Category:Top", "page", 1, 2, "Two"), ("Category:Top", "category", 2, None, "Category:Sub"), ("Category:Sub", "page", 0, 3, "Three"), ("Category:Sub", "page", 1, 4, "Four"), ("Category:Sub", "page", 2, 1, "One")],
        "parent string, kind string, position long, page_id long, title string",
    )
    pages = spark.createDataFrame([(1, page("One"), None), (2, page("Two"), None), (3, page("Three"), None), (4, None, "http_500")], "id long, html string, error string")
    docs = spark.createDataFrame([(70, "https://en.wikipedia.org/wiki/Two")], "id long, url string")
    got = crawl_encyclopedia(links, pages, docs, "Category:Top", max_depth=1)
    r = got.counts.first()
    assert (r.discovered, r.fetched, r.imported, r.skipped, r.failed) == (4, 3, 2, 1, 1)
    assert [(d.id, d.title) for d in got.documents.orderBy("id").collect()] == [(71, "One"), (72, "Three")]
    assert {i.page_id: i.error for i in got.items.collect()} == {1: None, 2: "duplicate_url", 3: None, 4: "http_500"}


def test_feeds_to_documents(spark):
    item = "<item><title>{0}</title><link>https://{1}.example/{0}?ref=1</link>{2}</item>"
    inside = '<encoded xmlns="http://purl.org/rss/1.0/modules/content/">&lt;p&gt;Body of it&lt;/p&gt;</encoded>'
    xml = "<rss><channel>" + item.format("one", "a", inside) + item.format("two", "a", "") + item.format("three", "a", "") + item.format("four", "b", inside) + item.format("one", "a", inside) + "</channel></rss>"
    page_two = '<html><head><link rel="canonical" href="https://a.example/two"><title>Two</title></head><body><article><p>Second body</p></article></body></html>'
    feeds_ = spark.createDataFrame([(1, xml, "https://a.example/feed"), (2, "<rss", "https://c.example/feed")], "feed_id long, xml string, url string")
    pages = spark.createDataFrame([("https://a.example/two", page_two, None)], "url string, html string, error string")
    docs = spark.createDataFrame([(5, "https://a.example/two")], "id long, url string")
    got = crawl_feeds(feeds_, pages, docs)
    assert {(r.title, r.status, r.error) for r in got.items.collect()} == {("one", "imported", None), ("two", "skipped", "duplicate_url"), ("three", None, "http_404")}
    r = got.counts.first()
    assert (r.discovered, r.fetched, r.imported, r.skipped, r.failed) == (3, 2, 1, 1, 1)
    assert [(d.id, d.title, d.content) for d in got.documents.collect()] == [(6, "one", "Body of it")]
    assert got.categories.first().error == "rss_invalid_feed"
    assert crawl_feeds(feeds_, pages, docs, most=1).counts.first().discovered == 1


class Fake:
    def __init__(self, body, kind):
        self.body, self.headers = body, {"Content-Type": kind}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self, n):
        return self.body[:n]


def test_fetching(spark):
    def client():
        def opener(request, timeout):
            url = request.full_url
            if url.endswith("/robots.txt"):
                return Fake(b"User-agent: *\nDisallow: /private", "text/plain")
            return Fake(b"\xff" if "bad" in url else b"<p>" + url.encode(), "application/json" if "json" in url else "text/html")

        return PoliteClient(0, opener=opener, sleep=lambda s: None)

    df = spark.createDataFrame([(1, "https://a.example/x"), (2, "https://a.example/private/x"), (3, "https://b.example/bad"), (4, "https://b.example/json"), (5, None), (1, "https://a.example/x")], "id long, url string")
    got = {r.id: (r.body, r.error) for r in fetch.fetch_pages(df, client=client).collect()}
    assert got == {1: ("<p>https://a.example/x", None), 2: (None, "robots_denied"), 3: (None, "not_utf8"), 4: (None, "unexpected_content_type"), 5: (None, "missing_url")}


def test_reports_and_json_session(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"documents": [{"id": 1, "title": "Old bridge", "content": "The bridge is old. It is long."}, {"id": 2, "title": "Ferry", "content": "No bridge here"}]}))
    session = RetrievalSession.from_json_corpus(spark, str(path))
    assert session.version == "local-json-v1"
    shown = report.hits(session.search(session.batch([{"query": "bridge"}])))
    assert shown.splitlines()[0].startswith("1. Old bridge (") and "Old bridge" in shown.splitlines()[2]
    assert report.hits(session.search(session.batch([{"query": "nothing"}]))) == "no results"
    assert report.table(session.index.scope_stats.orderBy("scope"), ["scope", "n_docs"]).splitlines()[1].split() == ["all", "2"]


def test_index_deltas(spark, tmp_path):
    """Documents changed and removed on a published index: the same tables as an index of the changed corpus, in a chain of delta versions."""
    from lexmill.operators import index
    from lexmill.sources.snapshots import SnapshotStore

    shape = "id long, title string, content string, url string, source_host string, created_at timestamp"
    docs = spark.createDataFrame([(i, f"Old title {i % 3}", f"bridge ferry {'lamp ' * (i % 4)}", f"https://a.example/{i}", None, None) for i in range(20)], shape)
    store = SnapshotStore(spark, str(tmp_path))
    session = RetrievalSession(spark, store=store)
    session.publish(docs, "v1")
    changed = spark.createDataFrame([(3, "New harbour", "harbour lamp", None, None, None), (50, None, None, None, None, None), (51, "Ferry", "ferry ferry", None, None, None), (51, "Ferry", "ferry ferry", None, None, None), (None, "x", "y", None, None, None)], shape)
    one = session.upsert(changed)
    two = one.remove(spark.createDataFrame([(4, "x"), (51, "x"), (999, "x"), (None, "x")], "id long, scope string"))
    plain = [index.upserted(docs, changed.where("id is not null")).dropDuplicates(["id"])]
    plain.append(plain[0].where("id not in (4, 51)"))

    def tables(ix):
        rows = lambda df: sorted(map(tuple, df.collect()))
        return rows(ix.term_stats.select("scope", "term", "df")), rows(ix.postings.select("scope", "term", "id", "tf", "dl")), [(a, n, round(x, 9)) for a, n, x in rows(ix.scope_stats.select("scope", "n_docs", "avg_dl"))], rows(ix.docs.select("id", "title"))

    for got, want in zip((one, two), plain, strict=True):
        assert tables(got.index) == tables(index.lazy_index(want))
    assert store.active_version() == two.version and tables(store.load(two.version)) == tables(two.index)
    assert [r.document_id for r in two.search(two.batch([{"query": "harbour"}])).collect()] == [3]
    with_all_gone = two.remove(two.index.docs.select("id"))
    assert with_all_gone.index.scope_stats.count() == 0 and with_all_gone.search(two.batch([{"query": "harbour"}])).count() == 0
    scratch = RetrievalSession(spark, store.load("v1"), None, "v1").upsert(changed)
    assert tables(scratch.index) == tables(one.index)
    with pytest.raises(ValueError):
        store.publish_delta("v9", "none")
