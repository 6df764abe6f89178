import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate, index, search
from lexmill.operators.scoring import bm25
from lexmill.plans.session import RetrievalSession
from lexmill.sources.corpus import synthetic_corpus
from lexmill.sources.snapshots import SnapshotStore

DOC = "id long, title string, content string, url string, source_host string, created_at timestamp"
STOP = {"the", "of"}


def tokens(s):
    out, word = [], ""
    for ch in (s or "").lower() + " ":
        if ch.isascii() and ch.isalnum():
            word += ch
        else:
            if word and word not in {"a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"}:
                out.append(word)
            word = ""
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["search", "engine", "index", "rank", "the", "term", "of", "query", "x1", "é"]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(0, 3))), None if i == 7 else " ".join(rng.choices(words, k=rng.randint(0, 30))), None, "a.example" if i % 2 else None, None))
    rows.append(rows[3])  # a repeated row
    return rows


def brute(rows, query, scope, ranking, k1=1.5, b=0.75):
    docs = {}
    for r in rows:
        t, c = tokens(r[1]), tokens(r[2])
        docs[r[0]] = {"all": t + t + c, "title": t, "content": c}[scope]
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    scores = {}
    for i, d in docs.items():
        tf = Counter(d)
        hit = [t for t in tokens(query) if tf[t]]
        if hit:
            if ranking == "bm25":
                scores[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / avg)) for t in hit)
            else:
                scores[i] = sum(tf[t] / len(d) * (math.log((1 + n) / (1 + df[t])) + 1) for t in hit)
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_two_documents(spark):
    df = spark.createDataFrame([(1, "Python Search", "python search search"), (2, "Java Search", "java search engine")], "id long, title string, content string")
    ix = index.lazy_index(df)
    tf = {(r.scope, r.term, r.id): (r.tf, r.dl) for r in ix.postings.collect()}
    assert tf["all", "search", 1] == (4, 7) and tf["content", "search", 1] == (2, 3) and ("title", "engine", 2) not in tf
    stats = {r.scope: (r.n_docs, r.avg_dl) for r in ix.scope_stats.collect()}
    assert stats == {"all": (2, 7.0), "title": (2, 2.0), "content": (2, 3.0)}


@pytest.mark.parametrize(("query", "scope", "ranking"), [("search engine", "all", "bm25"), ("search search the term", "content", "bm25"), ("index", "title", "bm25"), ("query rank x1", "all", "tfidf"), ("nothing here", "all", "bm25")])
def test_ranking_equals_brute_force(spark, corpus, query, scope, ranking):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    found = search.matches(session.index, session.batch([{"query": query, "scope": scope, "ranking": ranking}]))
    got = [(r.id, round(r.score, 9)) for r in search.ranked(found, None).orderBy("rank").collect()]
    want = [(i, round(s, 9)) for i, s in brute(corpus, query, scope, ranking)]
    assert got == want
    page = [r.id for r in search.ranked(found, 3, 2).orderBy("rank").collect()]
    assert page == [i for i, _ in want[2:5]]
    assert [r.total_results for r in search.totals(found).collect()] == ([len(want)] if want else [])


def test_explain_sums_to_score(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    (best, score), *_ = brute(corpus, "search search rank", "all", "bm25")
    rows = session.explain("search search rank", best).collect()
    assert abs(sum(r.contribution for r in rows) - score) < 1e-9
    with pytest.raises(KeyError):
        session.explain("search", 10_000)


def test_filters_and_phrase(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    q = session.batch([{"query": "search engine", "source": "example", "phrase": True}, {"query": "search engine"}])
    got = {}
    for r in search.matches(session.index, q).collect():
        got.setdefault(r.qid, {})[r.id] = r.score
    everything = dict(brute(corpus, "search engine", "all", "bm25"))
    assert {i: round(s, 9) for i, s in got[1].items()} == {i: round(s, 9) for i, s in everything.items()}

    def run(ts):
        return any(ts[k : k + 2] == ["search", "engine"] for k in range(len(ts)))

    want = {r[0] for r in corpus if r[4] and (run(tokens(r[1])) or run(tokens(r[2])))}
    assert set(got.get(0, {})) == want and all(abs(got[0][i] - everything[i]) < 1e-9 for i in want)


def test_guards(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    for bad in ({"query": " "}, {"query": "x", "scope": "body"}, {"query": "x", "ranking": "pagerank"}):
        with pytest.raises(ValueError):
            session.search(session.batch([bad]))
    with pytest.raises(ValueError):
        session.search_page("x", limit=51)
    with pytest.raises(ValueError):
        search.ranked(spark.createDataFrame([], "qid long, id long, score double"), 10, -1)
    page, total = session.search_page("search engine", 5)
    assert page.count() == 5 and total.first()[0] == len(brute(corpus, "search engine", "all", "bm25"))


def test_empty_corpus(spark):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame([], DOC))
    assert session.search(session.batch([{"query": "search"}])).count() == 0
    assert session.index.scope_stats.count() == 0


def test_literal_and_joined_terms_agree(spark, corpus, monkeypatch):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    q = session.batch([{"query": "search engine term"}, {"query": "index", "scope": "title"}])
    one = sorted((r.qid, r.id, round(r.score, 9)) for r in search.matches(session.index, q).collect())
    monkeypatch.setattr(search, "LITERAL_TERMS", 0)
    assert one == sorted((r.qid, r.id, round(r.score, 9)) for r in search.matches(session.index, q).collect())
    monkeypatch.setattr(search, "LITERAL_QUERIES", 0)
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 0)
    assert one == sorted((r.qid, r.id, round(r.score, 9)) for r in search.matches(session.index, q).collect())


def test_equal_queries_and_long_ones(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    many = " ".join(f"w{i}" for i in range(80)) + " search index"
    q = session.batch([{"query": "search engine"}, {"query": "search engine"}, {"query": "search engine", "scope": "title"}, {"query": many}])
    pages = {}
    for r in session.search(q, 5).orderBy("qid", "rank").collect():
        pages.setdefault(r.qid, []).append((r.document_id, round(r.score, 9), tuple(r.matched_terms)))
    assert pages[0] == pages[1] != pages[2]
    assert [p[:2] for p in pages[0]] == [(i, round(s, 9)) for i, s in brute(corpus, "search engine", "all", "bm25")[:5]]
    assert [p[:2] for p in pages[3]] == [(i, round(s, 9)) for i, s in brute(corpus, many, "all", "bm25")[:5]]
    assert set(pages[3][0][2]) <= {"search", "index"}


def test_custom_scorer(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    q = session.batch([{"query": "search", "ranking": "flat"}])
    scores = {r.score for r in search.matches(session.index, q, extra={"flat": lambda tf, df, dl, n, avg: tf * 0 + 1.0}).collect()}
    assert scores == {1.0} and bm25 is not None


def test_snapshots(spark, corpus, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "index"))
    session = RetrievalSession(spark, store=store)
    assert session.sync() is False
    docs = spark.createDataFrame(corpus, DOC)
    first = session.publish(docs, "v1")
    q = session.batch([{"query": "search engine"}])
    got = [(r.document_id, round(r.score, 9)) for r in session.search(q, 5).orderBy("rank").collect()]
    assert got == [(i, round(s, 9)) for i, s in brute(corpus, "search engine", "all", "bm25")[:5]] and first == "v1"
    with pytest.raises(ValueError):
        store.publish("v1", docs)
    boom = docs.withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.publish("v2", boom)
    assert store.active_version() == "v1" and store.load("v2") is None and session.sync() is False
    other = RetrievalSession(spark, store=store)
    session.publish(docs.where("id < 10"), "v3")
    assert other.sync() and other.version == "v3" and other.index.status.first()[0] == 10
    plan = other.index.narrowed(["all"], ["search"])[0]._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,search)" in plan
    (tmp_path / "index/version=v3/FORMAT").write_text('{"format_version": 2}')
    (tmp_path / "index/version=v3/.FORMAT.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        store.load("v3")


def test_upsert_and_remove(spark, corpus):
    session = RetrievalSession.from_documents(spark, spark.createDataFrame(corpus, DOC))
    changed = session.upsert(spark.createDataFrame([(3, "Search", "search", None, None, None), (99, "New", "search", None, None, None)], DOC))
    assert changed.index.status.first()[0] == 41 and changed.index.docs.where("id = 3").first().content == "search"
    fewer = session.remove(spark.createDataFrame([(3,), (3,), (4,)], "id long"))
    assert fewer.index.status.first()[0] == 38


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "qid long, id long, rank long")
    queries = spark.createDataFrame([(1, "bm25"), (2, "bm25"), (3, "bm25"), (4, "bm25")], "qid long, ranking string")
    judged = spark.createDataFrame([(1, 11), (1, 99), (2, 21), (3, 5), (1, 11)], "qid long, id long")
    got = {r.qid: (round(r.precision, 6), r.recall, r.reciprocal_rank) for r in evaluate.query_metrics(hits, queries, judged, 3).collect()}
    assert got == {1: (0.333333, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    mean = evaluate.summary(evaluate.query_metrics(hits, queries, judged, 3)).first()
    assert mean.queries == 3 and abs(mean.mrr - 0.5 / 3) < 1e-9
    with pytest.raises(ValueError):
        evaluate.query_metrics(hits, queries, judged, 0)


def test_session_evaluate(spark):
    docs = spark.createDataFrame([(1, "bridge", "old bridge of stone"), (2, "ferry", "ferry and harbour"), (3, "mill", "mill at the bridge")], "id long, title string, content string")
    session = RetrievalSession.from_documents(spark, docs)
    queries = spark.createDataFrame([(1, "bridge"), (2, "ferry")], "qid long, query string")
    judged = spark.createDataFrame([(1, 1), (2, 2)], "qid long, id long")
    rows = {r.ranking: r for r in session.evaluate(queries, judged, 1).collect()}
    assert rows["bm25"].mrr == 1.0 and rows["tfidf"].mean_recall == 1.0


def test_latencies(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(None,)], "v double")
    r = evaluate.latencies(df, "v").first()
    assert (r.median, r.p95, r.max) == (10.5, 19.0, 20.0)


def test_synthetic(spark):
    assert synthetic_corpus(spark, 5).where("content like '%number 4 with%'").count() == 1
