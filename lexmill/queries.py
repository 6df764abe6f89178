"""The registered queries of the core, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html as html_functions
from .functions import stemming, urls
from .functions.hosts import document_host, host_of, matches_metadata, normalize_source, utc_date
from .functions.text import analyze, analyzer, clean_text, has_phrase, safe_message, snippet, strip, visible_characters
from .operators import crawl, evaluate, index, ingest, search
from .scratch import file_system, kept_path
from .sources import category_pages, feeds
from .sources import corpus as corpus_source
from .sources.snapshots import SnapshotStore
from .streaming.ingest import StreamIngest

#: The query batch of the retrieval queries (fixed values), in the words of the test tables: qid, query, ranking, scope.
BATCH = [
    (1, "nightly partition shuffle", "bm25", "all"), (2, "archive of the lighthouse", "bm25", "all"), (3, "slow link checkpoint", "bm25", "content"), (4, "harbour", "bm25", "title"),
    (5, "query query tokenizer", "bm25", "all"), (6, "regional archive", "tfidf", "all"), (7, "crawl log frontier", "tfidf", "content"), (8, "notes on the ledger", "tfidf", "title"),
    (9, "zzzz unknownterm", "bm25", "all"),
]
PHRASES = [(1, "slow link", "content"), (2, "notes on the", "title"), (3, "regional archive", "all"), (4, "inside the nightly job", "all"), (5, "archive regional", "all")]
FIRST, LAST = dt.date(2024, 3, 1), dt.date(2024, 9, 30)
SOURCE = "example"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark, sf_dir):
    return _table(spark, sf_dir, "indexed_documents")


def _index(spark, sf_dir) -> index.Index:
    return index.lazy_index(_raw(spark, sf_dir))


_published: dict[tuple, index.Index] = {}


def _store(spark, name: str) -> SnapshotStore:
    return SnapshotStore(spark, kept_path(spark, name))


def _written(spark, sf_dir) -> index.Index:
    """The index of the corpus, published to a store and loaded from it: once for each application and state of the table."""
    fs, where = file_system(spark, f"{sf_dir}/indexed_documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(where).getModificationTime())
    if key not in _published:
        store = _store(spark, "index")
        store.publish("whole", _raw(spark, sf_dir))
        _published[key] = store.load(store.active_version())
    return _published[key]


def _docs(spark, sf_dir):
    return index.clean_corpus(_raw(spark, sf_dir))


def _batch(spark, ranking: str | None = None, scope: str | None = None) -> DataFrame:
    rows = [r for r in BATCH if (ranking is None or r[2] == ranking) and (scope is None or r[3] == scope)]
    return spark.createDataFrame(rows, "qid long, query string, ranking string, scope string")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double"})


def _hits(found: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    return _rounded(search.ranked(found, limit, offset)).select("qid", "rank", "id", "score", F.array_join("matched_terms", " ").alias("matched_terms"))


def analyze_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.array_join(analyze(F.col("content")), " ").alias("tokens"))


def analyze_custom_stopwords(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.array_join(analyzer(("archive", "notes", "the"))(F.col("title")), " ").alias("tokens"))


def stem_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.array_join(stemming.stemming_analyzer()(F.col("content")), " ").alias("tokens"))


def doc_lengths(spark, sf_dir):
    return index.document_lengths(_index(spark, sf_dir).terms)


def scope_stats(spark, sf_dir):
    return _rounded(_index(spark, sf_dir).scope_stats)


def vocabulary_size(spark, sf_dir):
    return index.vocabulary(_index(spark, sf_dir).term_stats)


def term_frequencies(spark, sf_dir):
    return _index(spark, sf_dir).postings


def document_frequencies(spark, sf_dir):
    return _index(spark, sf_dir).term_stats


def idf_table(spark, sf_dir):
    from .operators.scoring import bm25_idf, tfidf_idf

    ix = _index(spark, sf_dir)
    n, df = F.col("n_docs").cast("double"), F.col("df").cast("double")
    return _rounded(ix.term_stats.join(F.broadcast(ix.scope_stats), "scope").select("scope", "term", "df", bm25_idf(n, df).alias("bm25_idf"), tfidf_idf(n, df).alias("tfidf_idf")))


def postings_for_term(spark, sf_dir):
    return _written(spark, sf_dir).postings.where("scope = 'all' and term = 'archive'").select("id", "tf", "dl").orderBy("id")


def postings_candidates(spark, sf_dir):
    ix = _written(spark, sf_dir)
    own = ix.docs.where(matches_metadata(F.col("source_host"), F.col("created_at"), SOURCE, FIRST, LAST)).select("id")
    return ix.postings.where("scope = 'content' and term = 'archive'").join(own, "id", "left_semi").select("id", "tf", "dl")


def bm25_top10(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25", "all")))


def bm25_title(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25", "title")))


def bm25_content(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25", "content")))


def bm25_custom_k1_b(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25"), k1=1.2, b=0.3))


def bm25_paged(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25")), 7, 5)


def bm25_total(spark, sf_dir):
    return search.totals(search.matches(_written(spark, sf_dir), _batch(spark)))


def bm25_full_scores(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "bm25")), None)


def tfidf_top10(spark, sf_dir):
    return _hits(search.matches(_written(spark, sf_dir), _batch(spark, "tfidf")))


def explain_bm25(spark, sf_dir):
    return _rounded(search.explained(_written(spark, sf_dir), _batch(spark, "bm25")))


def match_any(spark, sf_dir):
    return search.matches(_written(spark, sf_dir), _batch(spark)).select("qid", "id")


def phrase_match(spark, sf_dir):
    asked = spark.createDataFrame(PHRASES, "qid long, query string, scope string")
    rows = index.document_terms(_docs(spark, sf_dir), scopes=("title", "content"))
    both = rows.join(F.broadcast(asked.select("qid", F.col("scope").alias("asked"), analyze(F.col("query")).alias("run"))), F.expr("asked = 'all' or asked = scope"))  # five rows
    return both.where(has_phrase(F.col("terms"), F.col("run"))).select("qid", "id").distinct()


def phrase_bm25(spark, sf_dir):
    asked = spark.createDataFrame([(*p, True) for p in PHRASES], "qid long, query string, scope string, phrase boolean")
    return _hits(search.matches(_written(spark, sf_dir), asked))


def filter_source(spark, sf_dir):
    return _docs(spark, sf_dir).where(matches_metadata(F.col("source_host"), F.col("created_at"), SOURCE)).select("id", "source_host")


def filter_dates(spark, sf_dir):
    return _docs(spark, sf_dir).where(matches_metadata(F.col("source_host"), F.col("created_at"), None, FIRST, LAST)).select("id", utc_date(F.col("created_at")).cast("string").alias("day"))


def filter_combined(spark, sf_dir):
    return _docs(spark, sf_dir).where(matches_metadata(F.col("source_host"), F.col("created_at"), SOURCE, FIRST, LAST)).select("id")


def filtered_search(spark, sf_dir):
    q = _batch(spark).withColumns({"source": F.lit(SOURCE), "created_from": F.lit(FIRST), "created_to": F.lit(LAST)})
    return _hits(search.matches(_written(spark, sf_dir), q))


def source_hosts(spark, sf_dir):
    return _raw(spark, sf_dir).select("id", host_of(F.col("url")).alias("url_host"), normalize_source(F.col("source_host")).alias("given"), document_host(F.col("source_host"), F.col("url")).alias("host")).distinct()


def utc_dates(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy(utc_date(F.col("created_at")).cast("string").alias("day")).agg(F.count_distinct("id").alias("n"))


def snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", snippet(F.col("title"), F.col("content"), F.array(F.lit("archive"), F.lit("slow"))).alias("snippet"))


def search_page_enriched(spark, sf_dir):
    page = search.search(_written(spark, sf_dir), _batch(spark))
    return _rounded(page).withColumn("matched_terms", F.array_join("matched_terms", " "))


def _judged(spark, sf_dir):
    """Queries and judgments from the tables: for each source of documents its name is the query, its documents are relevant."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(strip(F.col("source"))).alias("name"), "text").where("name is not null and name <> ''")
    names = docs.select("name").distinct()
    queries = names.select(F.xxhash64("name").alias("qid"), "name", F.replace("name", F.lit("_"), F.lit(" ")).alias("query"))
    judgments = docs.select(F.xxhash64("name").alias("qid"), "id")
    body = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    both = F.explode(F.array(F.lit("bm25"), F.lit("tfidf")))
    keyed = queries.select("name", "query", both.alias("ranking"), F.col("qid").alias("of")).withColumn("qid", F.xxhash64("of", "ranking")).withColumn("scope", F.lit("content"))
    judged = keyed.select("qid", "of").join(judgments.withColumnRenamed("qid", "of"), "of").select("qid", "id")
    return index.lazy_index(body, scopes=("content",)), keyed, judged


def eval_queries(spark, sf_dir):
    ix, keyed, judged = _judged(spark, sf_dir)
    hits = search.ranked(search.matches(ix, keyed), 10)
    out = evaluate.query_metrics(hits, keyed, judged, 10).join(keyed.select("qid", "name"), "qid")
    return _rounded(out.drop("qid"))


def eval_summary(spark, sf_dir):
    ix, keyed, judged = _judged(spark, sf_dir)
    return _rounded(evaluate.summary(evaluate.query_metrics(search.ranked(search.matches(ix, keyed), 10), keyed, judged, 10)))


def latency_percentiles(spark, sf_dir):
    return _rounded(evaluate.latencies(_table(spark, sf_dir, "events"), "value", ["event_type"]))


def _payloads(spark, sf_dir):
    """Bulk items from crawl items: what a run would send, some without a title, some with an extra field."""
    rows = _table(spark, sf_dir, "crawl_items").select("id", "job_id", "position", "title", "canonical_url", "error", "embedded_content").distinct()
    body = F.to_json(F.struct("title", F.coalesce("embedded_content", "title").alias("content"), F.col("canonical_url").alias("url"), "error"))
    return rows.select("job_id", "position", "id", body.alias("payload"))


def ingest_validated(spark, sf_dir):
    return ingest.validated(_payloads(spark, sf_dir)).drop("payload")


def ingest_classified(spark, sf_dir):
    docs = _table(spark, sf_dir, "document_responses").select("id", "url")
    done = ingest.classified(ingest.validated(_payloads(spark, sf_dir)), docs, ["job_id", "position", "id"])
    return done.select("job_id", "position", "id", "url", "error", "status")


def ingest_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "document_responses").select("id", "url")
    return ingest.status_counts(ingest.classified(ingest.validated(_payloads(spark, sf_dir)), docs, ["job_id", "position", "id"]), ["job_id"])


def ingest_first_wins(spark, sf_dir):
    items = _table(spark, sf_dir, "crawl_items").select("job_id", "canonical_url", "position", "id")
    return feeds.first_wins(items, "canonical_url", ["job_id", "position", "id"])


def active_page(spark, sf_dir):
    docs = _table(spark, sf_dir, "document_responses").distinct()
    return corpus_source.active_page(docs, 50, 100).select("id", "title", "url")


def soft_delete_view(spark, sf_dir):
    docs = _table(spark, sf_dir, "document_responses").distinct()
    gone = _table(spark, sf_dir, "crawl_items").where("fetch_status = 'failed' or title is null").select(F.col("document_id").alias("id")).where("id is not null")
    return corpus_source.soft_deleted(docs, gone).groupBy("status").agg(F.count("*").alias("n"))


def patched_view(spark, sf_dir):
    """Every crawled document gets the crawl's title if there is one, and loses its address where the crawl had none."""
    docs = _table(spark, sf_dir, "document_responses").distinct()
    newest = _table(spark, sf_dir, "crawl_items").where("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(F.max("title").alias("title"), F.max("discovered_url").alias("url"))
    changes = newest.select("id", "title", F.lit(None).cast("string").alias("content"), "url", F.col("title").isNotNull().alias("has_title"), F.lit(False).alias("has_content"), F.lit(True).alias("has_url"))
    return corpus_source.with_changes(docs, changes).select("id", "title", "url", "status")


def upsert_view(spark, sf_dir):
    """The indexed corpus with the crawled documents put in its place where ids meet."""
    docs = _docs(spark, sf_dir).select("id", "title", "content", "url")
    changed = index.clean_corpus(_table(spark, sf_dir, "document_responses")).select("id", "title", "content", "url")
    return index.upserted(docs, changed).select("id", "title", F.length("content").cast("long").alias("chars"))


def remove_doc_stats(spark, sf_dir):
    gone = _raw(spark, sf_dir).where("created_at is null").select("id")
    return _rounded(index.scope_stats(index.document_terms(index.removed(_docs(spark, sf_dir), gone))))


def visible_counts(spark, sf_dir):
    c = F.col("content")
    return _docs(spark, sf_dir).select("id", visible_characters(c).cast("long").alias("visible"), clean_text(c, True).alias("clean"), safe_message(c, 80).alias("message"))


def _links(spark, sf_dir):
    """A graph of categories: regions below the root, nations below regions, market segments of nations below these; suppliers and customers are pages."""
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    customer, supplier = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows

    def rows(df, parent, kind, position, page, title):
        return df.select(parent.alias("parent"), F.lit(kind).alias("kind"), position.cast("long").alias("position"), page.cast("long").alias("page_id"), title.alias("title"))

    none = F.lit(None).cast("long")
    nation_of = F.broadcast(nation.select("n_nationkey", "n_name"))  # 25 rows
    return (
        rows(region, F.lit("root"), "category", F.col("r_regionkey"), none, F.col("r_name"))
        .union(rows(named, F.col("r_name"), "category", F.col("n_nationkey"), none, F.col("n_name")))
        .union(rows(supplier.join(nation_of, F.col("s_nationkey") == F.col("n_nationkey")), F.col("n_name"), "page", F.col("s_suppkey"), F.col("s_suppkey"), F.col("s_name")))
        .union(rows(customer.join(nation_of, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct(), F.col("n_name"), "category", F.length("c_mktsegment"), none, F.concat("n_name", F.lit("/"), "c_mktsegment")))
    )


def crawl_bfs(spark, sf_dir):
    return crawl.discover(_links(spark, sf_dir), "root", 2, 100_000, 500)[0].select("title", "depth")


def crawl_bfs_pages(spark, sf_dir):
    return crawl.discover(_links(spark, sf_dir), "root", 2, 100_000, 500)[1]


def crawl_capped(spark, sf_dir):
    items = _table(spark, sf_dir, "crawl_items").distinct()
    return crawl.capped(items, _table(spark, sf_dir, "crawl_runs").select("job_id", "max_articles"))


def _outcomes(spark, sf_dir):
    """Ingestion outcomes of the fetched items: imported where a document came of it, else skipped, or failed where there is no title."""
    rows = _table(spark, sf_dir, "crawl_items").where("ingestion_item_id is not null").select("ingestion_item_id", "document_id", "title").distinct()
    status = F.when(F.col("document_id").isNotNull(), "imported").when(F.col("title").isNull(), "failed").otherwise("skipped")
    return rows.select("ingestion_item_id", status.alias("status"), F.when(status == "skipped", "duplicate_url").when(status == "failed", "title: Field required").alias("error"))


def crawl_counts(spark, sf_dir):
    return crawl.crawl_counts(_table(spark, sf_dir, "crawl_items").distinct(), _outcomes(spark, sf_dir))


def crawl_item_report(spark, sf_dir):
    return crawl.item_report(_table(spark, sf_dir, "crawl_items").distinct(), _outcomes(spark, sf_dir))


def next_positions(spark, sf_dir):
    return crawl.next_positions(_table(spark, sf_dir, "crawl_items"))


def _frontier(spark, sf_dir):
    return _table(spark, sf_dir, "crawl_items").distinct().select("id", "job_id", F.col("fetch_attempts").alias("depth"), F.when(F.col("fetch_status") == "fetched", "completed").otherwise(F.col("fetch_status")).alias("status"), F.col("source_item_id").alias("continuation"))


def pending_frontier(spark, sf_dir):
    return crawl.next_frontier(_frontier(spark, sf_dir))


def has_pending(spark, sf_dir):
    return crawl.has_pending(_frontier(spark, sf_dir))


def categories_visited(spark, sf_dir):
    return crawl.categories_visited(_frontier(spark, sf_dir))


def crawl_checkpoint(spark, sf_dir):
    """The items of all runs as one step's findings, against the addresses that documents already have."""
    found = _table(spark, sf_dir, "crawl_items").select("canonical_url", "job_id", F.col("position").alias("at"), "id")
    have = _table(spark, sf_dir, "document_responses").where("url is not null").select(F.col("url").alias("canonical_url"), F.col("id").alias("position")).distinct()
    return crawl.checkpoint(found, have, "canonical_url", None, ["job_id", "at", "id"]).select("canonical_url", "id", "position")


def job_progress(spark, sf_dir):
    items = _table(spark, sf_dir, "crawl_items").distinct().groupBy("job_id").agg(F.count_if(F.col("fetch_status") != "pending").alias("current"), F.count("*").alias("total"))
    return items.select("job_id", "current", "total", ingest.progress(F.col("current"), F.col("total")).alias("percentage"))


def canonical_urls(spark, sf_dir):
    u = F.col("discovered_url")
    return _table(spark, sf_dir, "crawl_items").select("id", urls.canonical_urls(u, "medium").alias("medium"), urls.canonical_urls(u, "rss").alias("rss")).distinct()


def wikipedia_urls(spark, sf_dir):
    return _table(spark, sf_dir, "fetched_wikipedia_articles").select("page_id", urls.article_url(F.col("title")).alias("url"), urls.category_title(F.col("title")).alias("category")).distinct()


def publication_scope(spark, sf_dir):
    """Items against their run's publication, once on its own host, once as if that were the main host, with its path as section."""
    u, seed = F.col("discovered_url"), F.col("seed_url")
    rows = _table(spark, sf_dir, "crawl_items").join(_table(spark, sf_dir, "crawl_runs").select("job_id", "seed_url"), "job_id")
    origin, path = F.regexp_extract(seed, "^(https://[^/]+)", 1), F.regexp_extract(seed, "^https://[^/]+(/[^/]*)", 1)
    on_main = F.regexp_replace(u, "^https://[^/]+", "https://medium.com")
    return rows.select(
        "id", urls.same_origin(u, seed).alias("same_origin"), urls.in_publication(u, origin, path).alias("own"), urls.in_publication(on_main, "https://medium.com", path).alias("section"),
    ).distinct()


def extract_wiki(spark, sf_dir):
    pages = _table(spark, sf_dir, "fetched_wikipedia_articles").select(F.col("page_id").alias("id"), "html")
    return html_functions.extract_encyclopedia(pages).distinct()


def extract_article(spark, sf_dir):
    pages = _table(spark, sf_dir, "fetched_wikipedia_articles").select(F.col("page_id").alias("id"), "html", F.col("canonical_url").alias("url"))
    return html_functions.extract_articles(pages).distinct()


def _feeds(spark, sf_dir):
    """A feed of each crawl run from its items."""
    rows = _table(spark, sf_dir, "crawl_items").distinct()

    def safe(c):
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    item = F.concat(F.lit("<item><title>"), safe(F.col("title")), F.lit("</title><link>"), safe(F.col("discovered_url")), F.lit("</link><guid>"), safe(F.col("source_item_id")), F.lit("</guid></item>"))
    per = rows.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("position", item.alias("x")))).alias("items"))
    runs = per.join(_table(spark, sf_dir, "crawl_runs").select("job_id", "batch_no", "seed_url"), "job_id")
    return runs.select(F.col("batch_no").alias("feed_id"), F.concat(F.lit("<rss><channel>"), F.array_join("items.x", ""), F.lit("</channel></rss>")).alias("xml"), F.col("seed_url").alias("url"))


def parse_feed(spark, sf_dir):
    return feeds.parse_feeds(_feeds(spark, sf_dir), "rss")


def parse_sitemap(spark, sf_dir):
    """A sitemap of each run and hundred positions, those of odd batches as lists of sitemaps, one broken."""
    rows = _table(spark, sf_dir, "crawl_items").select("job_id", "position", "discovered_url").distinct().join(_table(spark, sf_dir, "crawl_runs").select("job_id", "batch_no"), "job_id")
    safe = F.replace(F.replace("discovered_url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number = F.col("batch_no") * 1000 + F.floor(F.col("position") / 100)
    per = rows.groupBy(number.alias("feed_id"), "batch_no").agg(F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("<loc> "), safe, F.lit(" </loc>")).alias("x")))).alias("items"))  # a hundred
    odd = F.col("batch_no") % 2 == 1
    tag = F.when(odd, "sitemapindex").otherwise("urlset")
    close = F.when(F.col("feed_id") == 2000, "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    maps = per.select("feed_id", F.concat(F.lit('<'), tag, F.lit(' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("items.x", ""), close).alias("xml"))
    return feeds.parse_sitemaps(maps).select("feed_id", "kind", "url", "error")


def category_members(spark, sf_dir):
    """The members of all categories, from answers of fifty each as the service would give them."""
    from pyspark.sql import Window

    rows = _links(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("parent").orderBy("kind", "position", "title")) - 1)
    member = F.struct(F.coalesce("page_id", "at").cast("long").alias("pageid"), F.when(F.col("kind") == "page", 0).otherwise(14).alias("ns"), "title")
    other = F.struct(F.lit(9).cast("long").alias("pageid"), F.lit(2).alias("ns"), F.lit("User:x").alias("title"))
    per = rows.groupBy("parent", F.floor(F.col("at") / 50).alias("number")).agg(F.sort_array(F.collect_list(F.struct("at", member.alias("m")))).alias("x"))  # fifty
    body = F.to_json(F.struct(F.struct(F.concat(F.array(other), F.col("x.m")).alias("categorymembers")).alias("query")))
    found = category_pages.category_links(per.select("parent", "number", body.alias("body")))
    return found.select("parent", "kind", "title", (F.floor(F.col("position") / 1_000_000) * 50 + F.col("position") % 1_000_000 - 1).alias("at"))


def point_lookup(spark, sf_dir):
    return corpus_source.point(_table(spark, sf_dir, "document_responses").distinct(), 7).select("id", "title", "content", "url", "status")


def imported_documents(spark, sf_dir):
    docs = _table(spark, sf_dir, "document_responses").select("id", "url")
    order = ["job_id", "position", "id"]
    done = ingest.classified(ingest.validated(_payloads(spark, sf_dir)), docs, order).withColumnRenamed("id", "item_id")
    return ingest.imported_documents(done, docs, ["job_id", "position", "item_id"])


def staged_items(spark, sf_dir):
    """Items sent in envelopes of a hundred of a run, taken apart again."""
    rows = _payloads(spark, sf_dir).withColumn("part", F.floor(F.col("position") / 100))
    per = rows.groupBy("job_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "id", "payload"))).alias("x"))  # a hundred
    envelopes = per.select(F.concat("job_id", F.lit("/"), F.col("part").cast("string")).alias("job_id"), F.concat(F.lit('{"documents": ['), F.array_join("x.payload", ","), F.lit("]}")).alias("body"))
    return ingest.validated(ingest.staged(envelopes)).select("job_id", "position", "title", "url", "error")


def pending_items(spark, sf_dir):
    """Fetched items whose ingestion waits: those of whose item no document came."""
    items = _table(spark, sf_dir, "crawl_items").distinct()
    waiting = items.where("ingestion_item_id is not null and document_id is null").select("ingestion_item_id", F.lit("pending").alias("status")).distinct()
    return crawl.pending_ingestion(items, waiting)


def frontier_lookup(spark, sf_dir):
    """The first item of each run, found by its locator."""
    rows = _table(spark, sf_dir, "crawl_items").distinct().select("id", "job_id", F.col("canonical_url").alias("locator"), "position")
    asked = rows.where("position = 0").select("job_id", "locator")
    return crawl.located(rows, asked).select("id", "job_id", "locator")


def json_corpus(spark, sf_dir):
    """The corpus written as JSON files of two hundred documents, and read again."""
    docs = _docs(spark, sf_dir).select("id", "title", "content", "url")
    per = docs.groupBy(F.floor(F.col("id") / 200).alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "title", "content", "url")).alias("documents")), {"ignoreNullFields": "false"}).alias("value"))  # two hundred
    path = kept_path(spark, "json")
    per.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return corpus_source.read_corpus(spark, path).select("id", "title", "content", "url")


def index_status(spark, sf_dir):
    return _written(spark, sf_dir).status


def index_upsert(spark, sf_dir):
    """Term statistics after the crawled documents were put into the written index as a delta version."""
    return _delta(spark, sf_dir, index.clean_corpus(_table(spark, sf_dir, "document_responses")), None).term_stats


def index_removed_top10(spark, sf_dir):
    """Hits after documents without a date were taken out of the written index by a delta version."""
    gone = _raw(spark, sf_dir).where("created_at is null").select("id")
    return _hits(search.matches(_delta(spark, sf_dir, None, gone), _batch(spark)))


def _delta(spark, sf_dir, changed, gone) -> index.Index:
    path = kept_path(spark, "delta")
    index.write_delta(_written(spark, sf_dir), path, changed, gone)
    return index.with_delta(_written(spark, sf_dir), path)


def stream_ingest(spark, sf_dir):
    """The same items as ``imported_documents``, from a stream of envelopes of a hundred items of a run, in one micro-batch beside the documents there are."""
    rows = _payloads(spark, sf_dir).withColumn("part", F.floor(F.col("position") / 100))
    per = rows.groupBy("job_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "id", "payload"))).alias("x"))  # a hundred
    path = kept_path(spark, "stream")
    job = F.concat("job_id", F.lit("/"), F.lpad(F.col("part").cast("string"), 9, "0"))
    per.select(job.alias("job_id"), F.concat(F.lit('{"documents": ['), F.array_join("x.payload", ","), F.lit("]}")).alias("body")).write.parquet(f"{path}/in")
    before = _table(spark, sf_dir, "document_responses").select("id", "title", "content", "url", "status").distinct()
    before.withColumn("batch", F.lit(-1)).write.partitionBy("batch").parquet(f"{path}/out/documents")
    stream = StreamIngest(spark, f"{path}/out")
    stream.start(spark.readStream.schema("job_id string, body string").parquet(f"{path}/in")).awaitTermination()
    return stream.documents(but=-1).select("id", "title", "url", "status")


def embedded_pages(spark, sf_dir):
    return _table(spark, sf_dir, "crawl_items").select("id", feeds.embedded_page(F.col("title"), F.col("canonical_url"), F.col("embedded_content")).alias("html")).distinct()


def synthetic_corpus(spark, sf_dir):
    n = _table(spark, sf_dir, "indexed_documents").agg(F.count_distinct("id")).first()[0]
    return _rounded(index.lazy_index(corpus_source.synthetic_corpus(spark, n)).scope_stats)


_NAMES = (
    analyze_tokens, analyze_custom_stopwords, stem_tokens, doc_lengths, scope_stats, vocabulary_size, term_frequencies, document_frequencies, idf_table, postings_for_term, postings_candidates,
    bm25_top10, bm25_title, bm25_content, bm25_custom_k1_b, bm25_paged, bm25_total, bm25_full_scores, tfidf_top10, explain_bm25, match_any, phrase_match, phrase_bm25, filter_source, filter_dates,
    filter_combined, filtered_search, source_hosts, utc_dates, snippets, search_page_enriched, eval_queries, eval_summary, latency_percentiles, ingest_validated, ingest_classified, ingest_counts,
    ingest_first_wins, active_page, soft_delete_view, patched_view, upsert_view, remove_doc_stats, visible_counts, crawl_bfs, crawl_bfs_pages, crawl_capped, crawl_counts, crawl_item_report,
    next_positions, pending_frontier, has_pending, categories_visited, crawl_checkpoint, job_progress, canonical_urls, wikipedia_urls, publication_scope, extract_wiki, extract_article, parse_feed,
    embedded_pages, synthetic_corpus, parse_sitemap, category_members, point_lookup, imported_documents, staged_items, pending_items, frontier_lookup, json_corpus, index_status, index_upsert,
    index_removed_top10, stream_ingest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}
