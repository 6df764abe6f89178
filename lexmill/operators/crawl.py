"""Crawl planning on tables: bounded breadth-first discovery, deduplication against known pages, limits, counts and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.local import local_table
from ..sources.feeds import first_wins
from .numbering import numbered


@dataclass(frozen=True)
class Discovery:
    """categories (title, depth, number, status, error), pages, and one row of flags.

    status: completed (all members taken), failed (an answer of it is missing; the first error says why), or pending (discovery ended before all
    its members were taken: what a later run goes on with). flags: complete (ended, and nothing failed), article_limit_reached,
    category_limit_reached.
    """

    categories: DataFrame
    pages: DataFrame
    flags: DataFrame


def discover(
    links: DataFrame, root: str, max_depth: int = 2, max_pages: int = 500, max_categories: int = 200
) -> tuple[DataFrame, DataFrame]:
    """Categories (title, depth, number) and pages (position, page_id, title) reached from ``root``; see ``discovered``."""
    found = discovered(links, root, max_depth, max_pages, max_categories)
    return found.categories.select("title", "depth", "number"), found.pages


def discovered(
    links: DataFrame, root: str, max_depth: int = 2, max_pages: int = 500, max_categories: int = 200, errors: DataFrame | None = None
) -> Discovery:
    """Categories (title, depth, number) and pages (position, page_id, title) reached from ``root``, breadth first.

    links: parent, kind (category or page), position, page_id, title. A level's categories are visited in order of discovery, their members by
    position. Categories count once by title, the root included, pages once by id; categories beyond the limit are left out
    while pages are still taken, and pages beyond theirs end discovery: categories seen behind the last page aren't added. Links to pages with null ids and
    to null titles are ignored. ``errors`` (parent, number, error): answers that are missing. Each level is one join of the links with a frontier of at most ``max_categories`` rows; there are
    at most ``max_depth`` + 1 levels.
    """
    if max_depth < 0 or max_pages < 1 or max_categories < 1:
        raise ValueError("limits must be positive")
    spark = links.sparkSession
    cats = links.where("kind = 'category' and title is not null and parent is not null").select("parent", "position", "title")
    leaves = links.where("kind = 'page' and page_id is not null and parent is not null").select("parent", "position", "page_id", "title")
    known: list[tuple[str, int, int]] = [(root, 0, 0)]
    level = known
    pages = None
    taken, crowded, last = 0, False, None
    for depth in range(max_depth + 1):
        frontier = F.broadcast(spark.createDataFrame([(t, n) for t, _, n in level], "parent string, number long"))  # at most max_categories rows
        here = leaves.join(frontier, "parent").select("number", "position", "page_id", "title")
        here = first_wins(here, "page_id", ["number", "position"])
        if pages is not None:
            here = here.join(F.broadcast(pages.select("page_id")), "page_id", "left_anti")  # at most max_pages rows
        rows = here.orderBy("number", "position", "page_id").limit(max_pages - taken).select("number", "position", "page_id", "title").collect()  # at most max_pages
        new = [(taken + i, r["page_id"], r["title"]) for i, r in enumerate(rows)]
        kept = spark.createDataFrame(new, "position long, page_id long, title string")
        pages = kept if pages is None else pages.union(kept)
        taken += len(new)
        full = taken >= max_pages
        last = rows[-1]["number"] if full and rows else None
        if depth == max_depth or full and last is None:
            break
        below = cats.join(frontier, "parent")
        if full:
            below = below.where(F.col("number") < last)  # a category at whose pages the limit is met adds nothing
        titles = F.broadcast(spark.createDataFrame([(t,) for t, _, _ in known], "title string"))
        fresh = first_wins(below.select("number", "position", "title"), "title", ["number", "position"]).join(titles, "title", "left_anti")
        found = fresh.orderBy("number", "position", "title").limit(max_categories - len(known) + 1).collect()  # at most max_categories + 1
        room = max_categories - len(known)
        crowded = crowded or len(found) > room
        level = [(r["title"], depth + 1, len(known) + i) for i, r in enumerate(found[:room])]
        known += level
        if full or not level:
            break
    # members of the category at whose pages the limit was met may be left, and later ones weren't read
    ended = taken >= max_pages
    cut = last if last is not None else len(known)
    failed = {r["parent"]: r["error"] for r in _first_errors(errors, known).collect()} if errors is not None else {}  # at most max_categories rows
    rows = [(t, d, n, "failed" if t in failed else "pending" if ended and n >= cut else "completed", failed.get(t)) for t, d, n in known]
    return Discovery(
        local_table(spark, rows, "title string, depth long, number long, status string, error string"), pages,
        local_table(spark, [(not failed, ended, crowded)], "complete boolean, article_limit_reached boolean, category_limit_reached boolean"),
    )


def _first_errors(errors: DataFrame, known: list[tuple[str, int, int]]) -> DataFrame:
    titles = F.broadcast(local_table(errors.sparkSession, [(t,) for t, _, _ in known], "parent string"))  # at most max_categories rows
    return errors.join(titles, "parent").groupBy("parent").agg(F.min_by("error", "number").alias("error"))


def checkpoint(found: DataFrame, existing: DataFrame, key: str, most: int | None, order: list[str]) -> DataFrame:
    """Of the items found in a step those that are new to the run, at most ``most`` with the existing ones (None: all), with their positions.

    found: key and order columns; existing: key, position. Items known already, repeated ones and null keys are left out; positions go on
    behind the greatest there is.
    """
    new = first_wins(found, key, order).join(existing.select(key).distinct(), key, "left_anti")
    stats = existing.agg(F.count_distinct(key).alias("n"), F.coalesce(F.max("position") + 1, F.lit(0)).alias("next")).first()
    top = new if most is None else new.orderBy(*order, key).limit(max(0, most - stats["n"]))
    return numbered(top, [*order, key], stats["next"], "position")


def next_positions(items: DataFrame, by: str = "job_id") -> DataFrame:
    """(job, next_position): one more than the greatest position."""
    return items.groupBy(by).agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("next_position"))


def capped(items: DataFrame, runs: DataFrame) -> DataFrame:
    """The items of each run up to its max_articles, first by position, each canonical_url once. items: job_id, position, id, canonical_url; runs: job_id, max_articles."""
    once = first_wins(items.select("job_id", "canonical_url", "position", "id"), "canonical_url", ["position", "id"], ["job_id"])
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("position", "id"))
    most = runs.agg(F.max("max_articles")).first()[0] or 0  # as a literal it lets each task keep only so many rows of a run
    return once.withColumn("n", rank).where(F.col("n") <= most).join(runs.select("job_id", "max_articles"), "job_id").where("n <= max_articles").select("job_id", "position", "id", "canonical_url", F.col("n").cast("long").alias("n"))


def crawl_counts(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts of each run: discovered, fetched, imported, skipped, fetch_failed, ingestion_failed, failed, terminal.

    items: job_id, id, fetch_status, ingestion_item_id; outcomes: ingestion_item_id, status. One pass behind a left join.
    """
    rows = items.join(outcomes.select("ingestion_item_id", "status"), "ingestion_item_id", "left")
    counts = rows.groupBy("job_id").agg(
        F.count("id").alias("discovered"), F.count_if(F.col("fetch_status") == "fetched").alias("fetched"), F.count_if(F.col("status") == "imported").alias("imported"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("fetch_status") == "failed").alias("fetch_failed"), F.count_if(F.col("status") == "failed").alias("ingestion_failed"),
    )
    failed = F.col("fetch_failed") + F.col("ingestion_failed")
    return counts.withColumn("failed", failed).withColumn("terminal", failed + F.col("imported") + F.col("skipped"))


def item_report(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each item with its outcome, and the fetch error or else the ingestion error."""
    right = outcomes.select("ingestion_item_id", F.col("status").alias("ingestion_status"), F.col("error").alias("ingestion_error"))
    return items.join(right, "ingestion_item_id", "left").select(
        "job_id", "position", "id", "canonical_url", "fetch_status", "ingestion_status", "document_id", F.coalesce("error", "ingestion_error").alias("error")
    )


def pending_ingestion(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fetched items whose ingestion is still pending, by run and position."""
    waiting = outcomes.where("status = 'pending'").select("ingestion_item_id")
    return items.where("fetch_status = 'fetched'").join(waiting, "ingestion_item_id").select("job_id", "position", "id", "ingestion_item_id").orderBy("job_id", "position", "id")


def has_pending(frontier: DataFrame) -> DataFrame:
    """(job_id, has_pending) of each run."""
    return frontier.groupBy("job_id").agg(F.max(F.col("status") == "pending").alias("has_pending"))


def frontier_at(frontier: DataFrame, job_id: str, locator: str) -> DataFrame:
    """The entry of a run with a locator; both conditions reach the scan."""
    return frontier.where((F.col("job_id") == job_id) & (F.col("locator") == locator))


def located(frontier: DataFrame, asked: DataFrame) -> DataFrame:
    """The entries of (job_id, locator) pairs ``asked``, each pair once: one join for any number of lookups; nulls meet nothing."""
    return frontier.join(asked.select("job_id", "locator").distinct(), ["job_id", "locator"], "left_semi")


def next_frontier(frontier: DataFrame) -> DataFrame:
    """The pending entry of each run that comes next: least depth, then id."""
    return frontier.where("status = 'pending'").groupBy("job_id").agg(F.min(F.struct("depth", "id")).alias("x")).select("job_id", "x.depth", "x.id")


def categories_visited(frontier: DataFrame) -> DataFrame:
    """(job_id, categories_visited): completed, failed or already continued entries."""
    done: Column = F.col("status").isin("completed", "failed") | F.col("continuation").isNotNull()
    return frontier.groupBy("job_id").agg(F.count_if(done).alias("categories_visited"))
