"""Mixes of sources to target weights, by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import token_counts

#: Targets are a small table that a person writes; more rows than this are refused, so their broadcast is bounded.
MOST_TARGETS = 100_000
#: Hash ranges in which tokens are summed before the last documents are chosen one by one.
RANGES = 65_536


def source_key(c: Column) -> Column:
    """A source's name regardless of case and outer blanks; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amount of each source: ``total`` in proportion to ``shares``, none above its cap.

    Sources at their cap are clamped and what is left goes to the others in proportion, until all fit. Where the
    caps sum to less than ``total``, every source gets its cap.
    """
    amount = dict.fromkeys(shares, 0.0)
    free = {s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0}
    left = min(total, sum(caps[s] for s in free))
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        over = {s for s in free if left * shares[s] / weight >= caps[s]}
        if not over:
            for s in free:
                amount[s] = left * shares[s] / weight
            break
        for s in over:
            amount[s] = float(caps[s])
            left -= caps[s]
        free -= over
    return amount


def plan_mixes(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[tuple]:
    """Rows (mix_name, source, target_share, max_repeats, stock_tokens, wanted_tokens), a row for each target.

    ``tokens`` has source and n_tokens for each document; only the sums over sources that are targets come to the
    driver. A source named twice in a mix has the sum of its shares and the smaller cap. Null shares or repeats
    count as 0. ``total_tokens`` is the size of each mix; None: as much as the mix's own sources hold.
    """
    wanted = (
        targets.select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("mix_name is not null and source is not null")
        .groupBy("mix_name", "source")
        .agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(0)).alias("max_repeats"))
        .orderBy("mix_name", "source").limit(MOST_TARGETS + 1).collect()
    )
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    stock = {r[0]: r[1] for r in tokens.groupBy("source").agg(F.sum("n_tokens")).collect()} if wanted else {}
    rows = []
    for mix in sorted({r["mix_name"] for r in wanted}):
        own = [r for r in wanted if r["mix_name"] == mix]
        have = {r["source"]: stock.get(r["source"], 0) for r in own}
        caps = {r["source"]: float(have[r["source"]] * max(0, r["max_repeats"])) for r in own}
        got = water_fill({r["source"]: max(0.0, r["target_share"]) for r in own}, caps, float(total_tokens if total_tokens is not None else sum(have.values())))
        rows += [(mix, r["source"], float(r["target_share"]), int(r["max_repeats"]), int(have[r["source"]]), got[r["source"]]) for r in own]
    return rows


_PLAN = "mix_name string, source string, target_share double, max_repeats long, stock_tokens long, wanted_tokens double"


def mixed(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, rank_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_name, doc_id, source, n_tokens, repeats) and the report of each mix.

    Every document of a source is taken floor(r) times, r being the source's wanted tokens over its stock, and a
    seeded part of its documents once more, until the fraction left is filled to the nearest document. The part is
    the documents of lowest seeded hash; tokens are first summed by hash range, so that only the documents of one
    range of a source, about its 65,536th part, are ever ordered in one task. Documents without tokens (null, empty) and with null
    or unnamed sources are in no mix. Equal for equal seed, whatever the partitioning.
    """
    spark = docs.sparkSession
    names = targets.select(source_key(F.col("source")).alias("source")).where("source is not null").distinct().limit(MOST_TARGETS)
    own = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where("doc_id is not null").join(F.broadcast(names), "source", "left_semi")
    tokens = written(token_counts(own, "text", rank_file).where("n_tokens > 0").dropDuplicates(["doc_id"]), "tokens")
    plan = plan_mixes(tokens, targets, total_tokens)
    table = F.broadcast(spark.createDataFrame(plan, _PLAN))

    ratio = F.col("wanted_tokens") / F.col("stock_tokens")
    whole = F.floor(ratio + 1e-12)
    order = F.xxhash64(F.lit(seed), "doc_id")
    placed = tokens.select("*", order.alias("order"), F.pmod(F.shiftrightunsigned(order, 48), F.lit(RANGES)).cast("int").alias("range"))
    per_range = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    below = per_range.select("source", "range", (F.sum("range_tokens").over(Window.partitionBy("source").orderBy("range")) - F.col("range_tokens")).alias("below"), "range_tokens")

    extra = table.where("stock_tokens > 0 and wanted_tokens > 0").select("mix_name", "source", whole.alias("whole"), ((ratio - whole) * F.col("stock_tokens")).alias("fraction"), "max_repeats")
    at = extra.join(below.where("range_tokens > 0"), "source").where("fraction > below and fraction <= below + range_tokens").select("mix_name", "source", F.col("range").alias("last"), "below")
    last = F.broadcast(at)  # one row for each target
    in_last = (
        placed.join(last, "source").where("range = last")
        .withColumn("upto", F.col("below") + F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("order", "doc_id")))
        .join(F.broadcast(extra), ["mix_name", "source"]).where("upto - n_tokens / 2 <= fraction").select("mix_name", "doc_id", F.lit(1).alias("edge"))
    )
    selection = (
        placed.join(F.broadcast(extra), "source").join(last.select("mix_name", "source", "last"), ["mix_name", "source"], "left")
        .join(in_last, ["mix_name", "doc_id"], "left")
        .withColumn("repeats", F.least(F.col("max_repeats"), F.col("whole") + F.coalesce("edge", (F.col("range") < F.col("last")).cast("int"), F.lit(0))))
        .where("repeats > 0").select("mix_name", "doc_id", "source", "n_tokens", F.col("repeats").cast("long").alias("repeats"))
    )
    reached = selection.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    report = (
        table.join(reached, ["mix_name", "source"], "left")
        .select("mix_name", "source", "target_share", "max_repeats", "stock_tokens", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "most_repeats")))
        .withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0)), F.lit(0.0)))
    )
    return selection, report
