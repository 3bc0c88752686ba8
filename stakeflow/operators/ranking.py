"""Top-k, pages and chunks. Short lists use Spark's top-k; positions use blocked counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.operators.scan import numbered


def paginate(df: DataFrame, order: list[str], block: Column, page: int, per_page: int) -> DataFrame:
    """One page in ``order`` with the totals of the listing on each row.

    Only the blocks that overlap the page are numbered, so a deep page costs as much as the first.
    ``page`` is clamped to the existing pages.
    """
    blocks = df.withColumn("_block", block)
    counts = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    # one row per block: bounded by the number of blocks
    earlier = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_block", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    total = F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0))
    starts = starts.withColumn("total", total).withColumn(
        "total_pages", F.ceil(F.col("total") / per_page).cast("long"))
    starts = starts.withColumn("page", F.greatest(F.lit(1), F.least(F.lit(page), F.greatest("total_pages", F.lit(1)))))
    first = (F.col("page") - 1) * per_page
    hit = starts.filter((F.col("_before") < first + per_page) & (F.col("_before") + F.col("_n") > first))
    inside = Window.partitionBy("_block").orderBy(*order)
    return (
        blocks.join(hit, "_block")
        .withColumn("position", F.col("_before") + F.row_number().over(inside))
        .filter((F.col("position") > first) & (F.col("position") <= first + per_page))
        .withColumn("has_prev", F.col("page") > 1)
        .withColumn("has_next", F.col("page") < F.col("total_pages"))
        .withColumn("prev_page", F.when(F.col("page") > 1, F.col("page") - 1))
        .withColumn("next_page", F.when(F.col("page") < F.col("total_pages"), F.col("page") + 1))
        .drop("_block", "_n", "_before")
    )


def upcoming_ranked(matches: DataFrame, limit: int) -> DataFrame:
    """Cut to the first ``limit`` by start time, then order by (value bet, confidence)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    first = matches.orderBy("match_date", "match_id").limit(limit)
    return first.orderBy(F.desc("value_bet"), F.desc("confidence"), "match_id")


def value_bets_today(bets: DataFrame, order: list[str], top: int = 20) -> DataFrame:
    """Highest expected value first, with the number found before the cut."""
    found = bets.agg(F.count("*")).scalar()
    return bets.orderBy(F.desc("expected_value"), *order).limit(top).withColumn("total_found", found)


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def chunks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Number consecutive batches of ``n`` rows in ``order``."""
    return numbered(df, order, "_pos").withColumn("chunk", F.floor((F.col("_pos") - 1) / n).cast("long")).drop("_pos")
