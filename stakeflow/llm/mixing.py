"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a hash of their id. A document's virtual finish time is the
words its source has handed out up to and including it, divided by the source's target. All
sources with work left advance at the same virtual speed, so the mix is the global order of finish
times, cut where virtual time 1 (the whole budget) is reached. A source whose target exceeds its
size is read again from its start, up to ``max_epochs`` times; targets are capped there and the
excess goes to the other sources by weight.

Defined cases: a null source is a source of its own (ordered last); a null or blank text has size
0 and gives 0 words; repeated rows are separate documents; a null ``doc_id`` is hashed as an empty
id. An empty table gives an empty mix. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.llm.storage import free_names, written

# fixed value: words are runs of bytes that are not ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of the shuffle hash that name a block: a source's running sum is made of 4096 blocks.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets of (source, source_size) rows, one row per source.

    Sources in code point order (null last) take ``weights`` in turn and share the sum of all
    sizes. With sources ordered by cap / weight, the common words per weight after capping the first
    k rises while sources are over their cap and falls afterwards: its maximum is the final level.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    cap = F.col("source_size") * max_epochs
    before = Window.orderBy(F.col("source_size") * max_epochs / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("level", left.cast("double") / share)
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level")))
        .drop("level")
    )


def mix_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, words_before, taken, virtual_finish.

    ``taken`` counts the words of all epochs within the budget; the document at the cut gives a part.
    A source of any share of the rows is summed in 4096 blocks, so no task holds a whole source.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("place")), "mix-sizes"
    ).withColumn("block", F.substring("place", 1, BLOCK_DIGITS))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, max_epochs)
    starts = blocks.withColumn(
        "start",
        F.coalesce(
            F.sum("block_size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    of_source = targets.select(F.col("source").alias("t_source"), "weight", "source_size", "target")
    known = starts.join(of_source, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), "start", "weight", "source_size", "target")
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        sized.withColumn("upto", F.sum("size").over(inside))
        .join(known, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
        .withColumn("words_before", F.col("start") + F.col("upto") - F.col("size"))
    )
    budget = F.floor("target")
    epochs = [
        F.greatest(F.lit(0), F.least(F.col("size"), budget - F.lit(e) * F.col("source_size") - F.col("words_before")))
        for e in range(max_epochs)
    ]
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "words_before", "place",
        sum(epochs[1:], epochs[0]).cast("long").alias("taken"),
        F.when(F.col("target") > 0, (F.col("words_before") + F.col("size")) / F.col("target")).alias("virtual_finish"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mix plan in the global order of virtual finish times (a range sort)."""
    plan = mix_plan(docs, weights, max_epochs, seed)
    return plan.orderBy(F.col("virtual_finish").asc_nulls_last(), "place", "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed rows themselves: whole documents, as often as the mix takes them, in mix order.

    A document at the cut is taken if at least half of it lies within the budget, so no text is cut
    and every source ends within half a document of its target. Documents of size 0 cost nothing of
    the budget and are kept once.
    """
    # the plan's columns stand beside those of the documents, whatever these are called
    key, size, source, copies, total, target, before, place, nth, words, row, epoch = free_names(
        docs, "m_id", "m_size", "m_source", "m_copies", "m_source_size", "m_target", "m_before", "m_place", "m_nth", "m_words", "m_row", "m_epoch")
    plan = mix_plan(docs, weights, max_epochs, seed).select(
        F.col("doc_id").alias(key), F.col("size").alias(size), F.col("source").alias(source),
        F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias(copies),
        F.col("source_size").alias(total), F.col("target").alias(target),
        F.col("words_before").alias(before), F.col("place").alias(place),
    )
    # repeated rows of one id have plans of their own: pair them by number
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    plan = plan.withColumn(nth, number(key, size, source))
    rows = docs.withColumn(words, word_count(F.col("text")))
    rows = rows.withColumn(row, number("doc_id", words, "source"))
    taken = rows.join(
        plan,
        F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(words) == F.col(size))
        & F.col("source").eqNullSafe(F.col(source)) & (F.col(row) == F.col(nth)),
    ).filter(F.col(copies) > 0)
    finish = (F.col(epoch) * F.col(total) + F.col(before) + F.col(size)) / F.col(target)
    return (
        taken.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .orderBy(F.when(F.col(target) > 0, finish), place, "doc_id")
        .select(*docs.columns)
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
lv AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w
  WINDOW before AS (ORDER BY source_size * 3 / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), weight * (SELECT max(level) FROM lv)) AS target FROM lv),
c AS (
  SELECT doc_id, source, size,
         CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS b
  FROM sized)
SELECT c.doc_id, c.size, t.source_size, t.target,
       CAST(greatest(0, least(c.size, CAST(floor(t.target) AS BIGINT) - c.b))
          + greatest(0, least(c.size, CAST(floor(t.target) AS BIGINT) - t.source_size - c.b))
          + greatest(0, least(c.size, CAST(floor(t.target) AS BIGINT) - 2 * t.source_size - c.b)) AS BIGINT) AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""
