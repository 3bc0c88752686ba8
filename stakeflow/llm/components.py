"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouping and a join on node ids; the table shrinks towards one edge from every node to
the smallest id of its component. A node of any degree is one key of a join whose skew AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.storage import written


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of an edge; edges are two long columns, in any direction.

    Nodes without an edge are not listed. ``component_id`` is the smallest id reachable.
    """
    a, b = edges.columns[:2]
    rows = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    rows = written(rows, "edges")
    mark = _mark(rows)
    for _ in range(rounds):
        both = rows.union(rows.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(low, F.col("u") == F.col("k"))
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        moved = large.join(small, F.col("a") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a > b").distinct()
        rows = written(moved, "edges")
        if mark == (mark := _mark(rows)):
            roots = rows.select(F.col("b").alias("id")).distinct()
            return rows.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
                roots.select("id", F.col("id").alias("component_id")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
