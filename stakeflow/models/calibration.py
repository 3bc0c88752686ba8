"""Isotonic calibration over any number of distinct scores.

Isotonic fits are the slopes of the lower convex hull of the cumulative diagram: the points (weight, label
sum) of all scores in order. Scores are range-partitioned; each partition pools its adjacent violators,
which gives the hull of its own points. The whole hull consists of pieces of these and of bridges
between partitions. The driver knows the points at the partitions' borders; each round it takes their
hull, and asks every partition that a bridge crosses for the point farthest below that bridge. When there
is none, the bridges are final. What the driver holds is a few points per partition, and a round is one
aggregation over the pooled blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.session import written

Point = tuple[float, float]


def pool(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Block number of each row after pooling adjacent violators of a sorted run."""
    w: list[float] = []
    s: list[float] = []
    n: list[int] = []
    for a, b in zip(weight.tolist(), total.tolist()):
        w.append(a)
        s.append(b)
        n.append(1)
        while len(w) > 1 and s[-2] * w[-1] >= s[-1] * w[-2]:
            w[-2:], s[-2:], n[-2:] = [w[-2] + w[-1]], [s[-2] + s[-1]], [n[-2] + n[-1]]
    return np.repeat(np.arange(len(n)), n)


def lower_hull(points: list[Point]) -> list[Point]:
    out: list[Point] = []
    for p in sorted(points):
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-1][0]) >= (p[1] - out[-1][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def _pooled(scored: DataFrame, p: str, label: str) -> DataFrame:
    """(place, block, score, w, s): distinct scores with their partition and the block they are pooled into there."""
    pre = scored.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(
        F.count("*").cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s"))
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(frames)
        if rows:
            run = pd.concat(rows)
            yield pd.DataFrame({"place": TaskContext.get().partitionId(), "block": pool(run["w"].to_numpy(), run["s"].to_numpy()),
                                "score": run["score"], "w": run["w"], "s": run["s"]})

    return written(pre.repartitionByRange(parts, "score").sortWithinPartitions("score").mapInPandas(
        local, "place int, block long, score double, w double, s double"), "pooled")


def _bridges(edges: list[tuple[Point, Point]], spans: dict[int, tuple[float, float]]) -> list[tuple[int, int, float, float, float, float]]:
    """(edge, place, slope, intercept, from, to) of the hull edges that cross a border, for every place they cross."""
    out = []
    for n, (a, b) in enumerate(edges):
        inside = [k for k, (lo, hi) in spans.items() if lo < b[0] and a[0] < hi]
        if len(inside) > 1:
            slope = (b[1] - a[1]) / (b[0] - a[0])
            out += [(n, k, slope, a[1] - slope * a[0], a[0], b[0]) for k in inside]
    return out


BRIDGE = "edge int, place int, slope double, base double, lo double, hi double"


def calibrate(scored: DataFrame, p: str, label: str, rounds: int = 100) -> DataFrame:
    """Isotonic map of raw scores: one row per distinct score with its observed and its calibrated share.

    Rows without a score or a label take no part; an empty table gives no rows.
    """
    spark = scored.sparkSession
    pooled = _pooled(scored, p, label)
    sums = {r["place"]: (r["w"], r["s"]) for r in pooled.groupBy("place").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).collect()}
    spans, start, at = {}, {}, (0.0, 0.0)
    for place in sorted(sums):
        start[place] = at
        at = (at[0] + sums[place][0], at[1] + sums[place][1])
        spans[place] = (start[place][0], at[0])
    names = [p, "observed", "calibrated"]
    if not sums:
        return pooled.select(F.col("score").alias(names[0]), F.col("s").alias(names[1]), F.col("w").alias(names[2]))
    offsets = spark.createDataFrame([(k, *v) for k, v in start.items()], "_p int, _x double, _y double")  # one row per partition
    upto = Window.partitionBy("place").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = pooled.groupBy("place", "block").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).join(
        F.broadcast(offsets), F.col("place") == F.col("_p")).select(
        "place", "block", "w", "s", (F.col("_x") + F.sum("w").over(upto)).alias("x"), (F.col("_y") + F.sum("s").over(upto)).alias("y"))
    blocks = written(blocks, "blocks")

    # borders of the partitions and the ends of the blocks beside them
    last = Window.partitionBy("place").orderBy(F.desc("block"))
    beside = blocks.withColumn("_n", F.row_number().over(last)).filter("block = 0 OR _n <= 2").select("x", "y").collect()
    known = {(0.0, 0.0), *((r["x"], r["y"]) for r in beside)}
    for _ in range(rounds):
        hull = lower_hull(list(known))
        found = _bridges(list(zip(hull, hull[1:])), spans)
        if not found:
            break
        asked = spark.createDataFrame(found, BRIDGE).withColumnRenamed("place", "_p")  # a few rows per partition
        under = F.col("y") - F.col("slope") * F.col("x") - F.col("base")
        low = blocks.join(F.broadcast(asked), F.col("place") == F.col("_p")).groupBy("edge", "place").agg(
            F.min(F.struct(under.alias("d"), "x", "y")).alias("m")).select("m.*").filter(F.col("d") < -1e-9 * max(1.0, at[1])).collect()
        new = {(r["x"], r["y"]) for r in low} - known
        if not new:
            break
        known |= new
    else:
        raise RuntimeError(f"bridges did not settle in {rounds} rounds")
    bridges = spark.createDataFrame(found, BRIDGE).withColumnRenamed("place", "_p")
    over = (F.col("place") == F.col("_p")) & (F.col("x") > F.col("lo")) & (F.col("x") <= F.col("hi"))
    fitted = blocks.join(F.broadcast(bridges), over, "left").select(
        F.col("place").alias("_p"), F.col("block").alias("_b"), F.coalesce("slope", F.col("s") / F.col("w")).alias("fit"))
    return pooled.join(fitted, (F.col("place") == F.col("_p")) & (F.col("block") == F.col("_b"))).select(
        F.col("score").alias(names[0]), r6(F.col("s") / F.col("w")).alias(names[1]), r6(F.col("fit")).alias(names[2]))
