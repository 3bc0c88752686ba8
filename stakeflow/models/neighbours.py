"""Exact nearest neighbours by cosine with pivot bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeflow.functions.semantics import r6
from stakeflow.operators.scan import top_per_key
from stakeflow.session import written

#: Pivots, candidates of a block, and queries that are scored against a block together.
PIVOTS, BLOCK_ROWS, QUERY_ROWS = 256, 4096, 1024
#: Bounds are compared with this slack, which is wider than the rounding of similarities and of double arithmetic.
SLACK = 2e-6


def _unit(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and the numbers of these rows."""
    vectors = [np.asarray(v, float) if v is not None and None not in v else np.zeros(0) for v in batch.column(column).to_pylist()]
    norms = np.array([float(np.sqrt(v @ v)) if len(v) else 0.0 for v in vectors])
    rows = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return np.array([vectors[i] / norms[i] for i in rows]), rows


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _in_cells(df: DataFrame, ident: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(id, v, cell, angle): unit vectors with their nearest pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, rows = _unit(batch, 1)
            if not len(rows):
                continue
            cosine = v @ pivots.T
            cell = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(list(v), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)),
                 pa.array(_angle(cosine[np.arange(len(v)), cell]))], ["id", "v", "cell", "angle"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>")).mapInArrow(assign, f"id {kind}, v array<double>, cell int, angle double")


def _score(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each block for the queries that visit it; both sides carry (cell, block)."""
    kinds = {n: f.schema["id"].dataType.simpleString() for n, f in (("q", queries), ("c", candidates))}

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": [], "cid": [], "similarity": [], "pairs": []})
        c = np.stack(right["v"].to_numpy())
        out = []
        for lo in range(0, len(left), QUERY_ROWS):
            part = left.iloc[lo : lo + QUERY_ROWS]
            similar = np.round(np.stack(part["v"].to_numpy()) @ c.T, 6)
            for qid, own in zip(part["id"], similar):
                order = np.lexsort((right["id"].to_numpy(), -own))[:k]
                out.append(pd.DataFrame({"qid": qid, "cid": right["id"].to_numpy()[order], "similarity": own[order], "pairs": 0}))
            out[-1].loc[out[-1].index[0], "pairs"] = similar.size
        return pd.concat(out)

    keys = ["cell", "block"]
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        best, f"qid {kinds['q']}, cid {kinds['c']}, similarity double, pairs long")


def nearest(queries: DataFrame, candidates: DataFrame, qid: str, cid: str, vector: str, k: int, pivots: int = PIVOTS,
            block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most similar candidates of each query, exactly, and the number of pairs scored.

    Candidates lie in the cell of their nearest pivot, cells in blocks of about ``block_rows``. By the
    triangle inequality of angles no candidate of a cell is nearer to a query than the query's
    distance to the pivot less the cell's radius. Every query first visits the blocks of its nearest
    cells until these hold ``k`` candidates; their k-th similarity is a bar, and of all other cells
    only those are visited whose bound reaches it. Pivots are a bounded sample; vectors that are null,
    zero or hold nulls take no part.
    """
    spark = candidates.sparkSession
    sample = [np.asarray(r[0], float) for r in candidates.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).orderBy(
        F.xxhash64(cid), F.xxhash64(vector)).limit(pivots).collect() if None not in r[0]]
    sample = [v / np.sqrt(v @ v) for v in sample if v @ v > 0]
    if not sample:
        empty = spark.createDataFrame([], f"{qid} {queries.schema[qid].dataType.simpleString()}, {cid} {candidates.schema[cid].dataType.simpleString()}, similarity double, rn int")
        return empty, spark.range(1).select(F.lit(0).cast("long").alias("pairs"))
    base = np.array(sample)
    cells = written(_in_cells(candidates, cid, vector, base), "cells")
    # one row per pivot
    facts = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    count = np.array([facts.get(c, (0, 0.0))[0] for c in range(len(base))])
    radius = np.array([facts.get(c, (0, 0.0))[1] for c in range(len(base))])
    blocks = np.maximum(1, -(-count // block_rows))
    sized = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "_c int, _blocks int")
    dealt = cells.join(F.broadcast(sized), F.col("cell") == F.col("_c")).select(
        "id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("block"))
    asked = written(_in_cells(queries, qid, vector, base), "asked").select("id", "v")

    def visits(df: DataFrame, near: bool) -> DataFrame:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column(1).to_pylist())
                if not len(v):
                    continue
                bound = np.where(count > 0, np.cos(np.maximum(_angle(v @ base.T) - radius, 0.0)), -2.0)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1)
                # the cells up to the one that brings k candidates
                first = (held - count[order] < k) & (count[order] > 0)
                early = np.zeros_like(first)
                np.put_along_axis(early, order, first, 1)
                if near:
                    picked = early
                else:
                    bar = np.array([-1.0 if b is None else b for b in batch.column(2).to_pylist()])
                    picked = ~early & (count > 0) & (bound >= bar[:, None] - SLACK)
                row, cell = np.nonzero(picked)
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int64))],
                    ["id", "v", "cell", "block"])

        return df.mapInArrow(choose, f"id {df.schema['id'].dataType.simpleString()}, v array<double>, cell int, block long")

    def cut(df: DataFrame) -> DataFrame:
        return top_per_key(df, ["qid"], [F.desc("similarity"), F.asc("cid")], k, F.col("cid"))

    first = written(_score(visits(asked, True), dealt, k), "first")
    bars = cut(first).filter(F.col("rn") == k).select(F.col("qid").alias("_q"), F.col("similarity").alias("bar"))
    rest = written(_score(visits(asked.join(bars, F.col("id") == F.col("_q"), "left").select("id", "v", "bar"), False), dealt, k), "rest")
    every = first.unionByName(rest)
    found = cut(every.drop("pairs")).select(F.col("qid").alias(qid), F.col("cid").alias(cid), r6(F.col("similarity")).alias("similarity"), "rn")
    return found, every.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
