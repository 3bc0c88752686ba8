"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Equal vectors form a class, of which one is indexed. Classes are dealt to shards by a hash; each shard
builds its own layered graph, kept as flat neighbour arrays, and queries go to all shards in
blocks; the shards' best are merged and classes expanded to their members. One added component
makes all indexed vectors equally long without changing a query's inner products, so the graph
works for vectors of any lengths.

Both building and searching advance a whole batch of vectors in step: each step expands every
vector's best unexpanded candidate and scores all their neighbours in one array operation.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
neither do rows with a null id; vectors are compared with those of their own length; with fewer
candidates than ``k`` all are returned; equal scores rank by the smaller id; repeated rows of an id
are one candidate. An empty table or no query gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.llm.storage import written
from stakeflow.llm.vectors import matrix, usable

WORST = -np.inf


@dataclass(frozen=True)
class Settings:
    k: int = 20
    shards: int = 8  # at least; a shard holds at most shard_rows classes and about shard_bytes
    shard_rows: int = 200_000
    shard_bytes: int = 1 << 29
    links: int = 16  # per node in the upper layers, twice that in the lowest
    build_width: int = 64
    search_width: int = 128
    starts: int = 256  # rows at least that a query is compared with to find its entries
    entries: int = 8
    batch: int = 128
    query_block: int = 20_000
    seed: int = 3


class Graph:
    """A layered proximity graph over the rows of ``x``; larger inner products are nearer."""

    def __init__(self, x: np.ndarray, opts: Settings):
        self.x, self.opts = x.astype(np.float32), opts
        n = len(x)
        draw = np.random.default_rng(opts.seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(opts.links)).astype(int), 8)
        self.level[0] = self.level.max() if n else 0
        self.near = [np.full((n, opts.links * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.top = 0  # row 0 is on the top layer and is the entry
        lo = 1
        while lo < n:
            hi = min(n, lo + min(opts.batch, max(1, lo // 2)))
            self._insert(np.arange(lo, hi))
            lo = hi
        self.entries = self._reaching_all(self._sample(n))
        self.entries = np.r_[self.entries, self._lost()]

    def search(self, q: np.ndarray, width: int, layer: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` rows of a layer for each query, nearest first: (rows or -1, scores)."""
        b, near = len(q), self.near[layer]
        rows = np.full((b, width), -1, np.int64)
        score = np.full((b, width), WORST, np.float32)
        seen = np.zeros((b, len(self.x)), bool)
        e = entry.shape[1]
        rows[:, :e] = entry
        here = np.einsum("bd,bed->be", q, self.x[np.maximum(entry, 0)])
        here[entry < 0] = WORST
        score[:, :e] = here
        given = entry >= 0
        seen[np.arange(b)[:, None].repeat(e, 1)[given], entry[given]] = True
        opened = rows < 0
        every = np.arange(b)
        active = every
        while len(active):
            hope = np.where(opened[active], WORST, score[active])
            pick = hope.argmax(1)
            going = hope[np.arange(len(active)), pick] > WORST
            active, pick = active[going], pick[going]
            if not len(active):
                break
            opened[active, pick] = True
            new = near[rows[active, pick]].astype(np.int64)
            fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
            worst = score[active].min(1)
            s = np.einsum("bd,bmd->bm", q[active], self.x[np.maximum(new, 0)])
            seen[active[:, None].repeat(new.shape[1], 1)[fresh], new[fresh]] = True
            s[~fresh] = WORST
            gain = (s > worst[:, None]).any(1)
            if gain.any():
                a = active[gain]
                all_s = np.concatenate([score[a], s[gain]], 1)
                all_r = np.concatenate([rows[a], new[gain]], 1)
                all_o = np.concatenate([opened[a], np.zeros(s[gain].shape, bool)], 1)
                keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
                score[a] = np.take_along_axis(all_s, keep, 1)
                rows[a] = np.take_along_axis(all_r, keep, 1)
                opened[a] = np.take_along_axis(all_o, keep, 1) | (score[a] == WORST)
        order = np.argsort(-score, axis=1, kind="stable")
        rows, score = np.take_along_axis(rows, order, 1), np.take_along_axis(score, order, 1)
        rows[score == WORST] = -1
        return rows, score

    def _sample(self, rows: int) -> np.ndarray:
        """Evenly spread rows, as many as the root of the rows asks for."""
        return np.arange(0, rows, max(1, rows // max(self.opts.starts, int(4 * rows**0.5))))

    def _reaching_all(self, entries: np.ndarray) -> np.ndarray:
        """``entries`` and one row of each part of the lowest layer that no links lead to from them."""
        near, reached, front, more = self.near[0], np.zeros(len(self.x), bool), entries, []
        while True:
            reached[front] = True
            while len(front):
                front = near[front].ravel()
                front = np.unique(front[front >= 0])
                front = front[~reached[front]]
                reached[front] = True
            left = np.flatnonzero(~reached)
            if not len(left):
                return np.r_[entries, np.array(more, np.int64)]
            front = left[:1]
            more.append(int(left[0]))

    def _lost(self) -> np.ndarray:
        """Rows that, asked as queries (without the added component), find nothing as near as they are themselves: new entries."""
        out = [np.zeros(0, np.int64)]
        for lo in range(0, len(self.x), self.opts.batch):
            q = self.x[lo : lo + self.opts.batch].copy()
            q[:, -1] = 0
            best = self.nearest(q, self.opts.links)[:, 0]
            short = (q * self.x[np.maximum(best, 0)]).sum(1) < (q * q).sum(1) - 1e-6
            out.append(lo + np.flatnonzero(short | (best < 0)))
        return np.concatenate(out)

    def _starts(self, q: np.ndarray, entry: np.ndarray, sample: np.ndarray) -> np.ndarray:
        """``entry`` and the best of a sample: links follow nearness, so far clusters may have none between them."""
        most = min(self.opts.entries, len(sample))
        best = sample[np.argpartition(-(q @ self.x[sample].T), most - 1, axis=1)[:, :most]]
        return np.concatenate([np.where((best == entry).any(1, keepdims=True), -1, entry), best], 1)

    def _spread(self, rows: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of each node's candidates (nearest first): those nearer to it than to a chosen one, then the nearest rest."""
        b, w = rows.shape
        x = self.x[np.maximum(rows, 0)]
        between = np.einsum("bid,bjd->bij", x, x)
        chosen = np.zeros((b, w), bool)
        count = np.zeros(b, np.int64)
        for j in range(w):
            closest = np.where(chosen, between[:, j, :], WORST).max(1)
            take = (rows[:, j] >= 0) & (closest < score[:, j]) & (count < most)
            chosen[:, j] = take
            count += take
        rank = np.where(chosen, 0, 1) * w + np.arange(w)
        rank[rows < 0] = 3 * w
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(rows, order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        entry = np.full((len(new), 1), self.top, np.int64)
        for layer in range(len(self.near) - 1, -1, -1):
            on = self.level[new] >= layer
            starts = entry if layer else self._starts(q, entry, self._sample(int(new[0])))
            found, score = self.search(q, self.opts.build_width if on.any() else 1, layer, starts)
            entry = found[:, :1]
            if not on.any():
                continue
            mates, own = new[on], q[on]
            among = own @ own.T
            np.fill_diagonal(among, WORST)
            rows = np.concatenate([found[on], np.broadcast_to(mates, among.shape)], 1)
            both = np.concatenate([score[on], among], 1)
            rows = np.where(both == WORST, -1, rows)
            best = np.argsort(-both, axis=1, kind="stable")[:, : self.opts.build_width]
            rows, both = np.take_along_axis(rows, best, 1), np.take_along_axis(both, best, 1)
            most = self.near[layer].shape[1]
            links = self._spread(rows, both, self.opts.links)
            self.near[layer][mates] = np.pad(links, ((0, 0), (0, most - links.shape[1])), constant_values=-1)
            self._link_back(layer, np.repeat(mates, links.shape[1]), links.ravel())

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        near, most = self.near[layer], self.near[layer].shape[1]
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, n = np.unique(target, return_index=True, return_counts=True)
        width = int(n.max(initial=0))
        incoming = np.full((len(nodes), width), -1, np.int64)
        incoming[np.repeat(np.arange(len(nodes)), n), np.arange(len(target)) - np.repeat(start, n)] = source
        rows = np.concatenate([near[nodes].astype(np.int64), incoming], 1)
        sorted_rows = np.sort(rows, 1)
        twice = np.zeros(rows.shape, bool)
        twice[:, 1:] = sorted_rows[:, 1:] == sorted_rows[:, :-1]
        rows = np.where(twice, -1, sorted_rows)
        score = np.einsum("bd,bmd->bm", self.x[nodes], self.x[np.maximum(rows, 0)])
        score[rows < 0] = WORST
        best = np.argsort(-score, axis=1, kind="stable")[:, : 2 * most]
        rows, score = np.take_along_axis(rows, best, 1), np.take_along_axis(score, best, 1)
        room = (rows >= 0).sum(1) <= most
        kept = np.full((len(nodes), most), -1, np.int64)
        kept[room] = np.pad(rows[room], ((0, 0), (0, max(0, most - rows.shape[1]))), constant_values=-1)[:, :most]
        for lo in range(0, int((~room).sum()), 256):
            at = np.flatnonzero(~room)[lo : lo + 256]
            kept[at] = self._spread(rows[at], score[at], most)
        near[nodes] = kept

    def nearest(self, q: np.ndarray, width: int) -> np.ndarray:
        """Rows of the ``width`` best found for each query, nearest first, -1 where there are fewer."""
        q = q.astype(np.float32)
        out = np.full((len(q), width), -1, np.int64)
        for lo in range(0, len(q), self.opts.batch):
            part = q[lo : lo + self.opts.batch]
            entry = np.full((len(part), 1), self.top, np.int64)
            for layer in range(len(self.near) - 1, 0, -1):
                entry = self.search(part, 1, layer, entry)[0]
            starts = self._starts(part, entry, self.entries)
            out[lo : lo + self.opts.batch] = self.search(part, max(width, starts.shape[1]), 0, starts)[0][:, :width]
        return out


def _build(norm: float, opts: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        x = matrix(table.column("vector").combine_chunks())
        rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
        graph = Graph(np.column_stack([x, rest]) / (norm or 1), opts)
        data = pickle.dumps((table.column("id").to_numpy(), x, graph.near, graph.level, graph.entries), protocol=5)
        return pa.table({"shard": table.column("shard")[:1], "size": table.column("size")[:1], "graph": pa.array([data], pa.large_binary()).cast(pa.binary())})

    return run


def _search(norm: float, opts: Settings):
    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if graphs.num_rows and queries.num_rows:
            ids, x, near, level, entries = pickle.loads(graphs.column("graph")[0].as_py())
            graph = Graph.__new__(Graph)
            rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))
            graph.x = (np.column_stack([x, rest]) / (norm or 1)).astype(np.float32)
            graph.opts, graph.near, graph.level, graph.top, graph.entries = opts, near, level, 0, entries
            q_id, q = queries.column("query_id").to_numpy(), matrix(queries.column("vector").combine_chunks())
            width = max(opts.search_width, opts.k + 1)
            rows = graph.nearest(np.column_stack([q, np.zeros(len(q))]) / (norm or 1), min(width, len(ids)))
            for i in range(len(q)):
                at = rows[i][rows[i] >= 0]
                score = (x[at] * q[i]).sum(1)
                best = np.lexsort((ids[at], -score))[: opts.k + 1]
                out_q += [int(q_id[i])] * len(best)
                out_id += ids[at][best].tolist()
                out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest_vectors(rows: DataFrame, is_query: Column, opts: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row that ``is_query`` marks."""
    valid = rows.withColumn("_query", is_query).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"), "_query",
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["vec_id"])
    valid = written(valid, "vectors")
    classes = written(valid.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    total, norm, longest = classes.agg(
        F.count("*"), F.coalesce(F.sqrt(F.max(squares)), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    each = 8 * (longest + 1) + 16 * opts.links  # a vector and its links in a written graph
    shards = max(opts.shards, -(-total // opts.shard_rows), -(-total * each // opts.shard_bytes))
    size = F.size("vector").cast("long").alias("size")
    dealt = classes.select("id", "vector", size, F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    graphs = written(dealt.groupBy("size", "shard").applyInArrow(_build(norm, opts), "shard long, size long, graph binary"), "graphs")
    queries = valid.filter("_query").select(F.col("vec_id").alias("query_id"), "vector", size)
    blocks = max(1, -(-queries.count() // opts.query_block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    hits = spread.groupBy("size", "shard", "block").cogroup(queries.groupBy("size", "shard", "block")).applyInArrow(
        _search(norm, opts), "query_id long, id long, score double")
    best = lambda *by: Window.partitionBy(*by)
    hits = hits.withColumn("_n", F.row_number().over(best("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("_n") <= opts.k + 1)
    # of a class only its k + 1 smallest ids can be among the k nearest; salted, as a class may be large
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    many = classes.filter("copies > 1").select(F.col("vector").alias("c_vector"), F.col("id").alias("class"))
    copies = (
        valid.select("vec_id", "vector").join(many, F.col("vector") == F.col("c_vector")).select("class", "vec_id").withColumn("_salt", salt)
        .withColumn("_n", F.row_number().over(best("class", "_salt").orderBy("vec_id"))).filter(F.col("_n") <= opts.k + 1)
        .withColumn("_n", F.row_number().over(best("class").orderBy("vec_id"))).filter(F.col("_n") <= opts.k + 1)
        .select("class", "vec_id")
    )
    members = copies.union(classes.filter("copies = 1").select("id", "id"))
    found = hits.select("query_id", "id", "score").join(members, F.col("id") == F.col("class")).filter("vec_id != query_id")
    rank = F.row_number().over(best("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= opts.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
