"""Near-duplicate vectors of equal label by a forest of random-projection trees.

Equal vectors of a label form a class. Each tree splits the classes of a label again and again at
the median of a random projection; classes near the cut spill to both sides, so that a pair at the
threshold is torn apart only by a projection three standard deviations out, and several trees make
that rarer still. Within a leaf all classes are compared in double precision. A pair that shares
several leaves is counted in the first of them only, so link counts add up over leaves without any
pair leaving its task; components follow from the leaves' spanning links.

Medians come from a bounded sample (``sample`` classes by a hash of the id); all vectors are routed
and compared. A leaf that spilling keeps too large is cut into blocks, one task per pair of blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null
labels, link with nothing: 0 links, own component. Vectors of different lengths are not compared.
Repeated rows are vectors of their own; rows sharing an id share its component. A null id is linked
with nothing and has a null component. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.components import connected_components
from stakeflow.llm.minhash import block_pairs
from stakeflow.llm.storage import written
from stakeflow.llm.words import mix


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.98
    trees: int = 3
    leaf: int = 1024  # expected classes of a leaf
    task: int = 3000  # classes of a leaf compared in one task
    sample: int = 20_000
    depth: int = 24
    seed: int = 5


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column without nulls, all of one length."""
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


@dataclass
class Tree:
    """Split nodes of one tree and group: heap index -> (direction, median)."""

    splits: dict[int, tuple[np.ndarray, float]] = field(default_factory=dict)


def _direction(seed: int, tree: int, node: int, size: int) -> np.ndarray:
    r = np.random.default_rng([seed, tree, node, size]).standard_normal(size)
    return r / np.linalg.norm(r)


def spill(size: int, cosine: float) -> float:
    """Half the projection gap that pairs at the threshold exceed only at three standard deviations."""
    return 1.5 * np.sqrt(2 - 2 * cosine) / np.sqrt(size)


def fit_tree(unit: np.ndarray, tree: int, most: int, opts: Settings) -> Tree:
    """Medians of one group's sample; a node stops at ``most`` sampled rows, or where most rows would spill."""
    out, todo = Tree(), [(1, np.arange(len(unit)))]
    half = spill(unit.shape[1], opts.cosine)
    while todo:
        node, rows = todo.pop()
        if len(rows) <= most or node >= 1 << opts.depth:
            continue
        r = _direction(opts.seed, tree, node, unit.shape[1])
        p = unit[rows] @ r
        t = float(np.median(p))
        left, right = rows[p <= t + half], rows[p > t - half]
        if len(left) + len(right) > 1.8 * len(rows):  # a tight group: splitting would only copy it
            continue
        out.splits[node] = (r, t)
        todo += [(2 * node, left), (2 * node + 1, right)]
    return out


def route(unit: np.ndarray, tree: Tree, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: every leaf that a row reaches, with spilling."""
    rows, leaves, todo = [], [], [(1, np.arange(len(unit)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node not in tree.splits:
            rows.append(at)
            leaves.append(np.full(len(at), node, np.int64))
            continue
        r, t = tree.splits[node]
        p = unit[at] @ r
        todo += [(2 * node, at[p <= t + half]), (2 * node + 1, at[p > t - half])]
    return np.concatenate(rows), np.concatenate(leaves)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _route(shared, opts: Settings):
    def run(batches):
        forest: dict[tuple[str, int], list[Tree]] = shared.value
        for batch in batches:
            group, size = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            leaves: list[list[int]] = [[] for _ in group]
            keys = list(zip(group, size.tolist()))
            for key in set(keys):
                at = np.array([i for i, k in enumerate(keys) if k == key])
                unit = _units(matrix(batch.column(3).take(pa.array(at))))
                name = np.uint64(int.from_bytes(key[0].encode()[-7:], "little")) ^ (np.uint64(key[1]) << np.uint64(40))
                name ^= np.uint64(len(key[0]))
                for n, tree in enumerate(forest.get(key, [Tree()] * opts.trees)):
                    rows, nodes = route(unit, tree, spill(unit.shape[1], opts.cosine))
                    # the tree number leads, so keys compare in the order in which leaves count pairs
                    code = (mix(mix(np.array([name])) + nodes.astype(np.uint64)) >> np.uint64(8)) | (np.uint64(n) << np.uint64(56))
                    for i, c in zip(at[rows].tolist(), code.tolist()):
                        leaves[i].append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(4), pa.array(leaves, pa.list_(pa.int64())), batch.column(1)],
                ["id", "vector", "copies", "leaves", "grp"])

    return run


def leaf_links(
    ids: np.ndarray, unit: np.ndarray, copies: np.ndarray, leaves: list[list[int]], leaf: int, block: np.ndarray, group: np.ndarray, cosine: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Link counts first seen in this leaf, and spanning links of all pairs at the threshold.

    In a task of two blocks only pairs across them count. Rows of another group never link, even if
    leaf names should collide.
    """
    n = len(ids)
    earlier = sorted({c for own in leaves for c in own if c < leaf})
    place = {c: k for k, c in enumerate(earlier)}
    member = np.zeros((n, len(earlier)), np.float32)
    for i, own in enumerate(leaves):
        member[i, [place[c] for c in own if c < leaf]] = 1
    mixed = len(np.unique(block)) > 1
    hits, counts = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for lo in range(0, n, 256):
        part = slice(lo, min(n, lo + 256))
        hit = (unit[part] @ unit.T >= cosine) & (group[part][:, None] == group[None, :])
        hit[np.arange(hit.shape[0]), np.arange(part.start, part.stop)] = False
        hits[part] = hit
        fresh = hit & (block[part][:, None] != block[None, :]) if mixed else hit
        if len(earlier) and fresh.any():
            fresh = fresh & (member[part] @ member.T == 0)
        counts[part] = fresh @ copies
    links, left = [], np.ones(n, bool)
    for start in range(n):
        if left[start] and hits[start].any():
            left[start], queue = False, [start]
            while queue:
                x = queue.pop()
                new = np.flatnonzero(hits[x] & left)
                left[new] = False
                links.extend((int(ids[x]), int(ids[y])) for y in new)
                queue.extend(new.tolist())
    return counts, links


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        group = np.unique(np.array(table.column("grp").to_pylist()), return_inverse=True)[1]
        rows = table.column("vector").to_pylist()
        size = np.array([len(v) for v in rows])
        out_id, out_n, out_to = [], [], []
        for width in np.unique(size).tolist():
            at = np.flatnonzero(size == width)
            counts, links = leaf_links(
                ids[at], _units(np.array([rows[i] for i in at], np.float64)), copies[at], table.column("leaves").take(pa.array(at)).to_pylist(),
                table.column("leaf")[0].as_py(), table.column("block").to_numpy()[at], group[at], cosine)
            some = np.flatnonzero(counts)
            out_id += ids[at][some].tolist() + [a for a, _ in links]
            out_n += counts[some].tolist() + [0] * len(links)
            out_to += [None] * len(some) + [b for _, b in links]
        return pa.table({"id": pa.array(out_id, pa.int64()), "n": pa.array(out_n, pa.int64()), "b": pa.array(out_to, pa.int64())})

    return run


def near_vectors(rows: DataFrame, opts: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    vector = F.col("embedding").cast("array<double>")
    every = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("grp"), vector.alias("vector"))
    good = usable(F.col("vector")) & F.col("grp").isNotNull() & F.col("vec_id").isNotNull()
    every = every.withColumn("good", good)
    classes = (
        every.filter("good").groupBy("grp", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
        .select("id", "grp", F.size("vector").cast("long").alias("size"), "vector", "copies")
    )
    classes = written(classes, "vector-classes")
    total = classes.count()
    sample = classes.select("grp", "size", "vector").orderBy(F.xxhash64("id"), "id").limit(opts.sample).collect()
    forest: dict[tuple[str, int], list[Tree]] = {}
    by_group: dict[tuple[str, int], list[list[float]]] = {}
    for r in sample:
        by_group.setdefault((r["grp"], r["size"]), []).append(r["vector"])
    most = max(8, int(opts.leaf * len(sample) / max(total, 1)))
    for key, vectors in by_group.items():
        unit = _units(np.array(vectors, np.float64))
        forest[key] = [fit_tree(unit, t, most, opts) for t in range(opts.trees)]
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # bounded: splits of a bounded sample
    routed = classes.mapInArrow(_route(shared, opts), "id long, vector array<double>, copies long, leaves array<long>, grp string")
    routed = written(routed, "routed")
    placed = routed.withColumn("leaf", F.explode("leaves"))
    sizes = routed.select(F.explode("leaves").alias("s_leaf")).groupBy("s_leaf").agg(F.count("*").alias("n"))
    half = opts.task // 2
    blocks = F.when(F.col("n") <= opts.task, 1).otherwise(F.ceil(F.col("n") / half))
    placed = placed.join(sizes, F.col("leaf") == F.col("s_leaf")).withColumn("blocks", blocks.cast("long"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tasks = block_pairs(placed, "leaf", F.col("blocks"), F.xxhash64("id"))
    found = tasks.select("id", "vector", "copies", "leaves", "grp", "leaf", "block", "task").groupBy("task").applyInArrow(
        _compare(opts.cosine), "id long, n long, b long")
    found = written(found, "vector-links")
    counts = found.filter("n > 0").groupBy(F.col("id").alias("n_id")).agg(F.sum("n").alias("others"))
    joined = connected_components(found.filter("b IS NOT NULL").select(F.col("id").alias("a"), "b"))
    reached = (
        classes.select(F.col("grp").alias("c_grp"), F.col("vector").alias("c_vector"), F.col("id").alias("c_id"), "copies")
        .join(counts, F.col("c_id") == F.col("n_id"), "left")
        .join(joined.withColumnRenamed("id", "j_id"), F.col("c_id") == F.col("j_id"), "left")
        .select("c_grp", "c_vector", F.coalesce("component_id", "c_id").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    )
    out = every.join(reached, F.col("good") & (F.col("grp") == F.col("c_grp")) & (F.col("vector") == F.col("c_vector")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
