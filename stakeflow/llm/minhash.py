"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is its set of word shingles. Documents with equal sets form a class and only its
smallest id goes on. A representative's sketch is one minwise token per coordinate. Each of several
independent trees puts all representatives into nodes by a chosen coordinate's token; a node that is
too large branches on further coordinates, chosen by a hash of its path, and small nodes are
compared exhaustively by sketch. The number of trees brings the recall of a pair at the threshold to
``recall``. Nodes only propose: documents joined by sketches form candidate groups, in which the
links are decided on the full shingle sets, again exhaustively. Groups and nodes beyond one task's
size are cut into blocks, and each pair of blocks is a task, so nothing is dropped.

Only spanning links leave a task, never all pairs of a group; components follow from them.

Defined cases: a null or blank text has no set, is linked with nothing and is its own component; with
fewer words than a shingle the whole sequence is one shingle; equal texts are one class whatever
their number; rows that share an id are one document; a null id is linked with nothing and has a
null component. An empty table gives no rows. Other columns are carried along by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.components import connected_components
from stakeflow.llm.storage import free_names, written
from stakeflow.llm.words import chunks, hash_seeds, minhash, mix, shingle_set, split_words


@dataclass(frozen=True)
class Settings:
    shingle: int = 3
    similarity: Fraction = Fraction(85, 100)
    recall: float = 1 - 1e-6
    coordinates: int = 64
    leaf: int = 4096  # documents compared in one node
    branches: int = 3  # coordinates on which a large node branches
    depth: int = 3
    block: int = 1_500_000  # shingles compared in one task

    @property
    def trees(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - float(self.similarity))))

    @property
    def agreeing(self) -> int:
        """Equal coordinates that make a candidate: four standard deviations below the threshold's mean."""
        s, n = float(self.similarity), self.coordinates
        return max(1, math.floor(n * s - 4 * math.sqrt(n * s * (1 - s))))


SKETCHED = "doc_id long, n_shingles long, digest binary, nodes array<long>, sketch binary"


def _sketch(opts: Settings):
    seeds = hash_seeds(opts.coordinates, 20)
    root = mix(np.arange(1, opts.trees + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            size, digest, nodes, sketch = [], [], [], []
            for _, part in chunks(batch.column(1)):
                words = split_words(part)
                for i in range(len(part)):
                    values = shingle_set(words.of(i), opts.shingle)
                    size.append(len(values))
                    if not len(values):
                        digest.append(None)
                        nodes.append(None)
                        sketch.append(None)
                        continue
                    tokens = minhash(values, seeds)
                    both = [mix(values ^ root[0]).sum(dtype=np.uint64), mix(values * root[0]).sum(dtype=np.uint64)]
                    digest.append(np.array([*both, len(values)], np.uint64).tobytes())
                    at = np.arange(opts.trees) % opts.coordinates
                    nodes.append(mix(root ^ (tokens[at].astype(np.uint64) << np.uint64(20))).view(np.int64))
                    sketch.append((tokens & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n_shingles", "digest", "nodes", "sketch"])

    return run


def _branch(opts: Settings):
    """Children of the rows of large nodes: (child node, id, sketch) for each chosen coordinate."""

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(node), -1).astype(np.uint64)
            for b in range(opts.branches):
                path = mix(node + np.uint64(b + 1))
                at = (path % np.uint64(sketch.shape[1])).astype(np.int64)
                child = mix(path ^ (sketch[np.arange(len(node)), at] << np.uint64(24)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), batch.column(1), batch.column(2)], ["node", "id", "sketch"])

    return run


def sketch_links(ids: np.ndarray, sketch: np.ndarray, agreeing: int) -> list[tuple[int, int]]:
    """Spanning links of a node's documents whose sketches agree often enough.

    Breadth first: each reached document is compared with those not reached yet, so a tight group
    of n costs about n comparisons, not n squared.
    """
    left = np.arange(len(ids))
    links = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = (sketch[left] == sketch[x]).sum(1) >= agreeing
            if hit.any():
                links.extend((int(ids[x]), int(ids[y])) for y in left[hit])
                queue.extend(left[hit])
                left = left[~hit]
    return links


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(key)]
    many = end - cut > 1
    return list(zip(cut[many].tolist(), end[many].tolist()))


def _compare_nodes(opts: Settings):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        ids = table.column("id").to_numpy()[order]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(node), -1)[order]
        links: set[tuple[int, int]] = set()
        for lo, hi in _runs(node[order]):
            links.update(sketch_links(ids[lo:hi], sketch[lo:hi], opts.agreeing))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def block_pairs(rows: DataFrame, key: str, blocks: Column, place: Column) -> DataFrame:
    """Spread groups of several blocks over tasks, one for each pair of blocks; adds column ``task``.

    A row of block i goes to the tasks {i, j} of all j; a group of one block has one task. Rows of
    different groups share no task.
    """
    n = F.greatest(blocks.cast("long"), F.lit(1))
    own = F.pmod(place, n)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return (
        rows.withColumn("_n", n).withColumn("_own", own).withColumn("_other", other)
        .withColumn("task", F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_n", "_own", "_other")
    )


def candidate_links(reps: DataFrame, opts: Settings) -> DataFrame:
    """(a, b) spanning links of all chosen-path nodes, by sketch."""
    total = reps.count()
    rows = reps.select(F.explode("nodes").alias("node"), "id", "sketch")
    levels = []
    for level in range(opts.depth + 1):
        big = rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > opts.leaf)
        big = written(big.select(F.col("node").alias("big_node"), "n"), "large-nodes")
        if big.isEmpty():
            levels.append(rows)
            break
        inside = rows.join(big, F.col("node") == F.col("big_node"))
        levels.append(rows.join(big, F.col("node") == F.col("big_node"), "left_anti"))
        if level == opts.depth:  # nodes that do not come apart: all pairs of their blocks
            spread = block_pairs(inside, "node", F.ceil(F.col("n") / (opts.leaf // 2)), F.xxhash64("id"))
            levels.append(spread.select(F.col("task").alias("node"), "id", "sketch"))
        else:
            rows = written(inside.select("node", "id", "sketch").mapInArrow(_branch(opts), "node long, id long, sketch binary"), "branches")
    every = levels[0]
    for more in levels[1:]:
        every = every.union(more)
    bundles = max(1, -(-total * opts.trees // 50_000))
    return (
        every.withColumn("bundle", F.pmod("node", F.lit(bundles))).groupBy("bundle")
        .applyInArrow(_compare_nodes(opts), "a long, b long").distinct()
    )


def exact_links(ids: np.ndarray, sets: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """Spanning links of documents whose full sets are similar enough, decided in whole numbers."""
    size = np.array([len(s) for s in sets], np.int64)
    up, down = similarity.numerator, similarity.denominator
    left = np.ones(len(sets), bool)
    links, indexed = [], 0

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        """Sorted shingles of the documents not reached yet, with their owners."""
        rest = np.flatnonzero(left)
        values = np.concatenate([sets[d] for d in rest]) if len(rest) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(rest, size[rest])[order], len(rest)

    for start in range(len(sets)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            if (rest := int(left.sum())) == 0:
                break
            if not indexed or 2 * rest < indexed:
                values, owner, indexed = index()
            x = queue.pop()
            first = np.searchsorted(values, sets[x], "left")
            n = np.searchsorted(values, sets[x], "right") - first
            first, n = first[n > 0], n[n > 0]
            if not len(n):
                continue
            post = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[post], minlength=len(sets))
            hit = np.flatnonzero(left & (down * common >= up * (size[x] + size - common)) & (common > 0))
            left[hit] = False
            links.extend((int(ids[x]), int(ids[y])) for y in hit)
            queue.extend(hit.tolist())
    return links


def _verify(opts: Settings):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("id", "ascending")])
        task, ids = table.column("task").to_numpy(), table.column("id").to_numpy()
        links: list[tuple[int, int]] = []
        texts = table.column("text").combine_chunks()
        for lo, hi in _runs(task):
            sets = []
            for _, part in chunks(texts.slice(lo, hi - lo)):
                words = split_words(part)
                sets.extend(shingle_set(words.of(i), opts.shingle) for i in range(len(part)))
            links.extend(exact_links(ids[lo:hi], sets, opts.similarity))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_copies(docs: DataFrame, opts: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = written(texts.mapInArrow(_sketch(opts), SKETCHED), "sketches")
    classes = marked.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    reps = marked.select("doc_id", F.col("digest").alias("own"), "n_shingles", "nodes", "sketch").join(
        classes, (F.col("own") == F.col("digest")) & (F.col("doc_id") == F.col("id"))
    ).dropDuplicates(["id", "own"]).select("id", "n_shingles", "nodes", "sketch")
    reps = written(reps, "representatives")
    groups = connected_components(candidate_links(reps, opts))
    sizes = reps.groupBy(F.col("id").alias("r_id")).agg(F.max("n_shingles").alias("n_shingles"))
    groups = groups.join(sizes, F.col("id") == F.col("r_id"))
    weights = groups.groupBy(F.col("component_id").alias("g")).agg(F.sum("n_shingles").alias("weight"))
    members = groups.join(weights, F.col("component_id") == F.col("g")).select("id", "g", "weight", "n_shingles")
    members = written(members, "members")
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    bundles = max(1, -(-total // opts.block))
    placed = block_pairs(members, "g", F.ceil(F.col("weight") / opts.block), F.xxhash64("id"))
    full = texts.join(placed, F.col("doc_id") == F.col("id")).select(
        "task", "id", "text", F.pmod("task", F.lit(bundles)).alias("bundle"))
    links = full.groupBy("bundle").applyInArrow(_verify(opts), "a long, b long")
    found = connected_components(links)
    # classes take their representative's component, documents their class's
    reached = classes.join(found.withColumnRenamed("id", "f_id"), F.col("id") == F.col("f_id"), "left").select(
        F.col("digest").alias("c_digest"), F.coalesce("component_id", "id").alias("class_component"))
    out = marked.select("doc_id", "n_shingles", "digest").join(reached, F.col("digest") == F.col("c_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, opts: Settings = Settings()) -> DataFrame:
    """The documents that are kept, with all their columns: one of every component."""
    (name,) = free_names(docs, "gone_id")
    gone = near_copies(docs, opts).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)
