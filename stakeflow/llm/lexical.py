"""Ranked lexical search over all documents by branch-and-bound in document FP-trees.

The terms of the query items are a bounded vocabulary; one pass over the texts reduces each document
to its length and its vector of (vocabulary term, count), and writes it. Sorted by falling document
frequency, such a vector is a path, and documents with a common beginning share it: a tree. Every
task builds trees of a bounded number of its documents and searches them for every item. A node
holds the largest count of each term and the smallest length norm of its subtree, so the score of
no document below can exceed the score of a made-up document with those counts and that norm. The
walk goes depth first to the child with the highest bound and leaves subtrees that cannot beat the
item's k-th best document so far. Bounds and scores use the same integer arithmetic, so the result
is exact.

Items are dealt into blocks of about ``BLOCK_TERMS`` terms, one pass over the documents each, so the
vocabulary that tasks hold is bounded however many items there are.

Defined cases: a null or empty text has no terms, counts for nothing and is never found; rows that
share an ``item_id`` (null too) are one item with the terms of all; repeated documents are ranked each;
a null ``doc_id`` comes last among equal scores; items without a known term and empty tables give no
rows. Other columns are ignored. ``doc_id`` and ``item_id`` are integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeflow.llm import terms as T
from stakeflow.llm.storage import written
from stakeflow.operators.scan import top_per_key

#: (item, term) pairs whose items are searched together.
BLOCK_TERMS = 16_384
#: Documents of a leaf, and cells (nodes x terms) of a tree's table of largest counts.
LEAF_DOCS = 64
TREE_CELLS = 1 << 24
TREE_DOCS = 16_384

SCALE = 1_000_000_000
NULL_ID = (1 << 63) - 1  # place of a null id in the order


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) pairs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, rows, part in T.term_chunks(batch.column(1)):
                words = [sorted({part.text(i).decode() for i in range(*part.first[k : k + 2])}) for k in range(rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(words, pa.list_(pa.string()))], ["item_id", "terms"])

    found = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, "item_id long, terms array<string>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


class Vocabulary:
    """Terms of a block of items, found in texts by key and then by bytes."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        self.lengths = np.array([len(w) for w in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(raw) + b" " * 8, np.uint8)
        keys = T.span_keys(self.data, self.starts, self.lengths)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        _, self.copies = np.unique(self.keys, return_counts=True)

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, part: T.Terms) -> np.ndarray:
        """Number of each term in the vocabulary, -1 for all others."""
        out = np.full(len(part.starts), -1, np.int64)
        if not len(self) or not len(out):
            return out
        keys = T.span_keys(part.data, part.starts, part.lengths)
        at = np.searchsorted(self.keys, keys)
        # terms of one key stand side by side
        for step in range(int(self.copies.max())):
            near = np.minimum(at + step, len(self) - 1)
            word = self.order[near]
            on = np.flatnonzero((self.keys[near] == keys) & (out < 0) & (self.lengths[word] == part.lengths))
            on = on[T.same_bytes(self.data, self.starts[word[on]], part.data, part.starts[on], part.lengths[on])]
            out[on] = word[on]
        return out


def term_vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document: all its terms, and counts of those in the vocabulary."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for batch in batches:
            for lo, rows, part in T.term_chunks(batch.column(1)):
                n = part.counts()
                ids = vocabulary.ids(part)
                known = ids >= 0
                doc = np.repeat(np.arange(rows), n)[known]
                pairs, tfs = np.unique(doc * size + ids[known], return_counts=True)
                offsets = np.searchsorted(pairs // size, np.arange(rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (pairs % size, tfs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        vectors, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Node:
    """A subtree: documents ``lo`` to ``hi`` of the sorted order; leaves have no children."""

    lo: int
    hi: int
    children: list[int] = field(default_factory=list)


class Tree:
    """FP-tree of documents given as ranks (by falling frequency), counts and norms."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, ranks: list[np.ndarray], tfs: list[np.ndarray], size: int, leaf: int = LEAF_DOCS):
        self.leaf, self.paths = leaf, []
        packed = [r.astype(">u4").tobytes() for r in ranks]
        order = sorted(range(len(packed)), key=lambda d: (packed[d], norms[d]))
        self.paths = [ranks[d] for d in order]
        self.ids, self.norms = ids[order], norms[order]
        lengths = np.array([len(p) for p in self.paths], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        self.ranks = np.concatenate([*self.paths, np.zeros(0, np.int64)]).astype(np.int64)
        self.tfs = np.concatenate([*[tfs[d] for d in order], np.zeros(0, np.int64)]).astype(np.int64)
        # what a posting adds to a score, for each unit of its term's weight
        self.parts = (SCALE * self.tfs) // (1000 * self.tfs + 20 * np.repeat(self.norms, lengths))
        self.nodes: list[Node] = []
        self._split()
        self.top_tf = np.zeros((len(self.nodes), size), np.int32)
        self.least_norm = np.zeros(len(self.nodes), np.int64)
        for k in reversed(range(len(self.nodes))):
            self._bounds(k)
        self.paths = []

    def _split(self) -> None:
        """Nodes in depth-first order; a shared run of terms is one step."""
        waiting = [(0, len(self.paths), 0, -1)]
        while waiting:
            lo, hi, depth, parent = waiting.pop()
            me = len(self.nodes)
            self.nodes.append(Node(lo, hi))
            if parent >= 0:
                self.nodes[parent].children.append(me)
            if hi - lo <= self.leaf:
                continue
            a, b = self.paths[lo], self.paths[hi - 1]
            same = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:same] != b[depth:same])
            depth = depth + int(differ[0]) if len(differ) else same
            # documents that end here come first, then one run for each next term
            step = np.fromiter((p[depth] if len(p) > depth else -1 for p in self.paths[lo:hi]), np.int64, hi - lo)
            cuts = [*(np.flatnonzero(np.diff(step)) + 1 + lo).tolist(), hi]
            at = lo
            for n, cut in enumerate(cuts):
                if n + 1 < len(cuts) and cuts[n + 1] - at <= self.leaf:
                    continue  # small neighbours share a leaf
                if step[at - lo] < 0 or cut - at <= self.leaf:  # equal paths and small runs: leaves
                    waiting += [(x, min(x + self.leaf, cut), depth, me) for x in range(at, cut, self.leaf)]
                else:
                    waiting.append((at, cut, depth, me))
                at = cut

    def _bounds(self, k: int) -> None:
        node = self.nodes[k]
        if node.children:
            self.top_tf[k] = self.top_tf[node.children].max(0)
            self.least_norm[k] = self.least_norm[node.children].min()
        elif node.hi > node.lo:
            a, b = self.begin[node.lo], self.begin[node.hi]
            np.maximum.at(self.top_tf[k], self.ranks[a:b], self.tfs[a:b])
            self.least_norm[k] = self.norms[node.lo : node.hi].min()

    def search(self, terms: np.ndarray, weights: np.ndarray, spread: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put this tree's documents among an item's ``k`` best, a heap of (score, -id).

        ``spread`` has the item's weight of every term of the vocabulary, 0 for those it lacks.
        """
        tf = self.top_tf[:, terms].astype(np.int64)
        norm = 20 * self.least_norm[:, None]
        bound = (weights * ((SCALE * tf) // np.maximum(1000 * tf + norm, 1))).sum(1).tolist()
        waiting = [0] if self.nodes else []
        while waiting:
            me = waiting.pop()
            if bound[me] <= 0 or len(best) == k and bound[me] < best[0][0]:
                continue
            node = self.nodes[me]
            if node.children:
                waiting += sorted(node.children, key=bound.__getitem__)
                continue
            a, b = self.begin[node.lo], self.begin[node.hi]
            gains = np.concatenate([[0], np.cumsum(spread[self.ranks[a:b]] * self.parts[a:b])])
            ends = self.begin[node.lo : node.hi + 1] - a
            scores = gains[ends[1:]] - gains[ends[:-1]]
            least = best[0][0] if len(best) == k else 1
            for d in np.flatnonzero(scores >= max(least, 1)).tolist():
                found = (int(scores[d]), -int(self.ids[node.lo + d]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


@dataclass
class Query:
    """An item: its id, and ranks and weights of its known terms."""

    item_id: int | None
    ranks: np.ndarray
    weights: np.ndarray


def _queries(pairs: list, rank: np.ndarray, df: np.ndarray, n_docs: int, numbers: dict[str, int]) -> list[Query]:
    terms: dict[int | None, list[int]] = {}
    for row in pairs:
        if df[numbers[row["term"]]]:
            terms.setdefault(row["item_id"], []).append(numbers[row["term"]])
    out = []
    for item, own in terms.items():
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[t]) + 1))) for t in own]
        out.append(Query(item, rank[own], np.array(weights, np.int64)))
    return out


def _search_block(vectors: DataFrame, pairs: list, words: list[str], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Best ``k`` documents of each item per task."""
    size = len(words)
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()
    df = np.zeros(size, np.int64)
    for row in counted:
        df[row["t"]] = row["df"]
    rank = np.empty(size, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(size)
    queries = _queries(pairs, rank, df, n_docs, {w: n for n, w in enumerate(words)})
    room = min(TREE_DOCS, max(LEAF_DOCS, TREE_CELLS // (2 * size) * LEAF_DOCS // 2))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        spread = np.zeros(size, np.int64)
        ids: list[int] = []
        norms: list[int] = []
        ranks: list[np.ndarray] = []
        tfs: list[np.ndarray] = []

        def flush() -> None:
            if not ids:
                return
            tree = Tree(np.array(ids, np.int64), np.array(norms, np.int64), ranks, tfs, size)
            for query, top in zip(queries, best):
                spread[query.ranks] = query.weights
                tree.search(query.ranks, query.weights, spread, top, k)
                spread[query.ranks] = 0
            for x in (ids, norms, ranks, tfs):
                x.clear()

        for batch in batches:
            doc, n, terms, counts = (batch.column(c) for c in range(4))
            own = doc.to_pylist()
            ends = terms.offsets.to_numpy()
            known = rank[terms.values.to_numpy()]
            many = counts.values.to_numpy().astype(np.int64)
            for d, length in enumerate(n.to_pylist()):
                a, b = ends[d], ends[d + 1]
                if a == b:
                    continue
                order = np.argsort(known[a:b])
                ids.append(NULL_ID if own[d] is None else own[d])
                norms.append(50 + 50 * length * n_docs // n_terms)
                ranks.append(known[a:b][order])
                tfs.append(many[a:b][order])
                if len(ids) >= room:
                    flush()
        flush()
        rows = [(q.item_id, None if -i == NULL_ID else -i, s) for q, top in zip(queries, best) for s, i in top]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return vectors.mapInArrow(search, "item_id long, doc_id long, score long")


def search_items(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of each item."""
    pairs = written(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        # about BLOCK_TERMS pairs, or those of one longer item
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        words = sorted({row["term"] for row in own})
        if not words:
            continue
        vectors = written(term_vectors(docs, Vocabulary(words)), "term-vectors")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            part = written(_search_block(vectors, own, words, n_docs, n_terms, k), "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    top = top_per_key(found, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, F.col("doc_id"))
    return top.select("item_id", F.col("rn").cast("int").alias("rank"), "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, c GROUP BY term, n_docs),
m AS (SELECT doc_id, 50 + (50 * CAST(len(ws) AS BIGINT) * n_docs) // n_terms AS m FROM d, c WHERE len(ws) > 0),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
