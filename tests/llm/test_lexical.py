"""Lexical search: trees and whole results against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from stakeflow.llm import lexical

from .cases import awkward, empty, frame, prose, rows
from .test_resampling import plain_terms

ITEMS = "item_id long, text string, doc_id long, term string, score long"


def plain_search(docs, items, k=50):
    texts = [(d, plain_terms(t)) for d, t, *_ in docs]
    texts = [(d, ws) for d, ws in texts if ws]
    n_docs, n_terms = len(texts), sum(len(ws) for _, ws in texts)
    df = Counter(w for _, ws in texts for w in set(ws))
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = {}
    for item, terms in wanted.items():
        found = []
        for d, ws in texts:
            tf, m = Counter(ws), 50 + 50 * len(ws) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms)
            if score > 0:
                found.append((-score, d is None, d or 0))
        if found:
            out[item] = [(None if null else d, -s) for s, null, d in sorted(found)[:k]]
    return out


def search(spark, docs, items, k=50):
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEMS)
    got = {}
    for r in sorted(lexical.search_items(frame(spark, docs), table, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    assert all([x[0] for x in own] == list(range(1, len(own) + 1)) for own in got.values())
    return {i: [x[1:] for x in own] for i, own in got.items()}


@pytest.mark.parametrize("block_terms", [None, 30])
def test_equals_scoring_every_document(spark, monkeypatch, block_terms):
    if block_terms:
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    docs = awkward() + rows([(100 + i, prose(i % 90, 5 + i % 70)) for i in range(300)])
    items = [(1, prose(3, 20)), (2, prose(4, 40)), (2, "one two"), (3, None), (4, ""), (5, "nowhere"), (None, prose(9, 15)), (6, prose(3, 20)), (6, prose(3, 20))]
    for k in (5, 50):
        assert search(spark, docs, items, k) == plain_search(docs, items, k)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two", 1, "x", 2)], ITEMS)
    assert lexical.search_items(empty(spark), items).count() == 0
    assert lexical.search_items(frame(spark, rows([(1, None)])), items).count() == 0
    assert lexical.search_items(frame(spark, awkward()), items.limit(0)).count() == 0


def test_tree_bounds_and_search():
    r = random.Random(5)
    size, n = 60, 900
    paths = []
    for d in range(n):
        own = sorted({min(size - 1, int(r.expovariate(0.12))) for _ in range(r.randint(1, 14))})
        paths.append(np.array(own if r.random() < 0.7 or not paths else paths[-1]))
    tfs = [np.array([r.randint(1, 9) for _ in p]) for p in paths]
    norms = np.array([r.randint(50, 400) for _ in paths])
    tree = lexical.Tree(np.arange(n) // 2, norms, paths, tfs, size, leaf=8)
    leaves = [x for x in tree.nodes if not x.children]
    assert sorted(i for x in leaves for i in range(x.lo, x.hi)) == list(range(n))
    assert all(x.hi - x.lo <= 8 for x in leaves)
    for k, node in enumerate(tree.nodes):
        a, b = tree.begin[node.lo], tree.begin[node.hi]
        assert all(tree.top_tf[k, t] >= f for t, f in zip(tree.ranks[a:b], tree.tfs[a:b]))
        assert tree.least_norm[k] == tree.norms[node.lo : node.hi].min()
    for _ in range(20):
        terms = np.array(sorted(r.sample(range(size), 7)))
        weights = np.array([r.randint(0, 3000) for _ in terms])
        spread = np.zeros(size, np.int64)
        spread[terms] = weights
        best = []
        tree.search(terms, weights, spread, best, 10)
        scores = [(sum(int(spread[t]) * (1_000_000_000 * int(f) // (1000 * int(f) + 20 * int(m))) for t, f in zip(p, c)), -(d // 2))
                  for d, (p, c, m) in enumerate(zip(paths, tfs, norms))]
        assert sorted(best, reverse=True) == sorted((s for s in scores if s[0] > 0), reverse=True)[:10]
