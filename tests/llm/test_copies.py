"""Near copies, repeated passages, components, near vectors and nearest vectors against brute force."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stakeflow.llm import ann, components, minhash, passages, queries, vectors

from ..conftest import SF
from .cases import awkward, empty, frame, prose, rows, words


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, up, down):
    """{doc_id: (set size, smallest reachable id)}"""
    ids = sorted({d for d, _ in docs})
    sets = {d: shingles(next(t for e, t in docs if e == d), n) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and down * both >= up * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in ids}


def noisy_group(size, seed=0, length=60, first=100):
    """Copies with one or two words changed, so that similarities lie on both sides of the threshold."""
    r = np.random.default_rng(seed)
    base = prose(77 + seed, length).split()
    out = []
    for i in range(size):
        own = list(base)
        for at in r.choice(length, r.integers(0, 4), replace=False):
            own[at] = f"x{i}y{at}"
        out.append((first + i, " ".join(own)))
    return out


@pytest.mark.parametrize("opts", [
    minhash.Settings(),
    minhash.Settings(leaf=8, block=400, depth=2),  # branches, then block pairs on both levels
    minhash.Settings(shingle=5, similarity=Fraction(8, 10)),
], ids=["default", "small-nodes", "five-words"])
def test_near_copies_match_brute_force(spark, opts):
    data = awkward() + rows(noisy_group(60)) + rows([(300 + i, prose(900 + i, 30)) for i in range(20)])
    want = brute([(d, t) for d, t, *_ in data if d is not None], opts.shingle, opts.similarity.numerator, opts.similarity.denominator)
    got = minhash.near_copies(frame(spark, data), opts).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_near_copies_of_empty_and_columns(spark):
    assert minhash.near_copies(empty(spark)).count() == 0
    docs = frame(spark, awkward())
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 5, 6, 7, 8, 10, 12, 13]


def test_registered_near_dedup(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_near_dedup(spark, SF).collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (205, 209), (7, 7), (301, 300), (301, 300)]
    got = {r.id: r.component_id for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {201: 201, 205: 201, 209: 201, 300: 300, 301: 300}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeated_runs(docs, n):
    """{doc: starts of the n-word runs that a smaller document holds}"""
    first, out = {}, {}
    for d, t in sorted(docs):
        w = words(t)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), d) < d:
                out.setdefault(d, set()).add(k)
    return out


def passage_documents():
    shared, near = prose(500, 55), prose(501, 90).split()
    changed = list(near)
    changed[44] = "other"
    docs = [(200 + i, f"{prose(600 + i, 30)} {shared} {prose(700 + i, 25)}") for i in range(12)]
    docs += [(300, prose(800, 20) + " " + " ".join(near)), (301, " ".join(changed) + " " + prose(801, 70))]
    docs += [(310, prose(810, 49) + " " + prose(811, 60)), (311, prose(810, 49) + " " + prose(812, 60))]  # one word short
    docs += [(330, prose(830, 30) + " the" * 400 + " " + prose(831, 30)), (331, prose(832, 60) + " the" * 300 + " " + prose(831, 30))]  # cycles
    docs += [(332, prose(833, 40) + " one two three" * 90), (333, "two three" + " one two three" * 60 + prose(834, 20))]
    docs += [(320, f"{prose(820, 60)} {prose(821, 9)} {prose(820, 60)}")]  # a repeat inside one document
    return docs


def test_repeated_passages(spark):
    data = awkward() + rows(passage_documents())
    spans = passages.repeated_passages(frame(spark, data)).collect()
    got = {}
    for s in spans:
        assert s.n_words >= 50 and s.first_doc_id < s.doc_id
        got.setdefault(s.doc_id, set()).update(range(s.start, s.start + s.n_words))
    want = repeated_runs({(d, t) for d, t, *_ in data if d is not None}, 50)
    assert set(want) <= set(got)
    for d, starts in want.items():  # no repeated run stays whole, and at most chance neighbours of one stay at all
        places = {k + i for k in starts for i in range(50)}
        assert len(places - got[d]) <= 2
    assert got[301] == set(range(90))
    assert not got.keys() & {1, 200, 300, 310, 311, 320, 4, 5, 6, 7, 8, 9, 10, 12, 13}
    assert got[205] == set(range(30, 85))


def families():
    """Documents that share 45 words, which are no passage; the two or three of a family share eight words more."""
    common = prose(900, 45)
    docs = [(400 + i, f"{prose(2000 + i, 60)} {common} {prose(3000 + i, 60)}") for i in range(20)]
    for f in range(24):
        first, second = (common, prose(4000 + f, 8)) if f % 2 else (prose(4000 + f, 8), common)
        docs += [(500 + 10 * f + k, f"{prose(5000 + 10 * f + k, 40)} {first} {second} {prose(6000 + 10 * f + k, 40)}") for k in range(2 + f % 2)]
    return docs


@pytest.mark.parametrize("few,held", [(4, 512), (1, 2)])
def test_passages_beside_a_common_part_are_found(spark, monkeypatch, few, held):
    monkeypatch.setattr(passages, "FEW", few)
    monkeypatch.setattr(passages, "HELD", held)
    docs = families()
    spans = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    got = {(s.doc_id, s.first_doc_id): range(s.start, s.start + s.n_words) for s in spans}
    want = {(d, 500 + 10 * ((d - 500) // 10)) for d, _ in docs if d >= 500 and d % 10}
    assert set(got) == want
    assert all(set(range(40, 93)) <= set(r) for r in got.values())


def test_needed_pairs_leave_out_only_what_a_third_window_shares():
    r = np.random.default_rng(5)
    common, more = r.integers(0, 1 << 60, 50), r.integers(0, 1 << 60, 30)
    own = lambda n: r.integers(1 << 61, 1 << 62, n)
    texts = [np.r_[own(30), common, own(30)] for _ in range(6)]
    texts += [np.r_[own(30), common, more] for _ in range(2)] + [texts[0].copy()]
    every = np.concatenate(texts).astype(np.uint64)
    place = np.full(9, 40)
    later, earlier = passages.needed_pairs(np.arange(9), place - 40, place, place - 40 + 109, every, 46)
    assert set(zip(later.tolist(), earlier.tolist())) == {(i, 0) for i in range(1, 9)} | {(7, 6)}


def plain_pairs(doc, left, right, every, width):
    """Pairs of windows that no earlier partner of the later one stands in for."""
    sizes = right - left + 1
    first = np.cumsum(sizes) - sizes
    held = [{(int(every[first[i] + k]), int(left[i] + k)) for k in range(sizes[i])} for i in range(len(doc))]
    out = set()
    for x in range(len(doc)):
        own = []
        for z in range(x):
            if doc[z] < doc[x] and min(right[x], right[z]) - max(left[x], left[z]) + 1 >= width:
                if all({v for v, _ in held[x] - held[y]} & {v for v, _ in held[z] - held[y]} for y in own):
                    own.append(z)
        out |= {(x, z) for z in own}
    return out


@pytest.mark.parametrize("together", [256, 1])
def test_needed_pairs_match_a_plain_search(monkeypatch, together):
    monkeypatch.setattr(passages, "TOGETHER", together)
    for seed in range(60):
        r = np.random.default_rng(seed)
        n, base = int(r.integers(2, 14)), r.integers(1, 50, 24)
        lo, hi, every = r.integers(0, 6, n), r.integers(15, 24, n), []
        for i in range(n):
            own = base.copy()
            at = r.choice(24, r.integers(0, 8), replace=False)
            own[at] = r.integers(50, 58, len(at))
            if r.random() < 0.3:
                own = np.insert(own, 20, 60)
            every.append(own[lo[i] : hi[i] + 1])
        every = np.concatenate(every).astype(np.uint64)
        later, earlier = passages.needed_pairs(np.arange(n), lo, np.full(n, 10), hi, every, 8)
        got = set(zip(later.tolist(), earlier.tolist()))
        assert len(got) == len(later) and got == plain_pairs(np.arange(n), lo - 10, hi - 10, every, 8)


def test_needed_pairs_of_several_groups_match_a_plain_search(monkeypatch):
    """Small groups together and one of more than 64 classes, with shingles that stand at several places."""
    monkeypatch.setattr(passages, "WORDS", 1 << 9)
    for seed in range(6):
        r = np.random.default_rng(seed)
        group, doc, lo, hi, every = [], [], [], [], []
        for g, n in enumerate([5, 2, 130, 9]):
            base = r.integers(1, 50, 24)
            doc += range(n)
            group += [g] * n
            for _ in range(n):
                lo.append(int(r.integers(0, 6)))
                hi.append(int(r.integers(15, 24)))
                own = base.copy()
                at = r.choice(24, r.integers(0, 8), replace=False)
                own[at] = r.integers(50, 58, len(at))
                every.append(own[lo[-1] : hi[-1] + 1])
        group, doc, lo, hi = (np.array(v) for v in (group, doc, lo, hi))
        later, earlier = passages._needed(group, doc, lo - 10, hi - 10, np.concatenate(every).astype(np.uint64), 8)
        got, want = set(zip(later.tolist(), earlier.tolist())), set()
        for g in range(4):
            at = np.flatnonzero(group == g)
            values = np.concatenate([every[i] for i in at])
            want |= {(int(at[x]), int(at[y])) for x, y in plain_pairs(doc[at], lo[at] - 10, hi[at] - 10, values, 8)}
        assert got == want and len(got) == len(later)


def test_pairs_of_several_groups_at_once():
    """Groups of copies, of windows that share no more than the first has, and of two families."""
    r = np.random.default_rng(8)
    opts = passages.Settings()
    common, more = r.integers(0, 1 << 16, 60), r.integers(0, 1 << 16, 30)
    own = lambda n: r.integers(0, 1 << 16, n)
    copy = np.concatenate([own(30), common, own(30)])
    groups = [[copy] * 4, [np.concatenate([own(30), common, own(30)]) for _ in range(5)]]
    groups.append([np.concatenate([own(30), common, more if i % 2 else own(30)]) for i in range(6)])
    rows = [(g, d, text.astype(np.uint16).tobytes()) for g, texts in enumerate(groups) for d, text in enumerate(texts)]
    group, doc = (np.array([v[k] for v in rows]) for k in (0, 1))
    place = np.full(len(rows), 0)
    later, earlier = passages._group_pairs(group, doc, place, place + 50, place + 115, [v[2] for v in rows], opts)
    got = {(int(group[x]), int(doc[x]), int(doc[y])) for x, y in zip(later, earlier)}
    assert (group[later] == group[earlier]).all()
    want = {(0, i, 0) for i in range(1, 4)} | {(1, i, 0) for i in range(1, 5)} | {(2, i, 0) for i in range(1, 6)} | {(2, 3, 1), (2, 5, 1)}
    assert got == want


def test_groups_of_many_hundred_windows_are_not_split(spark, monkeypatch):
    def split(opts):
        raise AssertionError("split")

    monkeypatch.setattr(passages, "_split", split)
    common = prose(901, 55)
    docs = [(i, f"{prose(20_000 + i, 30)} {common} {prose(30_000 + i, 30)}") for i in range(600)]
    spans = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {(s.doc_id, s.first_doc_id) for s in spans} == {(i, 0) for i in range(1, 600)}
    assert all(s.start <= 30 and s.start + s.n_words >= 85 for s in spans)


def test_larger_groups_that_a_task_can_hold_are_not_split(spark, monkeypatch):
    """The rows of a group of some more windows than ``HELD`` are the same, whether it is held or split."""
    common = prose(902, 55)
    docs = [(i, f"{prose(20_000 + i // 2, 30)} {common} {prose(30_000 + i // 2, 30)}") for i in range(120)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(passages, "HELD", 20)
    calls, split = [], passages._split
    monkeypatch.setattr(passages, "_split", lambda opts: calls.append(1) or split(opts))
    held = sorted(passages.repeated_passages(docs).collect())
    assert not calls
    monkeypatch.setattr(passages, "HELD_SHINGLES", 0)
    assert sorted(passages.repeated_passages(docs).collect()) == held and calls
    assert {s.doc_id for s in held} == set(range(1, 120))


def test_cut_passages_keeps_the_rest(spark):
    docs = frame(spark, awkward() + rows(passage_documents()))
    out = passages.cut_passages(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[205].text == f"{prose(605, 30)} {prose(705, 25)}" and by[205].n_chars == len(by[205].text)
    assert by[200].text == dict(passage_documents())[200]
    assert 2 not in by and 11 not in by  # nothing but repeats
    assert by[6].text is None and by[5].text == "" and by[7].text == " \t\n"
    assert passages.cut_passages(empty(spark)).count() == 0
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_compact_windows_are_the_long_cartesian_nodes():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 62, 400).astype(np.uint64)
    values[50:60] = values[70]
    starts, ends = np.array([0, 130, 133, 133]), np.array([130, 133, 133, 400])
    left, centre, right = passages.compact_windows(values, starts, ends, 12)
    got = set(zip(left.tolist(), centre.tolist(), right.tolist()))
    want = set()

    def tree(lo, hi):
        if hi - lo >= 12:
            c = min(range(lo, hi), key=lambda i: (int(values[i]) >> 24, i))
            want.add((lo, c, hi - 1))
            tree(lo, c)
            tree(c + 1, hi)

    for lo, hi in zip(starts.tolist(), ends.tolist()):
        tree(lo, hi)
    assert got == want


def spans_of(same):
    x = np.arange(len(same), dtype=np.uint16)
    return passages.similar_spans(x, np.where(same, x, x + 1000).astype(np.uint16), [0], passages.Settings())


def test_similar_spans():
    same = np.ones(200, bool)
    assert spans_of(same) == [(0, 200)]
    same[60:120] = False
    assert spans_of(same) == [(0, 60), (120, 200)]
    one = np.ones(90, bool)
    one[44] = False
    assert spans_of(one) == [(0, 90)]
    assert spans_of(same[:49]) == []
    x = np.arange(200, dtype=np.uint16)
    added = np.r_[x[:70], [900], x[70:100]].astype(np.uint16)  # a word more in the middle
    assert passages.similar_spans(x[30:100], added[20:], [10, 11], passages.Settings()) == [(0, 70)]
    assert passages.similar_spans(added[30:], x, [30, 29], passages.Settings()) == [(0, 71)]
    # both halves alone are too short, and far apart they are no passage
    apart = np.r_[x[:30], np.arange(500, 530), x[30:60]].astype(np.uint16)
    assert passages.similar_spans(x[:60], apart, [0, 30], passages.Settings()) == []


def test_spans_of_many_pairs_are_those_of_each(monkeypatch):
    monkeypatch.setattr(passages, "COMPARED", 64)
    opts, r = passages.Settings(), np.random.default_rng(3)
    xs, ys, offsets = [], [], []
    for k in range(60):
        x = r.integers(0, 3 if k % 4 == 0 else 1 << 16, int(r.integers(3, 150))).astype(np.uint16)
        cut = sorted(r.integers(0, len(x) + 1, 2).tolist())
        y = np.concatenate([r.integers(0, 9, k % 7), x[: cut[0]], r.integers(0, 9, k % 3), x[cut[0] : cut[1]], x[cut[1] :]]).astype(np.uint16)
        xs.append(x)
        ys.append(y)
        offsets.append(sorted({k % 7, int(r.integers(-5, 20))}))
    pair = np.repeat(np.arange(60), [len(v) for v in offsets])
    got = passages._similar_spans([x.tobytes() for x in xs], [y.tobytes() for y in ys], pair, np.concatenate(offsets), opts)
    assert got == [passages.similar_spans(*v, opts) for v in zip(xs, ys, offsets)] and sum(map(len, got)) > 20
    for x, own in zip(xs, got):
        assert all(hi - lo >= opts.words and hi <= len(x) for lo, hi in own)


def edited(passage, how, r):
    out = list(passage)
    at = r.randrange(6, len(out) - 6)
    if how == "changed":
        out[at] = f"new{r.randrange(10**6)}"
    elif how == "added":
        out.insert(at, f"new{r.randrange(10**6)}")
    elif how == "missing":
        del out[at]
    return out


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_edited_passages(spark):
    """Passages of 55, 80 and 150 words with one word changed, added or missing, in otherwise unrelated documents."""
    r = random.Random(12)
    texts, wanted, clean = [], {}, set()
    number = 10_000
    for length in (55, 80, 150):
        for how in ("same", "changed", "added", "missing"):
            for _ in range(50):
                passage = prose(number * 3, length).split()
                second = edited(passage, how, r)
                if jaccard(passage, second) >= 0.8 and len(second) >= 50:
                    wanted[number + 1] = (how, length)
                for k, own in enumerate((passage, second)):
                    texts.append((number + k, " ".join([*prose(number * 7 + k, r.randint(5, 80)).split(), *own, *prose(number * 11 + k, r.randint(5, 80)).split()])))
                number += 2
    for _ in range(200):
        clean.add(number)
        texts.append((number, prose(number * 13, 120)))
        number += 1
    found = {}
    for s in passages.repeated_passages(frame(spark, rows(texts))).collect():
        found[s.doc_id] = max(found.get(s.doc_id, 0), s.n_words)
    by = {}
    for doc, kind in wanted.items():
        by.setdefault(kind[0], []).append(found.get(doc, 0) >= 0.8 * kind[1])
    shares = {how: sum(hits) / len(hits) for how, hits in by.items()}
    assert shares["same"] == 1.0 and all(shares[how] >= 0.93 for how in ("changed", "added", "missing")), shares
    assert not clean & set(found)


VECTORS = "vec_id long, embedding array<float>, label int, id long, copies long, leaf string, shard int, block int"


def clustered(n=400, seed=2, dims=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dims))
    x = centres[r.integers(0, 12, n)] * r.uniform(0.5, 3, (n, 1)) + 0.09 * r.standard_normal((n, dims)) * r.integers(0, 4, (n, 1))
    x[50:60] = x[50]
    x[70] = 2 * x[50]
    return x.astype(np.float32)


def vector_rows(x, labels):
    return [(i, v.tolist(), labels[i], 1, 2, "l", 3, 4) for i, v in enumerate(x)]


ODD = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [1.0] * 15 + [None], 0), (9005, [1.0] * 15 + [float("nan")], 0),
       (9006, [float("inf")] + [1.0] * 15, 0), (9007, [1.0] * 16, None), (9008, [1.0] * 8, 0)]


@pytest.mark.parametrize("opts", [vectors.Settings(), vectors.Settings(leaf=40, task=60)], ids=["default", "small-leaves"])
def test_near_vectors_match_brute_force(spark, opts):
    x = clustered()
    labels = [i % 2 for i in range(len(x))]
    data = vector_rows(x, labels) + [(i, v, y, 1, 2, "l", 3, 4) for i, v, y in ODD] + [(None, x[0].tolist(), 0, 1, 2, "l", 3, 4)]
    got = vectors.near_vectors(spark.createDataFrame(data, VECTORS).repartition(3), opts).collect()
    assert len(got) == len(data)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    for r in got:
        if r.vec_id is not None and r.vec_id < 9000:
            assert (r.n_links, r.component_id, r.kept) == (int(link[r.vec_id].sum()), root[r.vec_id], root[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id and r.kept


def test_all_links_of_many_vectors(spark):
    """24,000 clustered vectors in four labels: every link of brute force is found, and none besides."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((4000, 32))
    own = r.integers(0, 4000, 24_000)
    x = (centres[own] + r.choice([0.02, 0.12, 0.2], (24_000, 1)) * r.standard_normal((24_000, 32))).astype(np.float32)
    labels = own % 4
    data = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    got = {v.vec_id: v.n_links for v in vectors.near_vectors(spark.createDataFrame(data).repartition(8)).select("vec_id", "n_links").collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = 0
    for label in range(4):
        at = np.flatnonzero(labels == label)
        near = (u[at] @ u[at].T >= 0.98).sum(1) - 1
        links += int(near.sum()) // 2
        assert [got[i] for i in at.tolist()] == near.tolist()
    assert links > 5_000


def test_near_vectors_of_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest_vectors_recall(spark):
    x = clustered(900)
    data = vector_rows(x, [0] * len(x)) + [(i, v, y, 1, 2, "l", 3, 4) for i, v, y in ODD]
    found = ann.nearest_vectors(spark.createDataFrame(data, VECTORS).repartition(3), F.col("vec_id") % 20 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 900, 20)}
    hits = 0
    for q, own in got.items():
        score = x.astype(float) @ x[q].astype(float)
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(score, 12))).tolist() if i != q][:20]
        own.sort()
        assert [r for r, *_ in own] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in own) and q not in {v for _, v, _ in own}
        hits += len(set(order) & {v for _, v, _ in own})
    assert hits >= 0.97 * 20 * len(got)


def test_one_large_shard_is_reached_everywhere():
    """24,000 clustered vectors of uneven lengths in one graph: no query is left without its neighbours."""
    r = np.random.default_rng(5)
    centres = 3 * r.standard_normal((300, 24))
    x = (centres[r.integers(0, 300, 24_000)] + 0.4 * r.standard_normal((24_000, 24))) * r.uniform(0.5, 2, (24_000, 1))
    norm = np.sqrt((x * x).sum(1).max())
    opts = ann.Settings()
    graph = ann.Graph(np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))]) / norm, opts)
    q = x[::60]
    found = graph.nearest(np.column_stack([q, np.zeros(len(q))]) / norm, opts.search_width)
    shares = []
    for i in range(len(q)):
        score = x @ q[i]
        want = set(np.argsort(-score)[:20].tolist())
        own = found[i][found[i] >= 0]
        assert len(own) == len(set(own.tolist()))
        got = own[np.argsort(-score[own])[:20]]
        shares.append(len(want & set(got.tolist())) / 20)
    assert np.mean(shares) >= 0.95 and min(shares) >= 0.5, (np.mean(shares), min(shares))


def test_nearest_vectors_with_few_candidates(spark):
    data = [(i, [1.0, float(i % 3)], 0, 1, 2, "l", 3, 4) for i in range(0, 8)]
    got = ann.nearest_vectors(spark.createDataFrame(data, VECTORS), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(k + 1, v, 1.0) for k, v in enumerate(range(1, 8))]
    assert ann.nearest_vectors(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0
