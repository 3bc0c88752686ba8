"""Importance resampling: the interning table, and whole results against a plain count."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stakeflow.llm import resampling, terms

from .cases import awkward, empty, frame, prose, rows

TERM = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_terms_keys_and_slots():
    r = random.Random(1)
    texts = [None, "", " lead", "trail ", "Ab c", "é中 X9_y-zz", "x" * 31 + " " + "y" * 32 + " " + "z" * 100]
    texts += ["".join(r.choice("abAB09 é\n-") for _ in range(r.randint(0, 80))) for _ in range(300)]
    part = terms.split_terms(pa.array(texts))
    want = [plain_terms(t) for t in texts]
    assert [part.text(i).decode() for i in range(len(part.starts))] == [w for ws in want for w in ws]
    assert part.counts().tolist() == [len(ws) for ws in want]
    for n in (1, 2, 3):
        starts, lengths, first = terms.runs(part, n)
        grams = [" ".join(ws[i : i + n]).encode() for ws in want for i in range(len(ws) - n + 1)]
        keys = terms.span_keys(part.data, starts, lengths)
        assert keys.tolist() == [xxhash.xxh64_intdigest(g) for g in grams]
        for hashed in (keys, np.zeros_like(keys), keys % np.uint64(3)):  # bytes tell spans of one key apart
            ids, owner = terms.intern(part.data, starts, lengths, hashed)
            assert len(owner) == len(set(grams))
            assert [grams[owner[i]] for i in ids] == grams
        assert np.diff(first).tolist() == [max(0, len(ws) - n + 1) for ws in want]


def plain_resample(docs, target, n_max=1, percent=10, min_words=20, buckets=10_000):
    def grams(text):
        ws = plain_terms(text)
        return [" ".join(ws[i : i + n]) for n in range(1, n_max + 1) for i in range(len(ws) - n + 1)]

    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t))

    s, t = counts(x for _, x, *_ in docs), counts(x for _, x, *_ in target)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    out = []
    for doc, text, *_ in docs:
        own = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(g.encode()) % buckets) for g in own)
        out.append((doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_terms(text))))
    able = sorted((o for o in out if o[4] >= min_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("n_max", [1, 2])
def test_matches_a_plain_count(spark, n_max):
    docs = awkward() + rows([(100 + i, prose(50 + i, 10 + i % 40)) for i in range(120)])
    target = rows([(1, prose(50, 30)), (2, None), (3, "one two " * 9)])
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"])
           for r in resampling.resample(frame(spark, docs), frame(spark, target), n_max=n_max).collect()]
    every, drawn = plain_resample(docs, target, n_max)
    assert Counter(g[:4] for g in got) == Counter(e[:4] for e in every)
    ranked = sorted((g for g in got if g[4]), key=lambda g: g[4])
    assert [g[:4] for g in ranked] == [d[:4] for d in drawn]
    assert [g[4] for g in ranked] == list(range(1, len(drawn) + 1))


def test_empty_tables(spark):
    docs = frame(spark, awkward())
    assert resampling.resample(empty(spark), docs).count() == 0
    assert resampling.resample(docs, empty(spark)).count() == docs.count()
