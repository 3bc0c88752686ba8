"""Personal data: base spans against the plain patterns, votes, estimation and the added spans."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from stakeflow.llm import personal

from .cases import awkward, empty, frame, prose, rows

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 16 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(kind, *m.span()) for kind, p in PLAIN.items() for m in p.finditer(text or "") if passes(kind, m[0])]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    bits = ["4111 1111 1111 1111", "10.0.0.1", "300.1.2.3.4", "a@b.co", "+1 (555) 123-4567", "123-45-6789", "Dr. John Smith", "joe [at] x [dot] com",
            "378282246310005", "order 4111111111111112", "2001:db8:0:0:0:0:0:1", "1.2.3.4.5.6", "@", "٣٤", "é"]
    for _ in range(5000):
        text = "".join(r.choice("aB0129.@+-() _%é\n:") for _ in range(r.randint(0, 60)))
        assert personal.scan(text)[0] == plain(text)
        text = r.choice(["", " ", ", "]).join(r.choice(bits) for _ in range(r.randint(0, 6)))
        assert personal.scan(text)[0] == plain(text)


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("9" * 300_000, "a@" * 100_000, "1." * 100_000, "1 " * 100_000, "+1" + " " * 100_000, "a" * 300_000 + "@", "John Smith " * 20_000, "ab [at] " * 30_000):
        personal.scan(text)
    assert time.time() - began < 20


def test_patterns_hold_kind_votes_and_length():
    for kind in personal.KINDS:
        votes = [random.Random(kind).randrange(3) for _ in personal.LABELERS]
        code = personal._code(kind, True, votes, 13)
        k, base, v, length = personal._decoded(np.array([code]))
        assert (personal.KINDS[k[0]], base[0], v[0].tolist(), length[0], code < personal.PATTERNS) == (kind, True, votes, 2, True)


def test_estimation_finds_reliabilities():
    """Votes drawn from known reliabilities: the estimate comes close, and tells the two groups apart."""
    r = np.random.default_rng(0)
    true = r.random(40_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    codes, kind = [], personal.KINDS.index("card")
    hits = r.random((len(true), len(right))) < right
    votes = np.where(hits == true[:, None], personal.YES, personal.NO)
    for own in votes:
        codes.append(personal._code("card", False, [personal.NONE, *own.tolist(), personal.NONE], 16))
    count = Counter(codes)
    keys = np.array(sorted(count))
    reliability, prior, p = personal.estimate(keys, np.array([count[k] for k in keys], float))
    assert prior[kind] == pytest.approx(0.3, abs=0.02)
    assert reliability[kind, 1:6, 0, personal.YES] == pytest.approx(right, abs=0.02)
    told = dict(zip(keys.tolist(), p > 0.5))
    assert np.mean([told[c] == t for c, t in zip(codes, true)]) > 0.97
    model = personal.fit(keys, np.array([count[k] for k in keys], float))
    kept = dict(zip(keys.tolist(), model.accepts(keys)))
    assert np.mean([kept[c] == t for c, t in zip(codes, true)]) > 0.97


def corpus():
    r = random.Random(8)
    texts, added = [], []
    for i in range(200):
        own = [f"{prose(i, 6)} mail {prose(i, 1)}.{i}@mail.example.com {prose(i, 3)}", f"call +1 (5{i % 90 + 10}) 555-{1000 + i} {prose(i, 2)}",
               f"{prose(i, 5)} 4111 1111 1111 1111 {prose(i, 2)}", f"host 10.1.{i % 256}.7 {prose(i, 3)}"]
        r.shuffle(own)
        texts.append((i, ". ".join(own)))
    merged = "call +1 (269) 555-3296 4111111111111111 now"  # one plain match too long for either kind
    plan = [(merged, ["phone:5:22", "card:23:39"]), ("phone (415) 555-0134 today", ["phone:6:20"]), ("order 4111111111111112 sent", []),
            ("build 1.2.300.4 out", []), ("token = a1234567890123456b", []), (prose(4, 60), [])]
    for n, (text, spans) in enumerate(plan):
        texts.append((1000 + n, text))
        added.append((1000 + n, spans))
    return rows(texts), dict(added)


def test_whole_results(spark):
    data, want = corpus()
    data = awkward() + data
    got = personal.find_personal(frame(spark, data)).collect()
    assert len(got) == len(data)
    by_text = {(d, t) for d, t, *_ in data}
    for doc, text in by_text:
        base = plain(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        counts = tuple(sum(k == kind for k, *_ in base) for kind in PLAIN)
        mine = [r for r in got if r.doc_id == doc and r.base_sha256 == digest]
        assert mine and all((r.n_email, r.n_ip, r.n_card, r.n_phone) == counts for r in mine)
        assert all({f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""} for r in mine)
    for r in got:
        if r.doc_id in want:
            order = sorted(want[r.doc_id], key=lambda s: personal.KINDS.index(s.split(":")[0]))
            assert (r.spans, r.n_added) == (",".join(order), len(order))
    assert personal.find_personal(empty(spark)).count() == 0
    clean = personal.find_personal(frame(spark, rows([(1, prose(1, 50)), (2, None)]))).collect()
    assert {(r.spans, r.n_added) for r in clean} == {("", 0)}
