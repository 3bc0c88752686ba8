"""Personal data in texts: base patterns, and further spans by weak supervision.

Every text is scanned once. The base patterns (email, ip, card, phone) give the spans that always stay.
Looser patterns propose candidates beside them: spelled-out addresses, IPv6, cards of other lengths,
phone numbers without a plus, social security numbers, names. Labelers of three sorts (regex,
gazetteer, context) vote on every span: personal, not personal, or nothing. A span's kind, votes
and length class make its pattern; the corpus is reduced to counts of patterns, a table whose size
is bounded by the number of labelers (``PATTERNS`` rows), whatever the corpus holds. On it
expectation-maximisation estimates each labeler's reliability per kind and the probability of each
pattern, with base spans known to be personal. A logistic span classifier is trained on these
probabilities, with all votes but that of the base patterns themselves, and accepts or rejects
the candidates.

Defined cases: a null or empty text has no spans; texts are scanned whole, in time linear in their
length; repeated rows are scanned each; candidates that touch a base span, or a candidate of an
earlier kind, are left out; where no candidate exists the classifier is not asked; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.storage import written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "name")
LABELERS = ("base", "check", "shape", "gazetteer", "before", "near", "edge")
YES, NO, NONE = 0, 1, 2
LENGTH_CLASSES = 6
VOTES = 3 ** len(LABELERS)
#: Number of possible patterns: kind, base or candidate, votes, length class.
PATTERNS = len(KINDS) * 2 * VOTES * LENGTH_CLASSES

# fixed values: the base patterns of the contract; possessive repeats and the look-behind only save backtracking
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]")
LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63}+ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}+){1,5}"
        r"|(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63}+ at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+){1,5}", re.A),
    "ip": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Za-z:])"),
    "card": re.compile(
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-][0-9]{4}){3}|[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5})(?![0-9])"),
    "phone": re.compile(
        r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9A-Za-z+.-]))(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "name": re.compile(r"(?<![A-Za-z])([A-Z][a-z]{1,19}+)(?=\.? ([A-Z][a-z]{1,29}))"),
}

# small word lists of this module's own choice
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca au ch at be br cn in jp ru se".split())
TITLES = frozenset("Mr Mrs Ms Dr Prof Sir Miss Herr Frau".split())
GIVEN = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica "
    "Sarah Karen Anna Maria Peter Paul Mark George Laura Emma Olivia Sophie Marie Pierre Jean Claire Hans Klaus Jose Carlos Juan Luis".split())
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to|reach)\b"),
    "ip": re.compile(r"\b(?:ip|ipv4|ipv6|host|address|from|client|server)\b"),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|paid)\b"),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|dial)\b"),
    "ssn": re.compile(r"\b(?:ssn|social security|tax)\b"),
    "name": re.compile(r"\b(?:name|by|dear|from|contact|signed|author)\b"),
}
AGAINST = re.compile(r"\b(?:order|invoice|version|isbn|issn|page|figure|item|part|ref|reference|serial|model|ticket|build|release|chapter|section|id)\b")


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Matches of local part, @ and domain: every @ is tried once, its local part reaches left up to the last match."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), True
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _is_card(found: str) -> bool:
    digits = _digits(found)
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """Leftmost matches of the base patterns by kind, and whether each passes its check."""
    out: dict[str, list[tuple[int, int, bool]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if DIGIT.search(text):
        out["ip"] = [(*m.span(), _is_ip(m[0])) for m in IP.finditer(text)]
        out["card"] = [(*m.span(), _is_card(m[0])) for m in CARD.finditer(text)]
        if "+" in text:
            out["phone"] = [(*m.span(), 8 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    digits = DIGIT.search(text)
    for kind in KINDS:
        if kind == "email" and not ("at]" in text or "at)" in text or "at}" in text or " at " in text and " dot " in text):
            continue
        if kind in ("card", "phone", "ssn") and not digits or kind == "ip" and ":" not in text:
            continue
        for m in LOOSE[kind].finditer(text):
            if kind == "name":
                if m[1] in GIVEN or m[1] in TITLES:
                    yield kind, m.start(), m.end(2)
            else:
                yield kind, *m.span()


def _vote(yes: bool, no: bool) -> int:
    return YES if yes else NO if no else NONE


def _votes(kind: str, text: str, start: int, end: int, passed: bool | None, near: bool) -> list[int]:
    """Votes in the order of LABELERS; ``passed`` is the base pattern's check, None where it did not match."""
    found, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9]+", found.rstrip(")]}"))[-1].lower()
        check, shape, known = _vote(len(ending) > 1 and ending.isalpha(), ending.isdigit()), _vote("@" in found, " at " in found), _vote(ending in ENDINGS, False)
    elif kind == "ip":
        check, shape = _vote(":" in found or _is_ip(found), True), _vote(":" in found or max(map(len, found.split("."))) <= 3, True)
        known = _vote(False, found.startswith(("0.", "127.", "255.")))
    elif kind == "card":
        check, known = _vote(len(digits) in range(13, 20) and luhn(digits), True), _vote(digits[0] in "3456", True)
        shape = _vote(bool(re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}", found)), True)
    elif kind == "phone":
        check, known = _vote(8 <= len(digits) <= 15, True), _vote(False, digits.startswith("000") or len(set(digits)) == 1)
        shape = _vote(found[0] in "+(", False)
    elif kind == "ssn":
        check = _vote(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000", True)
        shape, known = NONE, _vote(False, len(set(digits)) == 1)
    else:
        first, second = re.split(r"\.? ", found)
        check, shape, known = NONE, _vote(first in TITLES, False), _vote(first in GIVEN or second in GIVEN, False)
    before = text[max(0, start - 40) : start].lower()
    cue, against = CUES[kind].search(before), AGAINST.search(before)
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    glued = any(c.isalnum() or c in "_=/" for c in sides)
    base = NONE if passed is None else YES if passed else NO
    return [base, check, shape, known, _vote(bool(cue) and not against, bool(against)), _vote(near, False), _vote(False, glued)]


def _code(kind: str, base: bool, votes: list[int], length: int) -> int:
    code = KINDS.index(kind) * 2 + base
    for v in votes:
        code = code * 3 + v
    return code * LENGTH_CLASSES + min(length // 6, LENGTH_CLASSES - 1)


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """Base spans (kind, start, end) in order, and every voted span as (start, end, pattern)."""
    matches = base_matches(text)
    base = [(kind, a, b) for kind in BASE_KINDS for a, b, passed in matches[kind] if passed]
    spans = [(kind, a, b, True) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    # failed matches of a base pattern come last: neighbours that it merged may be candidates of their own
    failed = [(kind, a, b, False) for kind in ("ip", "card", "phone") for a, b, passed in matches[kind] if not passed and 12 <= b - a <= 40]
    loose = sorted(_loose(text), key=lambda s: (KINDS.index(s[0]), s[1]))
    for kind, a, b, passed in [*((*s, None) for s in loose), *failed]:
        if not _touches(taken, a, b):
            bisect.insort(taken, (a, b))
            spans.append((kind, a, b, passed))
    marks = sorted(a for _, a, _ in base)
    out = []
    for kind, a, b, passed in spans:
        near = _others_near(marks, a, 120)
        out.append((a, b, _code(kind, passed is True, _votes(kind, text, a, b, passed, near), b - a)))
    return base, out


def _touches(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span overlaps one of ``taken``, which is sorted; base spans of different kinds may overlap."""
    at = bisect.bisect_left(taken, (b, 0))
    return any(a < y for _, y in taken[max(0, at - len(BASE_KINDS)) : at])


def _others_near(marks: list[int], at: int, reach: int) -> bool:
    """Whether a base span other than the one at this place begins within ``reach``."""
    lo, hi = bisect.bisect_left(marks, at - reach), bisect.bisect_right(marks, at + reach)
    return hi - lo > (at in marks[lo:hi])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and its voted spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, starts, ends, codes = [], [], [], [], []
            for text in batch.column(1):
                base, spans = scan(text.as_py() or "")
                counts.append([sum(k == kind for k, _, _ in base) for kind in BASE_KINDS])
                digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                starts.append([a for a, _, _ in spans])
                ends.append([b for _, b, _ in spans])
                codes.append([c for _, _, c in spans])
            lists = [pa.array(v, pa.list_(pa.int32())) for v in (starts, ends, codes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array(digests, pa.string()), *lists],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "starts", "ends", "codes"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, starts array<int>, ends array<int>, codes array<int>")


def _decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, base flag, votes (one column per labeler) and length class of patterns."""
    length, rest = codes % LENGTH_CLASSES, codes // LENGTH_CLASSES
    votes = np.stack([rest // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], 1)
    head = rest // VOTES
    return head // 2, head % 2 == 1, votes, length


@dataclass
class SpanModel:
    """Reliabilities [kind, labeler, personal or not, vote] and the classifier's weights."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def accepts(self, codes: np.ndarray) -> np.ndarray:
        return _features(codes) @ self.weights >= 0


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over pattern counts: (reliability, prior, probability of each pattern).

    ``strength`` is the weight, in spans, of the belief that a labeler's vote is right four times in five.
    """
    kind, base, votes, _ = _decoded(codes)
    belief = strength * np.array([[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]])
    score = (votes == YES).sum(1) - (votes == NO).sum(1)
    p = np.where(base, 1.0, 1 / (1 + np.exp(-score.astype(float))))
    reliability, prior = np.zeros((len(KINDS), len(LABELERS), 2, 3)), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            on = kind == k
            share = np.stack([counts[on] * p[on], counts[on] * (1 - p[on])])
            loose = ~base[on]  # the prior is that of candidates; base spans are known
            prior[k] = (share[0][loose].sum() + 1) / (share[:, loose].sum() + 2)
            for j in range(len(LABELERS)):
                seen = np.stack([share[:, votes[on, j] == v].sum(1) for v in range(3)], 1) + belief
                reliability[k, j] = seen / seen.sum(1, keepdims=True)
        log = np.log(reliability[kind[:, None], np.arange(len(LABELERS)), :, votes]).sum(1)
        log = log + np.log(np.stack([prior[kind], 1 - prior[kind]], 1))
        new = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500))))
        done = not len(p) or np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return reliability, prior, p


def _features(codes: np.ndarray) -> np.ndarray:
    """Kind, votes of all labelers but the base patterns, length class, as 0/1 columns."""
    kind, _, votes, length = _decoded(codes)
    columns = [kind == k for k in range(len(KINDS))]
    columns += [votes[:, j] == v for j in range(1, len(LABELERS)) for v in (YES, NO)]
    columns += [length == n for n in range(LENGTH_CLASSES)]
    return np.stack(columns, 1).astype(float)


def fit(codes: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> SpanModel:
    """Reliabilities, then a logistic classifier on the estimated probabilities (Newton steps, ridge penalty)."""
    reliability, prior, p = estimate(codes, counts)
    x = _features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - guess)) - ridge * w
        curve = (x * (counts * guess * (1 - guess))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(reliability, prior, w)


def pattern_counts(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often each occurs; at most PATTERNS rows come to the driver."""
    rows = scanned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    return np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, ``spans`` (kind:start:end, by kind, then start) and ``n_added``."""
    scanned = written(scan_documents(docs), "scanned")
    codes, counts = pattern_counts(scanned)
    model = fit(codes, counts)
    kept = np.zeros(PATTERNS, bool)
    if len(codes):
        kept[codes] = model.accepts(codes) | _decoded(codes)[1]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, added = [], []
            for starts, ends, own in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "codes"))):
                heads = [c // (VOTES * LENGTH_CLASSES) for c in own]
                chosen = sorted((h // 2, a, b, h % 2) for a, b, c, h in zip(starts, ends, own, heads) if kept[c])
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in chosen))
                added.append(sum(1 - base for *_, base in chosen))
            out = [batch.column(c) for c in range(6)]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return scanned.mapInArrow(
        choose, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long")
