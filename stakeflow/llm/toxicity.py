"""Toxicity scores by nearest labelled examples under exact TF-IDF cosine, calibrated votes and evidence.

Terms are words and word stems (first four and five letters, so inflected forms meet). Labelled rows,
a bounded sample, are TF-IDF vectors in two inverted indexes: over every term of the texts, without
any choice of terms (``Vectors``), and over the telling terms, whose presence goes with the label
more than chance would make of all terms tested (``Index``). The first adds up all posting lists of a
query; the lists of the second are cut into blocks of examples with the largest weight of each block,
and a query opens blocks by their upper bounds and leaves those that cannot beat its k-th best
example, so the neighbours of both are exact. Their votes, weighted by nearness, are two inputs of a logistic calibration on examples that are each scored without themselves.

Defined cases: a text without any term of the examples (also null or empty) gets the rate of such
texts in the sample; without labelled rows of both kinds every score is the toxic rate of the sample,
or 0; an example labelled twice counts once, as toxic if any of its labels says so; repeated documents
are scored each; an empty table gives no rows. Other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.words import chunks

#: Labelled rows used at most; taken by a hash of the id.
MAX_EXAMPLES = 20_000
#: Of these, the ones held as vectors over all terms and used to calibrate; the first by the same hash.
MAX_VECTORS = 2_000
#: Examples in a block of the index.
BLOCK = 64
NEIGHBOURS = 15
#: Neighbours over all terms; those are many weak hints, so more of them vote.
WIDE_NEIGHBOURS = 50
#: A term in more than this part of the examples is common: its weights are a dense row.
COMMON = 1 / 8
#: Texts scored together.
TOGETHER = 128
#: Text bytes counted together.
COUNTED_BYTES = 1 << 18
CACHED_WORDS = 60_000

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Characters beside words that are neither letters nor marks.
MARKS = ".,;:!?()\"'"

#: Terms of a text, ascending, and how often it holds each.
Counts = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_terms(word: str) -> list[str]:
    """Terms of one white-space separated word: its letter runs, and stems of the longer ones."""
    out = []
    core = word.lower().strip(MARKS)
    for run in [core] if core.isalpha() else LETTERS.findall(core):  # most words are one run of letters
        out.append(run)
        out.extend(f"{run[:n]}*" for n in (4, 5) if len(run) > n)
    return out


def _example_terms(batches):
    for batch in batches:
        terms, counts = [], []
        for text in batch.column(2):
            tf: Counter[str] = Counter()
            for word, n in Counter((text.as_py() or "").split()).items():
                for t in word_terms(word):
                    tf[t] += n
            terms.append(list(tf))
            counts.append(list(tf.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            ["doc_id", "toxic", "terms", "counts"])


@dataclass
class Index:
    """Block-max inverted index of unit TF-IDF vectors over the telling terms."""

    terms: dict[str, int]
    idf: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    starts: np.ndarray  # posting slices: term x block
    posting_example: np.ndarray
    posting_weight: np.ndarray
    block_max: np.ndarray  # term x block
    rate: float
    visited: int = field(default=0, compare=False)

    def vector(self, tf: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        term = np.fromiter(sorted(tf), np.int64, len(tf))
        w = np.array([1 + math.log(tf[t]) for t in term.tolist()]) * self.idf[term]
        return term, w / np.sqrt((w * w).sum())

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine (position, cosine), ties to the smaller position; all positive ones if fewer."""
        bound = weight @ self.block_max[term]
        order = np.argsort(-bound, kind="stable")
        found: list[np.ndarray] = []
        where: list[np.ndarray] = []
        have, least = 0, 0.0
        for b in order.tolist():
            if bound[b] <= 0 or (have >= k and bound[b] < least - 1e-9):
                break
            self.visited += 1
            score = np.zeros(BLOCK)
            for t, w in zip(term.tolist(), weight.tolist()):
                lo, hi = self.starts[t, b], self.starts[t, b + 1]
                if hi > lo:
                    score[self.posting_example[lo:hi] - b * BLOCK] += w * self.posting_weight[lo:hi]
            if 0 <= without - b * BLOCK < BLOCK:
                score[without - b * BLOCK] = 0
            hit = np.flatnonzero(score)
            found.append(score[hit])
            where.append(hit + b * BLOCK)
            have += len(hit)
            if have >= k:
                best = np.concatenate(found)
                least = np.partition(best, len(best) - k)[len(best) - k]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        score, at = np.concatenate(found), np.concatenate(where)
        top = np.lexsort((at, -score))[:k]
        return at[top], score[top]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Nearness-weighted share of toxic neighbours, with the base rate as a weak extra vote."""
        return _vote(self.toxic[at], cosine, self.rate)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


class Vectors:
    """Inverted index of unit TF-IDF vectors over every term of the examples.

    Common terms come first and are dense rows; any other term is a list of examples and weights. All
    lists of a query are added up: bounds per block of examples left three of five blocks open and cost more than they saved.
    """

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, terms: list[str], example: np.ndarray, term: np.ndarray, count: np.ndarray):
        self.n = n = len(ids)
        df = np.bincount(term, minlength=len(terms))
        by_df = np.argsort(-df, kind="stable")
        self.terms = {terms[t]: i for i, t in enumerate(by_df.tolist())}
        number = np.empty(len(terms), np.int64)
        number[by_df] = np.arange(len(terms))
        term = number[term]
        self.common = int((df > COMMON * n).sum())
        self.idf = np.log((1 + n) / (1 + df[by_df])) + 1
        weight = (1 + np.log(count)) * self.idf[term]
        weight /= np.sqrt(np.bincount(example, weight * weight, minlength=n))[example]
        head = np.zeros((n, max(self.common, 1)))
        often = term < self.common
        head[example[often], term[often]] = weight[often]
        order = np.lexsort((head.max(1), head.argmax(1)))  # examples that lean on the same common term stand together
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        self.head = np.ascontiguousarray(head[order].T)
        example, term, weight = place[example[~often]], term[~often], weight[~often]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def vector(self, tf: dict[int, int] | Counts) -> tuple[np.ndarray, np.ndarray]:
        term, count = tf if isinstance(tf, tuple) else (np.array(v, np.int64) for v in (sorted(tf), [tf[t] for t in sorted(tf)]))
        w = (1 + np.log(count.astype(float))) * self.idf[term]
        return term, w / np.sqrt((w * w).sum())

    def nearest(self, queries: list, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ``k`` examples of largest cosine (position, cosine), ties to the smaller position; all positive ones if fewer."""
        vectors = [self.vector(q) for q in queries]
        dense = np.zeros((len(queries), len(self.head)))
        for n, (term, w) in enumerate(vectors):
            often = np.searchsorted(term, self.common)
            dense[n, term[:often]] = w[:often]
            vectors[n] = term[often:], w[often:]
        return [self._one(*v, score, k, without[n] if without else -1) for n, (v, score) in enumerate(zip(vectors, dense @ self.head))]

    def _one(self, term, w, score, k, without):
        lo, hi = self.starts[term], self.starts[term + 1]
        postings = _ranges(lo, hi)
        score = score + np.bincount(self.example[postings], np.repeat(w, hi - lo) * self.weight[postings], len(score))
        if without >= 0:
            score[without] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]


def _vote(toxic: np.ndarray, cosine: np.ndarray, rate: float) -> float:
    """Nearness-weighted share of toxic neighbours, with the base rate as a weak extra vote."""
    w = 1 / (1.05 - np.minimum(cosine, 1.0))
    return (float((w * toxic).sum()) + 0.5 * rate) / (float(w.sum()) + 0.5)


@dataclass
class Scorer:
    """Both indexes and the weights of their votes: all terms, telling terms, whether any of these is near, constant."""

    rate: float
    rest: float = 0.0
    wide: Vectors | None = None
    telling: Index | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def inputs(self, wide: list, telling: list[dict], k: int, own: list[int] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Calibration inputs of texts that hold a known term, and the ids of their nearest examples."""
        out, near = np.zeros((len(wide), 4)), []
        place = {d: n for n, d in enumerate(self.telling.ids.tolist())} if own else {}
        mine = {d: n for n, d in enumerate(self.wide.ids.tolist())} if own else {}
        all_near = self.wide.nearest(wide, WIDE_NEIGHBOURS, [mine[d] for d in own] if own else None)
        for n, (at, cosine) in enumerate(all_near):
            ids = self.wide.ids[at]
            out[n] = _logit(_vote(self.wide.toxic[at], cosine, self.rate)), 0, 0, 1
            if telling[n]:
                at, cosine = self.telling.nearest(*self.telling.vector(telling[n]), k, without=place.get(own[n], -1) if own else -1)
                if len(at):
                    ids = self.telling.ids[at]
                    out[n, 1:3] = _logit(self.telling.vote(at, cosine)), 1
            near.append(ids[:3])
        return out, near

    def calibrate(self, wide: Callable[[int], dict], telling: list[dict], own: list[int], toxic: np.ndarray, k: int) -> None:
        parts = [range(i, min(i + TOGETHER, len(own))) for i in range(0, len(own), TOGETHER)]
        x = np.concatenate([self.inputs([wide(n) for n in p], telling[p[0] : p[-1] + 1], k, own[p[0] : p[-1] + 1])[0] for p in parts])
        self.weights = _logistic(x, toxic)
        for vote in (0, 1):
            if self.weights[vote] < 0:  # a vote never speaks against its own neighbours (tiny samples)
                x[:, vote] = 0
                self.weights = _logistic(x, toxic)

    def score(self, wide: list[Counts], telling: list[dict], k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Calibrated scores and the ids of the nearest examples: by telling terms if the text has any, else by all."""
        score, near = np.full(len(wide), self.rest), [[] for _ in wide]
        on = [n for n, (term, _) in enumerate(wide) if len(term) or telling[n]]
        for i in range(0, len(on), TOGETHER):
            some = on[i : i + TOGETHER]
            x, ids = self.inputs([wide[n] for n in some], [telling[n] for n in some], k)
            score[some] = 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))
            for n, found in zip(some, ids):
                near[n] = found.tolist()
        return score, near


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a ridge logistic fit to smoothed labels (Newton steps)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - target) + 1e-2 * w)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def build_index(terms: list[str], examples: list[tuple[int, int, dict[int, int]]], rate: float) -> Index:
    """Index of the (id, toxic, term counts) examples that hold a term."""
    rows = sorted((e for e in examples if e[2]), key=lambda e: (sorted(e[2]), e[0]))  # alike examples share blocks
    df = np.zeros(len(terms))
    for _, _, tf in rows:
        df[list(tf)] += 1
    idf = np.log((1 + len(examples)) / (1 + df)) + 1
    blocks = -(-len(rows) // BLOCK)
    post: list[tuple[int, int, float]] = []
    for n, (_, _, tf) in enumerate(rows):
        total = math.sqrt(sum(((1 + math.log(c)) * idf[t]) ** 2 for t, c in tf.items()))
        post.extend((t, n, (1 + math.log(c)) * idf[t] / total) for t, c in tf.items())
    post.sort()
    term = np.array([p[0] for p in post], np.int64)
    example = np.array([p[1] for p in post], np.int64)
    weight = np.array([p[2] for p in post], np.float64)
    cell = term * blocks + example // BLOCK if blocks else term
    starts = np.searchsorted(cell, np.arange(len(terms))[:, None] * blocks + np.arange(blocks + 1)[None, :])
    block_max = np.zeros((len(terms), blocks))
    if len(post):
        np.maximum.at(block_max, (term, example // BLOCK), weight)
    return Index(
        {t: n for n, t in enumerate(terms)}, idf, np.array([e[1] for e in rows], np.float64), np.array([e[0] for e in rows], np.int64),
        starts, example, weight, block_max, rate)


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, max_vectors: int = MAX_VECTORS) -> Scorer:
    """Build and calibrate both indexes from at most ``max_examples`` labelled rows outside the held-out fifth."""
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("e_id")).agg(F.max(F.col("toxic").cast("int")).alias("e_toxic"))
        .orderBy(F.xxhash64("e_id"), "e_id").limit(max_examples)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(sample), F.col("doc_id") == F.col("e_id"))  # bounded by max_examples
        .select("doc_id", "e_toxic", "text").dropDuplicates(["doc_id"])
        .mapInArrow(_example_terms, "doc_id long, toxic int, terms array<string>, counts array<long>")
        .persist()
    )
    try:
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        rate = toxic / n if n else 0.0
        if not 0 < toxic < n:
            return Scorer(rate, rate)
        stats = (
            rows.select("toxic", F.explode("terms").alias("term")).groupBy("term")
            .agg(F.count("*").alias("seen"), F.sum("toxic").alias("bad")).filter("seen >= 4").persist()
        )
        share = F.col("bad") / F.col("seen")
        clean = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - rate))).otherwise(0.0)
        # Chernoff bound on so many toxic examples by chance, in nats
        surprise = F.col("seen") * (share * F.log(share / F.lit(rate)) + clean)
        kept = sorted(
            r["term"] for r in stats.filter((share > rate) & (2 * F.col("bad") >= F.col("seen")))
            .withColumn("surprise", surprise).filter(F.col("surprise") >= F.lit(math.log(max(stats.count(), 1))))
            .select("term").collect()  # terms of the sample's examples
        )
        stats.unpersist()
        place = {t: i for i, t in enumerate(kept)}
        some = rows.select(
            "doc_id", "toxic",
            F.filter(F.arrays_zip("terms", "counts"), lambda z: z["terms"].isin(kept) if kept else F.lit(False)).alias("tf"))
        examples = [(r["doc_id"], r["toxic"], {place[z["terms"]]: z["counts"] for z in r["tf"]}) for r in some.collect()]
        by_hash = rows.select(F.xxhash64("doc_id").alias("h"))
        edge = by_hash.orderBy("h").limit(max_vectors).agg(F.max("h")).first()[0]
        vectors = rows.filter(F.xxhash64("doc_id") <= F.lit(edge)).orderBy("doc_id").toArrow()  # bounded by max_vectors
    finally:
        rows.unpersist()
    return _fit(rate, build_index(kept, sorted(examples, key=lambda e: e[0]), rate), {e[0]: e[2] for e in examples}, vectors, k)


def _fit(rate: float, telling: Index, telling_tf: dict[int, dict], vectors: pa.Table, k: int) -> Scorer:
    vectors = vectors.combine_chunks()
    ids, toxic = (vectors.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic"))
    lengths = pc.list_value_length(vectors.column("terms")).to_numpy().astype(np.int64)
    coded = pa.concat_arrays(vectors.column("terms").chunks).flatten().dictionary_encode()
    term, count = coded.indices.to_numpy().astype(np.int64), pa.concat_arrays(vectors.column("counts").chunks).flatten().to_numpy()
    wide = Vectors(ids, toxic, coded.dictionary.to_pylist(), np.repeat(np.arange(len(ids)), lengths), term, count)
    names = np.fromiter((wide.terms[t] for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    ends = np.cumsum(lengths)

    def counts(n: int) -> dict[int, int]:
        at = slice(ends[n] - lengths[n], ends[n])
        return dict(zip(names[term[at]].tolist(), count[at].tolist()))

    empty = toxic[lengths == 0]
    scorer = Scorer(rate, (float(empty.sum()) + rate) / (len(empty) + 1), wide, telling)
    on = np.flatnonzero(lengths).tolist()
    if on:
        scorer.calibrate(lambda n: counts(on[n]), [telling_tf[int(ids[n])] for n in on], ids[on].tolist(), toxic[on].astype(float), k)
    return scorer


class WordTerms(dict):
    """Numbers of words, whose known terms (of all terms, of the telling ones) are looked up once per worker.

    Words without a known term share number 0; stems are looked up by their letters alone.
    """

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.known = (scorer.wide.terms if scorer.wide else {}, scorer.telling.terms if scorer.telling else {})
        stems = {t for known in self.known for t in known if t.endswith("*")}
        self.stems = {t[:-1]: tuple(known.get(t) for known in self.known) for t in stems}
        self.clear()

    def clear(self):
        super().clear()
        self.found = array("q"), array("q")
        self.ends = array("q", [0, 0]), array("q", [0, 0])

    def __missing__(self, word: str):
        core = word.lower().strip(MARKS)
        hits = []
        wide, telling = self.known
        for run in (core,) if core.isalpha() else LETTERS.findall(core):
            if run in wide or run in telling:
                hits.append((wide.get(run), telling.get(run)))
            if len(run) > 4:
                if (stem := run[:4]) in self.stems:
                    hits.append(self.stems[stem])
                if len(run) > 5 and (stem := run[:5]) in self.stems:
                    hits.append(self.stems[stem])
        number = 0
        if hits:
            number = len(self.ends[0]) - 1
            for found, ends, own in zip(self.found, self.ends, zip(*hits)):
                for n in own:
                    if n is not None:
                        found.append(n)
                ends.append(len(found))
        self[word] = number
        return number

    def counts(self, texts: list[str | None]) -> tuple[list[Counts], list[Counts]]:
        """Counts of the terms of whole texts, in both indexes; terms ascend."""
        if len(self) >= CACHED_WORDS:
            self.clear()
        words = [(text or "").split() for text in texts]
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out = []
        for known, found, ends in zip(self.known, self.found, self.ends):
            size, found, ends = max(len(known), 1), np.array(found), np.array(ends)
            lo, hi = ends[number], ends[number + 1]
            cell, n = np.unique(np.repeat(owner, hi - lo) * size + found[_ranges(lo, hi)], return_counts=True)
            first = np.searchsorted(cell, np.arange(len(words) + 1) * size)
            out.append([(cell[i:j] % size, n[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())])
        return out[0], out[1]


def _scores(scorer: Scorer, words: WordTerms, column, k: int) -> tuple[np.ndarray, list[list[int]]]:
    scores, near = [np.zeros(0)], []
    for _, part in chunks(column, COUNTED_BYTES):
        wide, telling = words.counts(part.to_pylist())
        score, found = scorer.score(wide, [dict(zip(t.tolist(), n.tolist())) for t, n in telling], k)
        scores.append(score)
        near += found
    return np.concatenate(scores), near


def _score(shared, k: int):
    def run(batches):
        words = WordTerms(shared.value)
        for batch in batches:
            score, evidence = _scores(shared.value, words, batch.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    return run


SCORED = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>"


def score_toxicity(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and the nearest examples' ids for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_examples, k))  # bounded by max_examples
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_score(shared, k), SCORED)


def _keep(shared, k: int, at: int):
    def run(batches):
        words = WordTerms(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, words, batch.column(at), k)[0] < 0.5, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; read once, nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_examples, k))  # bounded by max_examples
    return docs.mapInArrow(_keep(shared, k, docs.columns.index("text")), docs.schema)
