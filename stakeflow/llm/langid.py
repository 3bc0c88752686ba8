"""Language identification with error-correcting output codes over byte n-grams.

Every language gets a codeword; a binary logistic classifier over hashed n-gram frequencies learns
each bit. A text's language is the codeword with the least weighted logistic loss against the
bits' margins, where a bit weighs as much as its training accuracy exceeds chance. A text whose two
best codewords are close is flagged as ambiguous.

The classifiers are fitted on a bounded sample (``per_language`` documents of each language, chosen
by a hash of the id); everything else reads all rows and whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 (also when no language
could be learned); with one language that one is predicted; repeated rows are predicted each; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
ORDERS = (1, 2, 3, 4)
#: Text bytes whose n-grams are counted together.
BATCH_BYTES = 1 << 20
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _letters_only() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = 32
    return table


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Unit vectors of square roots of hashed n-gram counts, one row per text.

    Texts are lower-cased, ASCII characters other than letters become one kind of gap, and each
    text is set between gaps, so n-grams of neighbouring texts do not mix.
    """
    table, out = _letters_only(), np.zeros((len(texts), BUCKETS), np.float32)
    for i, text in enumerate(texts):
        data = table[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
        data = data[(data != 32) | (np.append(np.uint8(0), data[:-1]) != 32)].astype(np.uint32)
        total = np.zeros(BUCKETS, np.int64)
        code = np.zeros(len(data), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            if len(data) < order:
                break
            code = (code[: len(data) - order + 1] * np.uint32(257) + data[order - 1 :]).astype(np.uint32)
            if order in ORDERS:
                mixed = (code + np.uint32(order)) * np.uint32(2654435761)
                total += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
        out[i] = np.sqrt(total)
        norm = np.linalg.norm(out[i])
        if norm:
            out[i] /= norm
    return out


def codewords(n: int, bits: int = 31, seed: int = 7) -> np.ndarray:
    """+1/-1 codes of ``n`` languages: all distinct splits for few, else the best of random codes."""
    if n <= 5:
        splits = 2 ** max(n - 1, 0) - 1
        return np.array([[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in range(1, splits + 1)] for i in range(n)], np.float32).reshape(n, splits)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits)).astype(np.float32)
        apart = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its share of the likelihood, margin to the second) per row."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(self.bit_weight * np.logaddexp(0, -margin * c)).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / share.sum(1)
        second = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return best, score, second


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 20.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits together, by gradient descent with momentum, classes balanced."""
    n, bits = y.shape
    share = np.where(y > 0, (y > 0).mean(0), (y < 0).mean(0))
    cost = (0.5 / np.maximum(share, 1e-9) / n).astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -y * cost / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - rate * 0.1 * (x.T @ g + decay * w)
        vb = 0.9 * vb - 0.1 * g.sum(0)
        w, b = w + vw, b + vb
    return w, b


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names))
    index = np.array([names.index(v) for v in langs], int)
    y = code[index].reshape(len(langs), code.shape[1])
    if not y.shape[1]:
        none = np.zeros(0, np.float32)
        return Model(names, code, np.zeros((BUCKETS, 0), np.float32), none, none)
    w, b = fit_bits(x, y)
    right = ((x @ w + b) * y > 0).mean(0)
    return Model(names, code, w, b, np.maximum(2 * right - 1, 0.01).astype(np.float32))


def _features(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = [ngram_counts([t])[0].astype(np.float16).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])


def train(docs: DataFrame, per_language: int = 400) -> Model | None:
    """Fit on about ``per_language`` documents of each language that are not held out; None without any.

    Rows are taken where a hash of the id falls below the language's sampling rate, so the sample
    stays bounded at any size; their feature vectors (8 kB each) meet in the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    rates = {r["lang"]: min(1.0, per_language / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rates:
        return None
    rate = F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("lang")]
    place = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.filter(place < rate).select("lang", "text").mapInArrow(_features, "lang string, x binary").collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    if not rows:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for _, v in rows]).astype(np.float32)
    return fit(x, [lang for lang, _ in rows])


def _predict(shared, ambiguous_below: float):
    def run(batches):
        model = shared.value
        for batch in batches:
            langs, scores, doubt = [], [], []
            group, held = [], 0

            def close():
                real = [i for i, t in enumerate(group) if model and t is not None and LETTER.search(t)]
                pred, score, unsure = ["und"] * len(group), [0.0] * len(group), [True] * len(group)
                if real:
                    best, share, second = model.decode(ngram_counts([group[i] for i in real]))
                    for i, b, s, d in zip(real, best.tolist(), share.tolist(), second.tolist()):
                        pred[i], score[i], unsure[i] = model.languages[b], s, d < ambiguous_below
                langs.extend(pred)
                scores.extend(score)
                doubt.extend(unsure)
                group.clear()

            for text in batch.column(1):
                group.append(text.as_py())
                held += len(group[-1] or "")
                if held >= BATCH_BYTES or len(group) >= 500:
                    close()
                    held = 0
            close()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify_language(docs: DataFrame, per_language: int = 400, ambiguous_below: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and an ambiguity flag for every document."""
    model = train(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS x bits floats
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(
        _predict(shared, ambiguous_below), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
