"""Token counts under a unigram model, by dynamic programming shared along trie prefixes.

A pre-token is a white-space separated word with the word mark in front. Its tokens are the pieces
of its best-scoring segmentation. The best score of a prefix does not depend on what follows, so
all words with that prefix share it: the distinct new words of a batch are visited in sorted order,
which is the depth-first walk of their trie, and each trie node is scored once. What is stored per
word is the token count at its terminal node; documents then add up the counts of their words.

Piece scores are those of a vocabulary file whose pieces are ordered by frequency, turned into
log-probabilities by Zipf's rule. A character outside the vocabulary costs one token per byte.
Among equal scores the segmentation with fewer tokens counts.

Defined cases: a null or blank text has 0 words and 0 tokens; repeated rows are counted each; texts of
any length are read whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a Python worker keeps; the store is emptied when full (bounds memory only).
CACHED_WORDS = 500_000
#: Text bytes whose words are inserted together.
BATCH_BYTES = 4 << 20

MARK = "▁"


class UnigramTrie:
    """Best segmentations of words under ``scores`` (piece -> log-probability)."""

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)

    def counts(self, words: list[str]) -> list[int]:
        """Token counts of ``words``, which must be sorted; only the current trie branch is held."""
        find, unknown, longest = self.scores.get, self.unknown, self.longest
        best, tokens, out = [0.0], [0], []
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, used = best[end - 1] + unknown * n, tokens[end - 1] + n
                for start in range(max(0, end - longest), end):
                    s = find(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or (s == top and tokens[start] + 1 < used):
                            top, used = s, tokens[start] + 1
                best.append(top)
                tokens.append(used)
            out.append(tokens[len(word)])
            last = word
        return out


def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """Log-probabilities by rank of the pieces of a SentencePiece file, and the score of an unknown byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = sorted(
        (i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))),
        key=lambda i: (-model.get_score(i), i),
    )
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    scores = {model.id_to_piece(i): -math.log(r + 2.7) - norm for r, i in enumerate(pieces)}
    return scores, min(scores.values()) - 10.0


class WordCounts(dict):
    def __init__(self, path: str, limit: int = CACHED_WORDS):
        super().__init__()
        self.trie, self.limit = UnigramTrie(*piece_scores(path)), limit

    def insert(self, words: set[bytes]) -> None:
        """Add the counts of distinct words that are not stored yet."""
        new = words - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            new = words
        marked = sorted((MARK + w.decode("utf-8", "replace"), w) for w in new)
        self.update(zip((w for _, w in marked), self.trie.counts([m for m, _ in marked])))


_LOADED: dict[str, WordCounts] = {}


def word_counts(path: str) -> WordCounts:
    if path not in _LOADED:
        _LOADED[path] = WordCounts(path)
    return _LOADED[path]


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        counts = word_counts(path)
        for batch in batches:
            n_words, n_tokens, group, held = [], [], [], 0

            def close():
                counts.insert(set().union(*group))
                n_words.extend(map(len, group))
                n_tokens.extend(sum(map(counts.__getitem__, words)) for words in group)
                group.clear()

            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                group.append(data.split())
                held += len(data)
                if held >= BATCH_BYTES:
                    close()
                    held = 0
            close()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Words and tokens of every document: doc_id, n_words, n_tokens. Nothing is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_count(vocabulary or vocabulary_path()), "doc_id long, n_words long, n_tokens long")
