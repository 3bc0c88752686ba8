"""Best-fit packing of tokenized documents into fixed-length sequences by sum of squares.

Each document is tokenized once and cut into pieces of at most ``capacity`` tokens. Pieces are spread
over shards; a shard places its pieces, longest first, into the open bin whose choice makes the sum
of squared counts of open bins per residual gap smallest. A bin is opened only when no open one
has room, so a shard ends within about one bin of the least possible number.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; texts of
any length are cut, never truncated; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.storage import written

#: Words kept with their ids in each Python worker; the store is emptied when full (bounds memory only).
CACHED_WORDS = 500_000
#: Pieces packed together in one task.
SHARD_PIECES = 20_000

# fixed values: the tokenizer file's own splitting rule, for words of ASCII and Latin-1 letters
SIMPLE_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SIMPLE_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of words that white space separates, encoded on first use.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.
    Words of plain letters go to the tokenizer's model in the parts its splitting rule gives; any
    other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode()
        if SIMPLE_WORD.fullmatch(text) and "<|" not in text:
            parts = SIMPLE_PARTS.findall(text.lower())
            if not text.isascii():
                parts = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in parts]
            ids = [t.id for p in parts for t in self.model.tokenize(p)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = out = array.array("I", ids).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's store for one tokenizer file; reused by all tasks of a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = array.array("I", [end_id]).tobytes()

    def run(batches):
        words = word_ids(path)
        step = 4 * capacity
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = words.encode(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    ids.append(doc)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: its ids, then the end token, in runs of at most ``capacity``."""
    cut = _cut(tokenizer or tokenizer_path(), capacity, end_id)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def place_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by sum of squares over the residual gaps, longest pieces first.

    Moving a bin from gap g to g - s changes the sum of squares by 2 n[g - s] - 2 n[g] + 2, and
    closing one (g = s) by 1 - 2 n[s]; ties take the tighter gap.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        here = count[s:capacity]
        change = 2 * count[: capacity - s] - 2 * here + 2
        if len(change):
            change[0] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
        if len(change) and here[k]:
            gap = s + k
            b = members[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            members[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    The shard of a piece is a hash of its document, number and place in the table, so neither a
    source nor a document id that fills a third of the rows fills one.
    The number of shards follows the number of pieces; sequence ids are unique over all shards.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = pieces.columns

    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([(n, "ascending") for n in names])  # reruns agree
        bins, offsets = place_pieces(order.column("length").to_numpy(), capacity)
        shard = order.column("shard")[0].as_py()
        return order.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins * shards + shard)).append_column(
            "offset", pa.array(offsets))

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    shard = F.pmod(F.xxhash64("doc_id", "piece", spread), F.lit(shards)).cast("long")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    return pack_pieces(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
