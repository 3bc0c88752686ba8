"""Importance resampling of documents towards a target collection, on hashed n-gram counts.

Every n-gram of words falls into one of ``buckets`` by crc32. The log ratio of the target's and the
corpus's smoothed bucket frequencies is a bucket's gain; a document's weight is the sum of the gains
of its n-grams, and adding Gumbel noise drawn from its id turns the highest scores into a sample
without replacement in proportion to the weights.

Per piece of about 1 MB of text the n-grams are interned in an open-addressed table (see ``terms``),
which holds a bucket and a count for each slot: crc32 runs once per distinct n-gram, the corpus counts
are sums over slots, and the slot ids of a document's n-grams gather their gains. Counting is one
pass over the texts (at most ``buckets`` rows leave a task), scoring a second; ranks come from one
range sort of (score, id) rows.

Defined cases: a null or empty text has no features and weight 0; fewer than ``min_words`` words are
scored but never drawn; repeated rows are documents of their own; a null ``doc_id`` is hashed as an
empty id and comes last among equal scores; empty tables give no rows (an empty target: every count
0). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.llm import terms as T
from stakeflow.llm.storage import written

ROW_BITS = 33  # of monotonically_increasing_id: partition above, row within it below


def _slots(part: T.Terms, n_max: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: slot ids of the occurrences, bucket and count slots, first occurrence of each text."""
    for n in range(1, n_max + 1):
        starts, lengths, first = T.runs(part, n)
        ids, owner = T.intern(part.data, starts, lengths, T.span_keys(part.data, starts, lengths))
        whole = part.data.tobytes()
        at = starts[owner].tolist()
        bucket = np.fromiter(
            (zlib.crc32(whole[a : a + k]) % buckets for a, k in zip(at, lengths[owner].tolist())), np.int64, len(at))
        yield ids, bucket, np.bincount(ids, minlength=len(at)), first


def bucket_counts(docs: DataFrame, n_max: int, buckets: int) -> DataFrame:
    """(bucket, n): n-grams of all texts per bucket; buckets without one are not listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in T.term_chunks(batch.column(0)):
                for _, bucket, n, _ in _slots(part, n_max, buckets):
                    np.add.at(total, bucket, n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket: floor(1000 * ln(smoothed target share / smoothed corpus share)).

    Two lists of at most ``buckets`` counts come to the driver.
    """
    have = []
    for docs in (corpus, target):
        n = [0] * buckets
        for row in bucket_counts(docs, n_max, buckets).collect():
            n[row["bucket"]] = row["n"]
        have.append(n)
    s, t = have
    s_all, t_all = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)], np.int64)


def _noise(doc_id: object, seed: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the seeded id's sha256."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, n_max: int = 1, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) of every document."""
    buckets = len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, rows, part in T.term_chunks(batch.column(1)):
                words[lo : lo + rows] = part.counts()
                for ids, bucket, _, first in _slots(part, n_max, buckets):
                    upto = np.concatenate([[0], np.cumsum(gains[bucket][ids])])
                    weight[lo : lo + rows] += upto[first[1:]] - upto[first[:-1]]
                    features[lo : lo + rows] += np.diff(first)
            noise = np.fromiter((_noise(i, seed) for i in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (features, words, weight, weight + noise))],
                ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features long, n_words long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, n_max: int = 1,
             buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """Scores of all documents; ``rank`` counts the drawn ones from 1, the others have none.

    Of the documents with ``min_words`` words, ``percent`` of a hundred are drawn. All rows are range-sorted
    once, those that can be drawn first; the sorted rows are written with their place, and a place
    becomes a rank by adding the rows of the partitions before (one row per partition).
    """
    gains = bucket_gains(docs, target, n_max, buckets)
    scored = written(score_documents(docs, gains, n_max, seed), "scores")
    short = F.col("n_words") < min_words
    placed = written(
        scored.orderBy(short, F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("at", F.monotonically_increasing_id()),
        "placed")
    placed = placed.withColumn("part", F.shiftright("at", ROW_BITS))
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~short).alias("able"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    draws = F.floor(F.coalesce(parts.agg(F.sum("able")).scalar(), F.lit(0)) * percent / 100)
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    # the broadcast side has a row for each partition of the sort
    return placed.join(F.broadcast(starts), F.col("part") == F.col("p")).select(
        "doc_id", "n_features", "weight", "score", F.when(place <= draws, place).cast("long").alias("rank"))


RESAMPLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM b GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (
  SELECT w, [CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(0, length(x) // 2)] AS bs FROM h),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, v:
    list_reduce([xor(c, v), 1, 2, 3, 4, 5, 6, 7, 8], lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))),
    4294967295::BIGINT) % 10000 AS bucket
  FROM bytes),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw)::DOUBLE + 10000 AS s_all, (SELECT coalesce(sum(n), 0) FROM bw)::DOUBLE + 10000 AS t_all),
gain AS (
  SELECT crc.w, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((coalesce(s, 0) + 1)::DOUBLE * t_all))) AS BIGINT) AS g
  FROM crc LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
weights AS (
  SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(ws) AS w FROM d) JOIN gain USING (w) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN r <= n * 10 // 100 THEN r END AS BIGINT) AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""
