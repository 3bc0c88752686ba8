"""Unions, ordered de-duplication and record merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_value_bets(*parts: DataFrame) -> DataFrame:
    """Append lists of value bets (bag union)."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedup_keep(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in ``order``.

    An aggregation, not a window: copies are dropped before the shuffle, so a key with any
    number of copies sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def pivot_kv(df: DataFrame, keys: list[str], name: str, value: str, order: list[str], wanted: list[str]) -> DataFrame:
    """Key-value rows to columns: the newest value by ``order`` of each wanted name, and how many names a key has.

    Names outside ``wanted`` only count, so a key may have any number of them.
    """
    last = dedup_keep(df.select(*keys, name, value, *order), [*keys, name], order, last=True)
    return last.groupBy(*keys).agg(F.count("*").alias("keys"), *[F.max(F.when(F.col(name) == w, F.col(value))).alias(w) for w in wanted])


def merge_records(key: str, *sources: DataFrame, priority: str = "last") -> DataFrame:
    """Field-wise merge of sources with unique keys: non-null fields of the preferred source win."""
    if priority not in ("first", "last"):
        raise ValueError("priority must be 'first' or 'last'")
    ranked = list(sources if priority == "first" else reversed(sources))
    fields: list[str] = []
    for s in ranked:
        fields += [c for c in s.columns if c != key and c not in fields]
    tagged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(ranked)])
    # one shuffle for any number of sources: per field the non-null value of best priority
    return tagged.groupBy(key).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_prio"))).alias(c) for c in fields])
