"""Row-level projections and schema rewrites; none of them shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakeflow.functions.semantics import ratio

# Path prefixes that the access log leaves out, and the slow-request threshold.
EXCLUDED_PATHS = ("/health", "/metrics")
SLOW_MS = 1000


def user_profile_metrics(users: DataFrame) -> DataFrame:
    """Accuracy, profit per bet, win rate and display name of stored user counters.

    The ROI of a profile is profit divided by the number of bets, unlike the ledger ROI.
    """
    first, last = F.nullif(F.col("first_name"), F.lit("")), F.nullif(F.col("last_name"), F.lit(""))
    name = F.concat(first, F.lit(" "), last)
    return users.select(
        "user_id",
        ratio(F.col("correct_predictions"), F.col("total_predictions"), 100).alias("accuracy"),
        ratio(F.col("total_profit"), F.col("total_bets"), 100).alias("roi"),
        F.coalesce(name, F.col("username")).alias("full_name"),
    )


def invoice_normalize(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        "invoice_id",
        (F.col("amount_cents") / 100).alias("amount"),
        F.upper("currency").alias("currency"),
        F.timestamp_seconds("created_epoch").alias("created_at"),
        F.when(F.col("paid_epoch") != 0, F.timestamp_seconds("paid_epoch")).alias("paid_at"),
    )


def access_log_enrich(logs: DataFrame) -> DataFrame:
    """Client address, log level and slow flag; excluded path prefixes are dropped."""
    keep = F.lit(True)
    for prefix in EXCLUDED_PATHS:
        keep = keep & ~F.col("path").startswith(prefix)
    forwarded = F.nullif(F.col("forwarded_for"), F.lit(""))
    return logs.filter(keep).select(
        "*",
        F.coalesce(F.trim(F.split(forwarded, ",")[0]), F.nullif(F.col("real_ip"), F.lit("")), F.col("host"))
        .alias("client_ip"),
        F.when(F.col("status_code") >= 500, "error").when(F.col("status_code") >= 400, "warning")
        .otherwise("info").alias("level"),
        (F.col("duration_ms") > SLOW_MS).alias("slow"),
    )


def remap(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep and rename the mapped columns; absent ones are ignored."""
    return df.select(*[F.col(f"`{s}`").alias(d) for s, d in mapping.items() if s in df.columns])


def pick(df: DataFrame, fields: list[str]) -> DataFrame:
    return remap(df, {f: f for f in fields})


def _snake(name: str) -> str:
    """A separator before each capitalised word; underscores of the name stay, so ``_id`` and ``id`` differ."""
    spaced = re.sub(r"(?<=.)(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[\s\-]+", "_", spaced).lower()


def _parts(name: str) -> list[str]:
    """Words by separator only: camel and pascal case do not split at capitals. A leading separator gives an empty first word."""
    return re.split(r"[_\s\-]+", name.lower())


NAMING: dict[str, Callable[[str], str]] = {
    "snake": lambda s: _snake(s),
    "kebab": lambda s: _snake(s).replace("_", "-"),
    "camel": lambda s: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(_parts(s))),
    "pascal": lambda s: "".join(w.capitalize() for w in _parts(s)),
}


def _renamed_type(dt: T.DataType, name: Callable[[str], str]) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([
            T.StructField(name(f.name), _renamed_type(f.dataType, name), f.nullable) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_renamed_type(dt.elementType, name), dt.containsNull)
    if isinstance(dt, T.MapType):
        return T.MapType(dt.keyType, _renamed_type(dt.valueType, name), dt.valueContainsNull)
    return dt


def rename_columns(df: DataFrame, case: str) -> DataFrame:
    """Rename all fields, nested ones too, to snake, camel, pascal or kebab case."""
    name = NAMING[case]
    return df.select(*[
        F.col(f"`{f.name}`").cast(_renamed_type(f.dataType, name)).alias(name(f.name))
        for f in df.schema.fields])


def flatten_df(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to flat columns named by their path."""
    def walk(fields, path):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            else:
                yield here

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in walk(df.schema.fields, [])])


def unflatten_df(df: DataFrame, sep: str = ".") -> DataFrame:
    """Columns named by a path back to nested structs."""
    tree: dict = {}
    for c in df.columns:
        node = tree
        *parents, leaf = c.split(sep)
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = F.col(f"`{c}`")

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return df.select(*build(tree))
