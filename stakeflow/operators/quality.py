"""Data-quality scans: one pass over the table wherever the check allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakeflow.functions import text as X
from stakeflow.functions.rules import resolve
from stakeflow.functions.semantics import r6, ratio
from stakeflow.operators.scan import attach, exact_quantiles, group_stats, trailing_rows


def _counts_to_rows(one: DataFrame, names: list[str], label: str, fields: list[str]) -> DataFrame:
    """One aggregate row with ``<i>_<field>`` columns to one row per name."""
    items = [F.struct(F.lit(n).alias(label), *[F.col(f"{i}_{f}").alias(f) for f in fields]) for i, n in enumerate(names)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def dq_rules(df: DataFrame, rules: dict[str, str | tuple | list]) -> DataFrame:
    """Pass and fail counts per (column, rule) from one aggregation; nulls fail."""
    checks = [(c, s) for c, specs in rules.items() for s in (specs if isinstance(specs, list) else [specs])]
    aggs = []
    for i, (c, spec) in enumerate(checks):
        ok = F.coalesce(resolve(spec)(F.col(c)), F.lit(False))
        aggs += [F.count_if(ok).alias(f"{i}_passed"), F.count_if(~ok).alias(f"{i}_failed")]
    names = [f"{c}:{s if isinstance(s, str) else s[0]}" for c, s in checks]
    return _counts_to_rows(df.agg(*aggs), names, "rule", ["passed", "failed"])


def pii_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of e-mail addresses, phone numbers and valid card numbers by brand per text."""
    # cheap tests first: most texts hold no @ and no longer number
    t = F.col(text)
    no_mail, no_card, no_phone = ~t.contains("@"), ~t.rlike("[0-9]{4}"), ~t.rlike("[0-9]{2}")
    d = docs.withColumn("_cards", F.when(no_card, F.array().cast("array<string>")).otherwise(X.cards(t)))

    def brand(pattern: str) -> Column:
        return F.size(F.filter("_cards", lambda x: x.rlike(pattern)))

    return d.select(
        *[c for c in docs.columns if c != text],
        F.when(no_mail, 0).otherwise(F.size(F.regexp_extract_all(t, F.lit(X.EMAIL_CANDIDATE), F.lit(0)))).alias("emails"),
        F.when(no_phone, 0).otherwise(F.size(X.phones(t))).alias("phones"), F.size("_cards").alias("cards"),
        *[brand(p).alias(n) for n, p in X.CARD_BRANDS])


def attack_scan(docs: DataFrame, text: str) -> DataFrame:
    """One flag per injection and scripting pattern."""
    flags = {**X.SQL_PATTERNS, **X.XSS_PATTERNS}
    assigns = F.col(text).contains("=")

    def flag(name: str, pattern: str) -> Column:
        # these patterns end in "=": texts without one skip the scan
        hit = F.col(text).rlike(pattern)
        return (assigns & hit) if name in ("sql_or", "sql_and", "xss_handler") else hit

    return docs.select(
        *[c for c in docs.columns if c != text], *[flag(n, p).alias(n) for n, p in flags.items()]
    ).withColumn("sql_injection", _any(X.SQL_PATTERNS)).withColumn("xss", _any(X.XSS_PATTERNS))


def _any(names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n)
    return out


def schema_issues(schema: T.StructType, spec: dict, path: str = "root") -> list[str]:
    """Missing keys and wrong types of a table schema against a nested {name: type} spec."""
    out, fields = [], {f.name: f.dataType for f in schema.fields}
    for name, want in spec.items():
        here = f"{path}.{name}"
        if name not in fields:
            out.append(f"missing {here}")
        elif isinstance(want, dict):
            if isinstance(fields[name], T.StructType):
                out += schema_issues(fields[name], want, here)
            else:
                out.append(f"expected struct at {here}, got {fields[name].simpleString()}")
        elif fields[name].simpleString() != want:
            out.append(f"expected {want} at {here}, got {fields[name].simpleString()}")
    return out


def schema_conformance(df: DataFrame, json_col: str, spec: dict[str, str]) -> DataFrame:
    """Rows per dotted path whose JSON document lacks the key or holds another type.

    Types are BIGINT, DOUBLE, STRING, BOOLEAN, ARRAY or OBJECT.
    """
    v = F.try_parse_json(F.col(json_col))
    aggs, names = [], list(spec)
    for i, path in enumerate(names):
        at = F.try_variant_get(v, f"$.{path}", "variant")
        kind = F.regexp_extract(F.schema_of_variant(at), r"^(\w+)", 1)
        kind = F.when(kind.startswith("DECIMAL"), "DOUBLE").otherwise(kind)
        aggs += [F.count_if(at.isNull()).alias(f"{i}_missing"),
                 F.count_if(at.isNotNull() & (kind != spec[path])).alias(f"{i}_wrong_type"), F.count("*").alias(f"{i}_rows")]
    return _counts_to_rows(df.agg(*aggs), names, "path", ["missing", "wrong_type", "rows"])


# Accepted ranges of betting fields.
BET_DOMAIN = {"stake": (1.0, 10000.0), "odds": (1.01, 1000.0), "confidence": (0.0, 100.0)}
SPORT_DOMAIN = {"founded": (1800, 2030), "age": (15, 50), "humidity": (0, 100)}


def bet_domain_rules() -> dict[str, Column]:
    """Violation conditions of a bet or cash-out request."""
    rules = {f"{c}_range": ~F.col(c).between(lo, hi) for c, (lo, hi) in BET_DOMAIN.items()}
    rules["legs_count"] = (F.col("bet_type") != "single") & ~F.coalesce(F.col("legs"), F.lit(0)).between(2, 20)
    amount = F.coalesce(F.col("partial_amount"), F.lit(0.0)) != 0
    rules["partial_cashout"] = F.col("partial") != amount
    return rules


def sport_domain_rules() -> dict[str, Column]:
    return {f"{c}_range": ~F.col(c).between(lo, hi) for c, (lo, hi) in SPORT_DOMAIN.items()}


def domain_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule in one pass; a null value does not violate."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{i}_violations") for i, c in enumerate(rules.values())])
    return _counts_to_rows(one, list(rules), "rule", ["violations"])


def domain_rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule with the names of all broken rules."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return df.withColumn("broken", F.array_join(broken, ",")).filter("broken <> ''")


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{i}_nulls") for i, c in enumerate(columns)])
    return _counts_to_rows(one, columns, "column", ["nulls"])


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def accepted_values(df: DataFrame, column: str, values: tuple) -> DataFrame:
    """Values outside the accepted list with their row counts."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("rows"))


def outliers(df: DataFrame, group: list[str], value: str, method: str, k: float | None = None) -> DataFrame:
    """Rows outside mean +- k deviations (``z``) or the quartile fences (``iqr``) of their group."""
    if method == "z":
        k = 3.0 if k is None else k
        j = group_stats(df, group, {"_m": F.avg(value), "_sd": F.stddev_samp(value)}).withColumns(
            {"low": F.col("_m") - F.col("_sd") * k, "high": F.col("_m") + F.col("_sd") * k}).drop("_m", "_sd")
    elif method == "iqr":
        k = 1.5 if k is None else k
        q = exact_quantiles(df, group, value, {"q1": 0.25, "q3": 0.75})
        span = (F.col("q3") - F.col("q1")) * k
        j = attach(df, q.select(*group, (F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high")), group, F.struct(*df.columns))
    else:
        raise ValueError("method must be 'z' or 'iqr'")
    return j.withColumn("low", r6(F.col("low"))).withColumn("high", r6(F.col("high"))).filter(
        (F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def metric_anomalies(df: DataFrame, keys: list[str], order: list[str], block: Column, value: str, n: int, z: float) -> DataFrame:
    """Values more than ``z`` deviations off the mean of the ``n`` values before them."""
    t = trailing_rows(df, keys, order, block, n, {"_m": F.avg(value), "_sd": F.stddev_samp(value), "_n": F.count("*")})
    score = r6(F.try_divide(F.col(value) - F.col("_m"), F.nullif(F.col("_sd"), F.lit(0.0))))
    return t.withColumn("z", score).filter((F.col("_n") == n) & (F.abs("z") > z)).drop("_m", "_sd", "_n")


def quality_report(df: DataFrame, columns: list[str], freshness: str | None = None, exact: bool = False) -> DataFrame:
    """Completeness and distinctness per column in one pass, and the newest timestamp.

    Distinct counts are approximate unless ``exact``; exact ones cost one shuffled row per
    distinct value and column.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"{i}_filled"), distinct(c).alias(f"{i}_distinct"), F.count("*").alias(f"{i}_rows")]
    if freshness:
        aggs.append(F.max(freshness).alias("newest"))
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{f}").alias(f) for f in ("filled", "distinct", "rows")]) for i, c in enumerate(columns)]
    keep = ["newest"] if freshness else []
    x = one.select(F.explode(F.array(*items)).alias("x"), *keep).select("x.*", *keep)
    return x.select("column", r6(ratio(F.col("filled"), F.col("rows"))).alias("completeness"), F.col("distinct").alias("distinct_values"),
                    r6(ratio(F.col("distinct"), F.col("filled"))).alias("distinctness"), *keep)


def normalize(df: DataFrame, group: list[str], value: str, method: str) -> DataFrame:
    """Scale a column within its group to [0, 1] or to z-scores; constant groups give 0."""
    j = group_stats(df, group, {"_lo": F.min(value), "_hi": F.max(value), "_m": F.avg(value), "_sd": F.stddev_samp(value)})
    v = F.col(value)
    if method == "minmax":
        scaled = F.coalesce(F.try_divide(v - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0))
    elif method == "zscore":
        scaled = F.coalesce(F.try_divide(v - F.col("_m"), F.nullif(F.col("_sd"), F.lit(0.0))), F.lit(0.0))
    else:
        raise ValueError("method must be 'minmax' or 'zscore'")
    return j.withColumn("scaled", r6(scaled)).drop("_lo", "_hi", "_m", "_sd")


def sentiment_trend(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Mean lexicon score of texts per source and day.

    The lexicon is a short parameter, sent with the plan as a map; words are looked up inside
    each row and only scored texts reach the shuffle.
    """
    table = F.create_map(*[F.lit(x) for w, s in lexicon.items() for x in (w, float(s))])
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w: F.element_at(table, w)), lambda s: s.isNotNull())
    scored = docs.select("source", "day", F.size(words).alias("words"), hits.alias("hits"))
    score = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)
    scored = scored.select("source", "day", "words", F.size("hits").alias("n_hits"), F.coalesce(F.try_divide(score, F.size("hits").cast("double")), F.lit(0.0)).alias("score"))
    return scored.groupBy("source", "day").agg(
        F.count("*").alias("documents"), F.sum("n_hits").alias("hits"), r6(F.avg("score")).alias("mean_score"))
