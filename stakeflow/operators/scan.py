"""Ordered and grouped computations that stay parallel when one key holds most of the rows.

A plain window over ``partitionBy(user)`` sorts a whole user in one task. A frequent-items sketch
tells which keys are heavy, that is hold more rows than a task's even share. Light keys, usually all,
take the plain window: one read and one shuffle. Heavy keys are cut into blocks along the order (a
range of rows, an hour, a narrow value range). Every block is reduced to one small row, and these
summaries are windowed per key to give each block what came before it. That carried row is put in
front of its block, so an ordinary window inside (key, block) continues the running value. The
rows are shuffled once, on (key, block), and never joined.

The functions that look for heavy keys run the sketch over the key columns when they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeflow.session import written

BLOCK = "_block"
PLACE = "_place"


def time_block(ts: str | Column, unit: str = "hour") -> Column:
    """Block of a timestamp: its unit start (second, minute, hour, day, month).

    One key's rows within the unit go to one task, so dense feeds take a finer unit.
    """
    return F.date_trunc(unit, ts)


def value_block(value: str | Column, bins: int = 4096) -> Column:
    """Monotone block of a number: ``bins`` blocks per power of two, no statistics needed."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * bins)).cast("long")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    specs: dict[str, tuple[str, Column]],
    descending: bool = False,
    split: bool = True,
) -> DataFrame:
    """Add running values per key in ``order``; heavy keys are cut by ``block``, None says that no key is heavy.

    Without ``split`` all keys are cut, see :func:`dense`.

    ``specs`` maps an output column to (kind, expression); kinds are ``sum``, ``count``, ``max``,
    ``min`` (current row included), ``sum_before``, ``max_before`` (excluded), ``last`` and
    ``first`` (non-null, included), ``last_before`` (non-null, excluded) and ``lag``.
    ``order`` must be unique inside a key.
    """
    if block is None:
        return _plain(df, keys, order, specs, descending)
    few, many = by_weight(df, keys) if split else (None, df)
    out = [] if few is None else [_plain(few, keys, order, specs, descending)]
    out += [] if many is None else [_blocked(many, keys, order, block, specs, descending)]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _plain(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, Column]], descending: bool) -> DataFrame:
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[F.desc(c) if descending else F.asc(c) for c in order])
    upto, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name, (kind, value) in specs.items():
        if kind not in KINDS:
            raise ValueError(f"unknown running kind {kind!r}")
        if kind == "lag":
            out.append(F.lag(value).over(line).alias(name))
        elif kind == "count":
            out.append(F.count(value).over(upto).alias(name))
        else:
            out.append(_over(kind, value, before if kind.endswith("_before") else upto).alias(name))
    return df.select("*", *out)


def _blocked(df: DataFrame, keys: list[str], order: list[str], block: Column, specs: dict[str, tuple[str, Column]], descending: bool) -> DataFrame:
    names = list(specs)
    rows = df.withColumn(BLOCK, block).withColumns({f"_in_{n}": _input(*specs[n]) for n in names})
    place = F.struct(*order)
    newest, oldest = (F.min_by, F.max_by) if descending else (F.max_by, F.min_by)

    def partial(n: str) -> Column:
        kind, v = specs[n][0], F.col(f"_in_{n}")
        if kind in ("sum", "sum_before", "count"):
            return F.sum(v)
        if kind in ("max", "max_before"):
            return F.max(v)
        if kind == "min":
            return F.min(v)
        return (oldest if kind == "first" else newest)(v, F.when(v.isNotNull(), place))

    # one row per block: what all earlier blocks of the key add up to
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(BLOCK) if descending else F.asc(BLOCK))
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys, BLOCK).agg(*[partial(n).alias(f"_in_{n}") for n in names])
    carry = blocks.select(*keys, BLOCK, *[_over(specs[n][0], f"_in_{n}", earlier).alias(f"_in_{n}") for n in names],
                          F.count("*").over(earlier).alias("_n")).filter("_n > 0").drop("_n")

    line = rows.withColumn("_tag", F.lit(1)).unionByName(carry.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, BLOCK).orderBy("_tag", *[F.desc(c) if descending else F.asc(c) for c in order])
    out = []
    for n in names:
        kind = specs[n][0]
        if kind == "lag":
            out.append(F.lag(f"_in_{n}").over(inside)["v"].alias(n))
        else:
            end = -1 if kind.endswith("_before") else Window.currentRow
            out.append(_over(kind, f"_in_{n}", inside.rowsBetween(Window.unboundedPreceding, end)).alias(n))
    return line.select(*df.columns, *out, "_tag").filter("_tag = 1").drop("_tag")


KINDS = ("sum", "sum_before", "count", "max", "max_before", "min", "last", "last_before", "first", "lag")


def _input(kind: str, value: Column) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown running kind {kind!r}")
    if kind == "count":
        return F.when(value.isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    # wrapped, so that a null value differs from "no earlier row"
    return F.struct(value.alias("v")) if kind == "lag" else value


def _over(kind: str, column: str | Column, frame) -> Column:
    base = kind.removesuffix("_before")
    if base in ("sum", "count"):
        return F.sum(column).over(frame)
    if base in ("max", "min"):
        return getattr(F, base)(column).over(frame)
    return (F.first if base == "first" else F.last)(column, ignorenulls=True).over(frame)


def placed(df: DataFrame, keys: list[str], order: list[str], label: str = "placed") -> DataFrame:
    """The rows, range-partitioned by (keys, order) and written once with their partition's number in PLACE.

    ``F.col(PLACE)`` is a block for :func:`running` that follows the density of the rows: a key with many
    rows spans many partitions, small keys share one, and the summaries are one row per key and
    partition. All passes read the written rows; the source is read for them alone.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn(PLACE, F.spark_partition_id()), label)


def numbered(df: DataFrame, order: list[Column | str], name: str, label: str = "numbered") -> DataFrame:
    """Rows numbered from 1 in a global order: one range sort, written, plus the row counts of the partitions before."""
    rows = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_at", 33))
    # one row per partition of the sort
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, place).select(*df.columns, name)


def heavy_keys(df: DataFrame, keys: list[str]) -> dict[int, int]:
    """Hashes of the keys that hold more than one task's even share of the rows, with the tasks each would fill.

    A frequent-items sketch, merged over all tasks, tracks 16 keys per shuffle partition; at most one key
    per partition can pass the bar, so the answer is small whatever the table holds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    top, rows = hashed.agg(F.expr(f"approx_top_k(h, {parts}, {min(1_000_000, max(1000, 16 * parts))})"), F.count("*")).first()
    return {x["item"]: -(-x["count"] * parts // rows) for x in top or [] if x["count"] * parts > rows}


def by_weight(df: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of light and of heavy keys; None where there are none for sure. Without keys all rows are one heavy key."""
    if not keys:
        return None, df
    hot = heavy_keys(df, keys)
    if not hot:
        return df, None
    rows = _hot(df, keys, hot)
    return rows.filter(F.col("_tasks").isNull()).drop("_tasks"), rows.filter(F.col("_tasks").isNotNull()).drop("_tasks")


def dense(df: DataFrame, keys: list[str], order: list[str], run: Callable[[DataFrame, Column | None], DataFrame], label: str = "placed") -> DataFrame:
    """``run(rows, block)`` over the light keys' rows without blocks and over the heavy keys' rows placed by density.

    The steps of ``run`` take the rows as they come (``split=False``). For operators of several ordered steps on the same keys: light keys share one shuffle for all steps.
    """
    few, many = by_weight(df, keys)
    out = [] if few is None else [run(few, None)]
    out += [] if many is None else [run(placed(many, keys, order, label), F.col(PLACE))]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _hot(df: DataFrame, keys: list[str], hot: dict[int, int]) -> DataFrame:
    """Add ``_tasks``: the tasks that a heavy key would fill, null for all other keys."""
    table = df.sparkSession.createDataFrame(list(hot.items()), "_h long, _tasks int")
    return df.join(F.broadcast(table), F.xxhash64(*keys) == F.col("_h"), "left").drop("_h")


def attach(df: DataFrame, info: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """Add the columns of ``info`` (one row per key) to every row with that key; a null key is a key like any other.

    A join on the keys in which only heavy keys are salted: their rows are dealt over as many tasks as
    they fill, and their row of ``info`` is copied as often.
    """
    extra = [c for c in info.columns if c not in keys]
    named = info.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*extra).alias("_info"))
    hot = heavy_keys(df, keys)
    if not hot:
        out = df.join(named, _same(keys), how)
    else:
        rows = _hot(df, keys, hot).withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_tasks")), F.lit(0)))
        copies = _hot(named, [f"_k_{k}" for k in keys], hot).withColumn(
            "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_tasks"), F.lit(1)).cast("long") - 1))).drop("_tasks")
        out = rows.join(copies, _same(keys) & (F.col("_salt") == F.col("_copy")), how)
    return out.select(*df.columns, *[F.col(f"_info.`{c}`").alias(c) for c in extra])


def group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Add aggregates of each key's rows to these rows: one read and one window.

    Rows of heavy keys do not go through the window; their keys are aggregated, which gives a row for
    each, and these few rows are broadcast.
    """
    few, many = by_weight(df, keys)
    over = [c.over(Window.partitionBy(*keys)).alias(n) for n, c in stats.items()]
    if many is None:
        return few.select("*", *over)
    info = many.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    named = info.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *stats)
    return few.select("*", *over).unionByName(many.join(F.broadcast(named), _same(keys)).select(*df.columns, *stats))


def _same(keys: list[str]) -> Column:
    """Equality of ``keys`` with their ``_k_`` copies, null equal to null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return out


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with row counts and the rows above and below each value."""
    hist = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), "value-counts")
    out = running(hist, keys, [value], value_block(value), {"_upto": ("sum", F.col("n"))}, split=False)
    totals = hist.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        named = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "total")
        out = out.join(named, _same(keys))
    else:
        out = out.withColumn("total", totals.scalar())
    return out.select(
        *keys, value, "n", "total",
        (F.col("_upto") - F.col("n")).alias("below"),
        (F.col("total") - F.col("_upto")).alias("above"),
    )


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``rank`` (highest value first, ties share it) and ``percentile`` in [0, 1].

    Ranks are computed on the distinct values and joined back, so ties of any size stay spread.
    Rows without a value share the rank behind all others, with percentile 0.
    """
    ranks = value_ranks(df, keys, value).select(
        *keys, value,
        (F.col("above") + 1).alias("rank"),
        F.coalesce(F.try_divide(F.col("below").cast("double"),
                                (F.col("total") - 1).cast("double")), F.lit(0.0)).alias("percentile"),
    )
    kind = df.schema[value].dataType
    last = df.groupBy(*keys).agg(F.count(value).alias("n")).select(
        *keys, F.lit(None).cast(kind).alias(value), (F.col("n") + 1).alias("rank"), F.lit(0.0).alias("percentile"))
    return attach(df, ranks.unionByName(last), [*keys, value], F.struct(*df.columns))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key: an aggregate for light keys, value counts for heavy ones, of which none is held in memory."""
    few, many = by_weight(df, keys)
    out = [] if few is None else [few.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()]).filter(
        F.coalesce(*probs).isNotNull())]
    out += [] if many is None else [_counted_quantiles(many, keys, value, probs)]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _counted_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from value counts: only the blocks of values that hold a wanted position are ordered."""
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), "value-counts")
    counts = counts.withColumn(BLOCK, value_block(value))
    of_key = Window.partitionBy(*[f"_k_{k}" for k in keys]) if keys else Window.partitionBy(F.lit(0))
    blocks = counts.groupBy(*keys, BLOCK).agg(F.sum("n").alias("_rows")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_b"), "_rows")
    blocks = blocks.withColumn("total", F.sum("_rows").over(of_key)).withColumn(
        "_before", F.sum("_rows").over(of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"))
    position = {n: (F.col("total") - 1) * F.lit(p) for n, p in probs.items()}
    wanted = [f(at) for at in position.values() for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for at in wanted:
        hit = hit | ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_rows")))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(blocks.filter(hit), _same(keys) & (F.col(BLOCK) == F.col("_b"))).withColumn(
        "_below", F.col("_before") + F.sum("n").over(inside) - F.col("n"))
    aggs = []
    for name, at in position.items():
        for side, one in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found = (F.col("_below") <= one) & (one < F.col("_below") + F.col("n"))
            aggs.append(F.max(F.when(found, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    cols = [(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for n in probs]
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *cols)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                salt: Column, salts: int = 64) -> DataFrame:
    """First ``n`` rows per key: cut to n per (key, salt) first, then per key."""
    pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
    fin = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(pre))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(fin))
        .filter(F.col("_rn") <= n)
        .drop("_salt")
        .withColumnRenamed("_rn", "rn")
    )


def trailing_rows(df: DataFrame, keys: list[str], order: list[str], block: Column | None, n: int,
                  aggs: dict[str, Column], also: dict[str, tuple[str, Column]] | None = None, chunk: int = 4096,
                  split: bool = True) -> DataFrame:
    """Aggregates over the ``n`` rows before each row of a key.

    ``also`` adds running values, see :func:`running`, from the pass that numbers the rows. Rows of
    heavy keys get their position, then are windowed in chunks of positions; the last ``n`` rows of a
    chunk are copied into the next one, so every frame is complete inside its chunk.
    """
    if block is None:
        few, many = df, None
    else:
        few, many = by_weight(df, keys) if split else (None, df)
    out = [] if few is None else [_trailing_plain(few, keys, order, n, aggs, also)]
    out += [] if many is None else [_trailing_blocked(many, keys, order, block, n, aggs, also, chunk)]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _trailing_plain(df: DataFrame, keys: list[str], order: list[str], n: int, aggs: dict[str, Column],
                    also: dict[str, tuple[str, Column]] | None) -> DataFrame:
    frame = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(-n, -1)
    return _plain(df, keys, order, also or {}, False).select("*", *[c.over(frame).alias(name) for name, c in aggs.items()])


def _trailing_blocked(df: DataFrame, keys: list[str], order: list[str], block: Column, n: int, aggs: dict[str, Column],
                      also: dict[str, tuple[str, Column]] | None, chunk: int) -> DataFrame:
    size = max(chunk, n)
    at = F.col("_pos") - 1
    home = F.floor(at / size)
    pos = _blocked(df, keys, order, block, {"_pos": ("count", F.lit(1)), **(also or {})}, False)
    spread = pos.withColumn("_home", home).withColumn("_chunk", F.explode(
        F.when(at % size >= size - n, F.array(home, home + 1)).otherwise(F.array(home))))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-n, -1)
    out = spread.select("*", *[c.over(frame).alias(name) for name, c in aggs.items()])
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_pos", "_home", "_chunk")


def trailing_time(df: DataFrame, keys: list[str], ts: str, seconds: int, aggs: dict[str, Column],
                  spans: int = 4) -> DataFrame:
    """Aggregates over the rows of a key in the ``seconds`` up to and including each row.

    Heavy keys are cut into blocks of ``spans`` frame lengths; rows in the last length of a block are
    copied into the next one.
    """
    width = seconds * 1_000_000
    few, many = by_weight(df, keys)
    if many is not None:
        blocked = _trailing_time_blocked(many, keys, ts, width, aggs, spans)
        return blocked if few is None else _trailing_time_plain(few, keys, ts, width, aggs).unionByName(blocked)
    return _trailing_time_plain(few, keys, ts, width, aggs)


def _trailing_time_plain(df: DataFrame, keys: list[str], ts: str, width: int, aggs: dict[str, Column]) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-width, 0)
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.select("*", *[c.over(frame).alias(name) for name, c in aggs.items()]).drop("_us")


def _trailing_time_blocked(df: DataFrame, keys: list[str], ts: str, width: int, aggs: dict[str, Column], spans: int) -> DataFrame:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    home = F.floor(F.col("_us") / (width * spans))
    spread = df.withColumn("_us", us).withColumn("_home", home).withColumn("_chunk", F.explode(
        F.when(F.pmod(F.col("_us"), F.lit(width * spans)) >= width * (spans - 1),
               F.array(home, home + 1)).otherwise(F.array(home))))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_us").rangeBetween(-width, 0)
    out = spread.select("*", *[c.over(frame).alias(name) for name, c in aggs.items()])
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_us", "_home", "_chunk")
