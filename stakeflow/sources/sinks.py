"""Lake zones, star tables, exports, snapshots and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stakeflow.functions.semantics import as_time, ntz


# Text formats cut timestamps to milliseconds by default; these keep microseconds.
TEXT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _files(spark: SparkSession, path: str):
    """The file system of a path and what the path lists."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, list(fs.listStatus(root))


def export_report(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """Write a csv or json report and return its record count and size in bytes.

    The records are counted on their way to the files, so nothing is read back.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("format must be csv or json")
    spark, counted = df.sparkSession, Observation()
    writer = df.observe(counted, F.count("*").alias("n")).write.format(fmt).options(**TEXT_TIMES)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    size = sum(f.getLen() for f in _files(spark, path)[1] if f.getPath().getName().endswith(f".{fmt}"))
    return spark.createDataFrame([(fmt, counted.get["n"], size)], "format string, record_count long, size long")


def lake_refine(raw: DataFrame, path: str, clean: dict[str, Column], valid: Column, mapping: dict[str, str], day: Column) -> dict[str, DataFrame]:
    """Cleaned, validated and normalized zones, each written by day and read back for the next.

    Returns the zones and the rejected rows.
    """
    spark: SparkSession = raw.sparkSession

    def zone(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy("day").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    cleaned = zone(raw.withColumns(clean).withColumn("day", day), "cleaned")
    ok = F.coalesce(valid, F.lit(False))
    validated = zone(cleaned.filter(ok), "validated")
    rejected = zone(cleaned.filter(~ok), "rejected")
    normalized = zone(validated.select("day", *[F.col(s).alias(d) for s, d in mapping.items()]), "normalized")
    return {"cleaned": cleaned, "validated": validated, "rejected": rejected, "normalized": normalized}


def build_star(path: str, fact: DataFrame, dims: dict[str, DataFrame], partition: str | None = None) -> dict[str, DataFrame]:
    """Write a fact table and its dimensions, return them as read from the files."""
    spark = fact.sparkSession
    writer = fact.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/fact")
    out = {"fact": spark.read.parquet(f"{path}/fact")}
    for name, d in dims.items():
        d.write.mode("overwrite").parquet(f"{path}/dim_{name}")
        out[name] = spark.read.parquet(f"{path}/dim_{name}")
    return out


def snapshot(df: DataFrame, path: str, kind: str, ts: str | None = None, since=None) -> DataFrame:
    """Full copy of a table, or the rows changed after ``since``."""
    if kind == "incremental":
        if ts is None or since is None:
            raise ValueError("an incremental snapshot needs a time column and since")
        df = df.filter(F.col(ts) > ntz(since))
    elif kind != "full":
        raise ValueError("kind must be 'full' or 'incremental'")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


# Fixed value: days kept by default.
RETENTION_DAYS = 90


def retention(df: DataFrame, ts: str, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last ``days`` days; the filter reaches the scan or its partitions."""
    import datetime as dt
    return df.filter(F.col(ts) >= ntz(as_time(now) - dt.timedelta(days=days)))


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    df.withColumn("day", F.to_date(ts)).write.partitionBy("day").parquet(path)


def retain(spark: SparkSession, path: str, ts: str, now, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop the rows of a table stored by day (:func:`write_by_day`) that are older than ``days`` days.

    Folders of expired days, and of rows without a time, are removed by name, without reading a row; only
    the boundary day is written anew. Files of later days are not touched.
    """
    import datetime as dt
    cut = as_time(now) - dt.timedelta(days=days)
    table = spark.read.parquet(path)
    fs, listed = _files(spark, path)
    boundary = None
    for day in listed:
        name = day.getPath().getName()
        if not name.startswith("day="):
            continue
        value = name.removeprefix("day=")
        if value.startswith("__") or value < str(cut.date()):
            fs.delete(day.getPath(), True)
        elif value == str(cut.date()) and cut.time() != dt.time():
            boundary = day.getPath()
    if boundary is not None:
        kept = table.filter((F.col("day") == F.lit(cut.date())) & (F.col(ts) >= ntz(cut)))
        if kept.isEmpty():
            fs.delete(boundary, True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def refresh_rollup(stored: DataFrame, changed: DataFrame, bucket: str, since) -> DataFrame:
    """Rollup after new data: stored buckets before ``since`` and recomputed ones from it on.

    ``since`` is a bucket start; ``changed`` is the rollup of the rows from there on, so old rows are not read.
    """
    return stored.filter(F.col(bucket) < ntz(since)).unionByName(changed)
