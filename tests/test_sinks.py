"""Exports count what they write; retention drops whole days and leaves later files alone."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from stakeflow.session import shared_dir
from stakeflow.sources import sinks as S

from .test_scan import rows


def mtimes(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/day=*/*.parquet")}


@pytest.mark.parametrize("now, left", [("2024-04-20 07:30:00", None), ("2024-04-20 00:00:00", None), ("2024-12-31", 0), ("2024-01-05", None)])
def test_retention_by_day(spark, tables, now, left):
    out = shared_dir(spark, "by-day")
    table = tables.events.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    S.write_by_day(table, out, "ts")
    before = mtimes(out)
    got = S.retain(spark, out, "ts", now)
    cut = dt.datetime.fromisoformat(now) - dt.timedelta(days=90)
    want = table.filter(F.col("ts") >= F.lit(cut).cast("timestamp_ntz"))
    assert rows(got.select("event_id", "ts")) == rows(want.select("event_id", "ts"))
    assert left is None or got.count() == left
    after = mtimes(out)
    for f, at in before.items():
        day = os.path.basename(os.path.dirname(f)).removeprefix("day=")
        if day > str(cut.date()) and not day.startswith("__"):
            assert after[f] == at  # the very file
        elif day < str(cut.date()) or day.startswith("__"):
            assert f not in after
    assert all(f in before for f in after if f"day={cut.date()}" not in f)


def test_boundary_day_without_kept_rows(spark):
    out = shared_dir(spark, "by-day")
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2, 5))], "id long, ts timestamp_ntz")
    S.write_by_day(df, out, "ts")
    assert [r.id for r in S.retain(spark, out, "ts", "2024-01-11 06:00:00", 10).collect()] == [2]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_counts_and_sizes(spark, tables, fmt):
    for df in (tables.bet, tables.bet.limit(0)):
        out = shared_dir(spark, "export")
        r = S.export_report(df, out, fmt).first()
        assert (r.format, r.record_count) == (fmt, df.count())
        assert r["size"] == sum(os.path.getsize(f) for f in glob.glob(f"{out}/*.{fmt}"))
    with pytest.raises(ValueError):
        S.export_report(tables.bet, "x", "xml")
