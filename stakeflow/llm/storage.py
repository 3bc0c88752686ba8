"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stakeflow.session import shared_dir


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a lost executor costs a read, not the work before it.
    """
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`written`, with the path, for a table that is dropped once its successor is written."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table of :func:`written_at`; whoever reads it must have been written before."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from the columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out
