"""User rules as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stakeflow.functions.rules import register_rule


def register_pandas_rule(spark: SparkSession, name: str, check: Callable[[pd.Series], pd.Series]) -> None:
    """Make a pandas check available to SQL under ``name`` and to the rule scans."""

    @F.pandas_udf("boolean")
    def rule(v: pd.Series) -> pd.Series:
        return check(v)

    spark.udf.register(name, rule)
    register_rule(name, lambda c: rule(c))
