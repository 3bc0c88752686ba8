"""Table access: raw tables, adapter views and fixed-schema entity scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stakeflow.sources.views import VIEWS, render

RAW = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Entity schemas, one fixed DDL each.
ENTITY_DDL: dict[str, str] = {
    "bet": (
        "bet_id string, user_id string, prediction_id string, bet_type string, stake double, "
        "odds double, market string, selection string, status string, sport string, league string, "
        "match_id string, placed_at timestamp, settled_at timestamp, cashout_available boolean, "
        "cashout_value double, "
        "legs array<struct<match_id:string,market:string,selection:string,odds:double>>"
    ),
    "prediction": (
        "prediction_id string, user_id string, match_id string, sport string, league string, "
        "market string, prediction string, confidence double, odds double, status string, "
        "is_correct boolean, model_used string, created_at timestamp"
    ),
    "match": (
        "match_id string, sport string, league string, home_team_id string, away_team_id string, "
        "match_date timestamp, status string, home_score int, away_score int, season string, "
        "is_important boolean"
    ),
    "quote": (
        "match_id string, market string, bookmaker string, outcome string, odds double, "
        "quoted_at timestamp"
    ),
    "activity": (
        "event_id string, user_id string, activity_type string, metadata map<string,string>, "
        "ip_address string, created_at timestamp"
    ),
    "access_log": (
        "request_id string, method string, path string, client_ip string, user_agent string, "
        "status_code int, duration_ms double, ts timestamp"
    ),
    "event_row": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def entity_schema(entity: str) -> T.StructType:
    return T.StructType.fromDDL(ENTITY_DDL[entity])


def scan_entity(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet",
                **options: str) -> DataFrame:
    """Read an entity with its fixed schema; nothing is inferred from the files.

    ``fmt`` is any Spark file format (parquet, orc, json, csv) or a connector such as jdbc.
    """
    if isinstance(schema, str) and schema in ENTITY_DDL:
        schema = ENTITY_DDL[schema]
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


class Tables:
    """Raw tables and adapter views of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def file(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        """A raw table; its footer is read for the schema once per session and path."""
        path = self.file(name)
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def view(self, name: str) -> DataFrame:
        text = render(name, "spark")
        used = {t: self.raw(t) for t in RAW if f"FROM {t}" in text or f"JOIN {t} " in text}
        for t in used:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.raw(name)
        if f"v_{name}" in VIEWS:
            return self.view(f"v_{name}")
        raise AttributeError(name)
