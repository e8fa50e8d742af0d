"""Registration of queries, and the projections of the driver's tables that stand for the domain's records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and its SQL."""

    def add(function):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def scaled_round(x: Column, digits: int) -> Column:
    """x rounded as DuckDB rounds floats: scaled first, then to a whole number, halves away from 0.

    Spark's own round goes by the shortest decimal of x, so that a value by a half can fall to the other side.
    """
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: identity, time in microseconds, position, motion and wind."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("ident"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.expr("12.2D + (event_id * 7919 % 42000) / 1000.0D").alias("lat"), F.expr("73.0D + (event_id * 104729 % 62000) / 1000.0D").alias("lon"),
        F.expr("cast(event_id * 31 % 15000 as double)").alias("alt"), F.expr("cast(event_id * 37 % 360 as double)").alias("heading"), F.col("value").alias("speed"),
        F.expr("case when event_type in ('view', 'click') then 'amdar' when event_type = 'purchase' then 'turb' else 'other' end").alias("source"),
        F.expr("cast(event_id * 53 % 360 as double)").alias("wind_dir"), F.expr("value % 150D").alias("wind_speed"), "ts", "event_type", "props",
    )


OBS = """obs AS (
    SELECT event_id, user_id AS ident, epoch_us(ts) AS us,
           12.2::DOUBLE + (event_id * 7919 % 42000) / 1000.0::DOUBLE AS lat, 73.0::DOUBLE + (event_id * 104729 % 62000) / 1000.0::DOUBLE AS lon,
           (event_id * 31 % 15000)::DOUBLE AS alt, (event_id * 37 % 360)::DOUBLE AS heading, value AS speed,
           CASE WHEN event_type IN ('view', 'click') THEN 'amdar' WHEN event_type = 'purchase' THEN 'turb' ELSE 'other' END AS source,
           (event_id * 53 % 360)::DOUBLE AS wind_dir, value % 150::DOUBLE AS wind_speed, ts, event_type, props
    FROM events
)"""


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evaluation rows: a key, error components, speed and weight."""
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_discount") * 10).alias("eu"), (F.col("l_tax") * 10).alias("ev"),
        (F.col("l_extendedprice") / 1000).alias("gt_speed"), F.col("l_quantity").alias("w"), F.col("l_returnflag").alias("config"), F.col("l_linestatus").alias("role"),
    )


ERRORS = """errors AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_discount * 10 AS eu, l_tax * 10 AS ev,
           l_extendedprice / 1000 AS gt_speed, l_quantity AS w, l_returnflag AS config, l_linestatus AS role FROM lineitem
)"""

#: haversine in DuckDB, of two points given by prefixes
HAVERSINE = "2 * 6371.0 * asin(sqrt(greatest(0.0, least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as calibration rows: p and y."""
    return read(spark, sf_dir, "labels").select("doc_id", F.expr("(doc_id * 7919 % 1000) / 1000.0D").alias("p"), F.col("quality").cast("double").alias("y"))


SCORED = "scored AS (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS p, quality::DOUBLE AS y FROM labels)"
