"""Trajectory views over business tables that carry no coordinates.

``lineitem`` becomes one trajectory per supplier, ordered by ship date and
drifting slowly north; ``events`` becomes one shorter trajectory per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.ordering import HOT_POINTS, dense_position

# orders the rows of one supplier; unique within it
LINEITEM_ORDER = (
    "timestamp",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_extendedprice",
)


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without ``seq``; LINEITEM_ORDER tells their order."""
    days = "datediff(l_shipdate, TIMESTAMP_NTZ'1992-01-01 00:00:00')"
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr("lpad(CAST(l_suppkey AS STRING), 12, '0')").alias("traj_id"),
        F.expr(f"39.98D + ({days} div 4) / 25000D").alias("lat"),
        F.expr("116.31D + (l_suppkey % 7) / 1000D + l_linenumber / 10000D").alias("lon"),
        F.col("l_quantity").alias("altitude"),
        F.col("l_shipdate").alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )


def lineitem_points(
    spark: SparkSession, sf_dir: str, hot_points: int = HOT_POINTS
) -> DataFrame:
    """``traj_id, seq, lat, lon, altitude, timestamp``."""
    rows = lineitem_rows(spark, sf_dir)
    return dense_position(rows, ["traj_id"], LINEITEM_ORDER, hot_points=hot_points).select(
        "traj_id", "seq", "lat", "lon", "altitude", "timestamp"
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr("lpad(CAST(user_id AS STRING), 12, '0')").alias("traj_id"),
        F.expr("40D + (event_id div 50) / 10000D").alias("lat"),
        F.expr("116.31D + (user_id % 7) / 1000D + (event_id % 5) / 20000D").alias("lon"),
        F.col("value").alias("altitude"),
        F.col("ts").alias("timestamp"),
        "event_id",
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traj_id, seq, lat, lon, altitude, timestamp``, ordered by time."""
    order = ["timestamp", "event_id"]
    return dense_position(event_rows(spark, sf_dir), ["traj_id"], order).select("traj_id", "seq", "lat", "lon", "altitude", "timestamp")


def customer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per customer, from a few metres to the whole area."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("box_id"),
        F.expr("39.985D + (c_custkey % 311) / 10000D").alias("min_lat"),
        F.expr(
            "39.985D + (c_custkey % 311) / 10000D + (1 + c_custkey % 13) / 20000D"
        ).alias("max_lat"),
        F.expr("116.31D + (c_custkey % 61) / 10000D").alias("min_lon"),
        F.expr(
            "116.31D + (c_custkey % 61) / 10000D + (1 + c_custkey % 5) / 10000D"
        ).alias("max_lon"),
    )


def customer_boxes_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' boxes, each for some time: from a day to more than a year, around
    the days on which trajectories drift through the box."""
    whole = customer_boxes(spark, sf_dir)
    start = "TIMESTAMP_NTZ'1992-01-01 00:00:00' + make_dt_interval(CAST(350 + 10 * (box_id % 311) + box_id * 37 % 200 AS INT))"
    return whole.withColumn("from_t", F.expr(start)).withColumn("to_t", F.expr("from_t + make_dt_interval(CAST(1 + box_id % 400 AS INT))"))


def supplier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query point per supplier; some lie well outside the points."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("query_id"),
        F.expr("39.98D + (s_suppkey % 97) / 2000D").alias("lat"),
        F.expr("116.305D + (s_suppkey % 53) / 3000D").alias("lon"),
    )
