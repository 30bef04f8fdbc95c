"""Points as Parquet and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.predicates import point_in_box
from pathweave.operators.ordering import dense_position
from pathweave.schemas import POINTS, BBox
from pathweave.sources.layout import clustered

# rows of a compressed CSV file, some 80 MB before compression
CSV_FILE_ROWS = 1_000_000
CSV_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def clustered_points(points: DataFrame, partitions: int | None = None) -> DataFrame:
    tie = [c for c in ("user_id", "traj_id", "seq") if c in points.columns]
    return clustered(points, F.col("lat"), F.col("lon"), tie, partitions=partitions)


def write_points(
    points: DataFrame,
    path: str,
    mode: str = "errorifexists",
    cluster: bool = True,
    partitions: int | None = None,
) -> None:
    """Points Parquet, by default clustered so that box queries skip row groups."""
    rows = clustered_points(points, partitions) if cluster else points
    rows.write.mode(mode).parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).parquet(path)


def scan_points(points: DataFrame, box: BBox) -> DataFrame:
    """Points within the box; the four comparisons are pushed into the scan."""
    return points.where(point_in_box(box))


def read_foreign_points(
    spark: SparkSession, path: str, integer_unit: str = "ns"
) -> DataFrame:
    """Points Parquet written by other tools, in the POINTS schema.

    Accepts nanosecond timestamps and files without ``seq``: the stored row order
    then numbers each trajectory. Spark reads nanoseconds only as plain integers; an
    integer column of another unit is told by ``integer_unit`` (``ns``, ``us``, ``ms``
    or ``s``).
    """
    option = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(option, "false")
    spark.conf.set(option, "true")
    try:  # the schema is settled here; the setting is only needed for that
        raw = spark.read.parquet(path)
    finally:
        spark.conf.set(option, before)
    kind = raw.schema["timestamp"].dataType.simpleString()
    if kind == "bigint":
        nanos = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}[integer_unit]
        time = F.expr(
            "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval("
            "0, 0, 0, CAST(CAST(timestamp AS DECIMAL(30, 0)) * "
            f"{nanos} div 1000 AS DECIMAL(20, 0)) / 1000000)"
        )
    else:
        time = F.col("timestamp").cast("timestamp_ntz")
    user = "user_id" if "user_id" in raw.columns else "CAST(NULL AS STRING)"
    columns = {
        "user_id": F.expr(user),
        "traj_id": F.col("traj_id").cast("string"),
        "lat": F.col("lat").cast("double"),
        "lon": F.col("lon").cast("double"),
        "altitude": F.col("altitude").cast("double"),
        "timestamp": time,
    }
    if "seq" in raw.columns:
        columns["seq"] = F.col("seq").cast("long")
        return raw.select(*[c.alias(n) for n, c in columns.items()]).select(
            *POINTS.fieldNames()
        )
    stored = raw.select(
        *[c.alias(n) for n, c in columns.items()],
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row_index"),
    )
    return dense_position(stored, ["traj_id"], ["_file", "_row_index"]).select(
        *POINTS.fieldNames()
    )


def write_points_csv(
    points: DataFrame,
    path: str,
    mode: str = "errorifexists",
    compression: str = "none",
) -> None:
    """Points CSV. Compressed files can't be split when they are read, so they end
    after ``CSV_FILE_ROWS`` rows."""
    writer = points.write.mode(mode).option("header", True)
    if compression != "none":
        writer = writer.option("compression", compression)
        writer = writer.option("maxRecordsPerFile", CSV_FILE_ROWS)
    writer.option("timestampNTZFormat", CSV_TIME_FORMAT).csv(path)


def read_points_csv(
    spark: SparkSession, path: str, columns: list[str] | None = None
) -> DataFrame:
    """Points CSV under an explicit schema, so that an all-digit ``traj_id``
    stays text. ``columns`` names the file's columns if they are not those of
    the POINTS schema, in order."""
    schema = POINTS
    if columns is not None:
        schema = type(POINTS)([POINTS[c] for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", CSV_TIME_FORMAT)
        .csv(path)
    )
