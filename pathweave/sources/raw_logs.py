"""Raw GPS logs: ``<root>/<user>/Trajectory/<traj_id>.plt`` to points.

A log has six header lines, then comma-separated rows of which fields 0, 1, 3,
5 and 6 are latitude, longitude, altitude, date and time.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from pathweave.functions.scalars import parse_log_time
from pathweave.operators.ordering import renumber
from pathweave.session import stored_table
from pathweave.sources.geo_files import place

HEADER_LINES = 6
LOG_GLOB = "*/Trajectory/*.plt"
# A file up to this size is read as one row by one task; a larger one is read
# as splittable lines, so no task ever holds a large file.
WHOLE_FILE_BYTES = 32 * 1024 * 1024
# How every number begins, also infinite ones and NaN. A cast of other text fails by an
# exception inside, which takes longer than the rest of the line.
_MAY_BE_NUMBER = r"^[\x00-\x20]*[+-]?[0-9.iInN]"


def log_files(reader: DataFrameReader | DataStreamReader, root: str, glob: str, **options: bool) -> DataFrame:
    """Text of the files that ``glob`` names below ``root``, listed by folder.

    A path that names every file makes each of them a root of its own: a listing each,
    ten thousand tasks to make them, and plans that hold all paths.
    """
    folder, _, name = f"{root.rstrip('/')}/{glob}".rpartition("/")
    return reader.option("pathGlobFilter", name).text(folder, **options)


def _last(parts: int) -> Column:
    """The last parts of a line's path, all that patterns look at: on a whole path they
    begin anew at every character, which takes far longer than the line."""
    return F.substring_index("path", "/", -parts)


def _small_file_lines(spark: SparkSession, root: str, glob: str, limit: int) -> DataFrame:
    files = log_files(spark.read, root, glob, wholetext=True).where(
        F.col("_metadata.file_size") <= limit
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"),
    ).select("path", F.col("line_no").cast("long").alias("line_no"), "line")


def _large_file_lines(spark: SparkSession, root: str, glob: str, limit: int) -> DataFrame:
    """Lines of large files with their line number, without reading any file in
    one task: position inside the split plus the line counts of earlier splits.
    """
    lines = (
        log_files(spark.read, root, glob)
        .where(F.col("_metadata.file_size") > limit)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row_id"),
            F.col("value").alias("line"),
        )
    )
    # one row per split: tiny next to the lines
    splits = lines.groupBy("path", "split").agg(
        F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n")
    )
    earlier = (
        Window.partitionBy("path")
        .orderBy("split")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = splits.select(
        "path",
        "split",
        "first_row",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"),
    )
    return lines.join(starts, ["path", "split"]).select(
        "path",
        (F.col("lines_before") + F.col("row_id") - F.col("first_row")).alias("line_no"),
        "line",
    )


def write_log_lines(lines: DataFrame, root: str) -> int:
    """Files below ``root`` from ``(path, line_no, line)``, one for each path; how many.

    Only the last three parts of a path count (``<user>/Trajectory/<name>``). Lines
    are streamed into their file in order, so none is held as a whole; a file appears
    when it is complete, and a repeated task replaces it by the same one. Header lines
    are lines like any other.
    """
    name = F.regexp_extract(_last(3), r"([^/]+/[^/]+/[^/]+)$", 1)
    rows = lines.select(name.alias("name"), "line_no", "line").repartition("name").sortWithinPartitions("name", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(root)
        held, stream, written, made = None, None, [], set()

        def finish() -> None:
            stream.close()
            fs.move(f"{base}/{held}.{token}", f"{base}/{held}")
            written.append(held)

        token = f"{uuid.uuid4().hex}.writing"
        for batch in batches:
            names, texts = np.array(batch.column("name").to_pylist(), object), batch.column("line").to_pylist()
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1)] if len(names) else []
            for first, end in zip(starts, [*starts[1:], len(names)]):
                if names[first] != held:
                    if held is not None:
                        finish()
                    held = names[first]
                    folder = posixpath.dirname(f"{base}/{held}")
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    stream = fs.open_output_stream(f"{base}/{held}.{token}")
                stream.write("".join([f"{line}\n" for line in texts[first:end]]).encode())
        if held is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["name"])

    return rows.mapInArrow(run, "name string").count()


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(path, line_no, line)`` to point columns plus ``path, line_no, line``.

    Nothing is dropped but header and blank lines; a malformed row has a null
    in ``lat``, ``lon``, ``altitude`` or ``timestamp``.
    """
    kept = lines.where((F.col("line_no") >= HEADER_LINES) & (F.trim("line") != ""))
    field = F.col("_field")
    number: dict[str, Column] = {
        "lat": F.get(field, 0),
        "lon": F.get(field, 1),
        "altitude": F.get(field, 3),
    }
    values = F.struct(
        *[F.when(v.rlike(_MAY_BE_NUMBER), F.trim(v).try_cast("double")).alias(k) for k, v in number.items()],
        parse_log_time(F.trim(F.get(field, 5)), F.trim(F.get(field, 6))).alias("timestamp"),
    )
    # exploding arrays of one element: a filter on the values, pushed below a plain
    # projection, would split and parse the line again for each of its terms
    fields = kept.select("path", "line_no", "line", F.explode(F.array(F.split(F.trim("line"), ","))).alias("_field"))
    return fields.select("path", "line_no", "line", F.inline(F.array(values))).select(
        F.regexp_extract(_last(3), r"([^/]+)/Trajectory/[^/]*$", 1).alias("user_id"),
        F.regexp_extract(_last(1), r"([^/]+?)(\.[^./]*)?$", 1).alias("traj_id"),
        (F.col("line_no") - HEADER_LINES).alias("seq"),
        *number,
        "timestamp",
        "path",
        "line_no",
        "line",
    )


def is_complete() -> Column:
    """A parsed row carries every value of a point, and its numbers are finite."""
    finite = [
        F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
        for c in ("lat", "lon", "altitude")
    ]
    return finite[0] & finite[1] & finite[2] & F.col("timestamp").isNotNull()


def _parsed(spark: SparkSession, root: str, glob: str, whole_file_bytes: int):
    return parse_lines(
        _small_file_lines(spark, root, glob, whole_file_bytes).unionByName(
            _large_file_lines(spark, root, glob, whole_file_bytes)
        )
    )


def read_raw_logs(
    spark: SparkSession,
    root: str,
    glob: str = LOG_GLOB,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """Every well-formed point below ``root``, in the POINTS schema.

    ``seq`` counts the well-formed rows of a log from zero, without gaps. A log
    without points yields no rows, hence no trajectory. Logs are parsed when this is
    called, once, and their points stored.
    """
    rows = _parsed(spark, root, glob, whole_file_bytes).where(is_complete())
    # numbering asks twice for its rows
    points = stored_table(rows.drop("path", "line_no", "line"), "log-points")
    return renumber(points, ("user_id", "traj_id"))


def read_malformed_lines(
    spark: SparkSession,
    root: str,
    glob: str = LOG_GLOB,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """The rows :func:`read_raw_logs` leaves out: ``path, line_no, line``."""
    return (
        _parsed(spark, root, glob, whole_file_bytes)
        .where(~is_complete())
        .select("path", "line_no", "line")
    )
