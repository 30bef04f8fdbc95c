"""Small scalar expressions used by reports and loaders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def parse_log_time(date: Column, time: Column) -> Column:
    """Naive timestamp of a raw log row; null if malformed.

    A cast rather than a pattern parse: it never passes through the session
    time zone, so local times inside a daylight-saving gap survive.
    """
    well_formed = date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & time.rlike(
        r"^\d{1,2}:\d{1,2}:\d{1,2}$"
    )
    return F.when(
        well_formed, F.concat_ws(" ", date, time).try_cast("timestamp_ntz")
    )


def iso_text(timestamp: Column) -> Column:
    """ISO-8601 text; the fraction appears only if there is one."""
    micros = F.date_format(timestamp, "SSSSSS")
    return F.concat(
        F.date_format(timestamp, ISO_FORMAT),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
    )


def percent_above(value: Column, smallest: Column) -> Column:
    """How much larger than the smallest, in percent; 0 if the smallest is 0."""
    return F.when(smallest > 0, 100.0 * (value - smallest) / smallest).otherwise(0.0)


def match_class(metres: Column) -> Column:
    """Agreement of two k-NN answers at the same rank."""
    # fixed values: class limits in metres and class names
    return (
        F.when(metres < 0.5, "same").when(metres < 1.0, "small dif").otherwise("big dif")
    )

