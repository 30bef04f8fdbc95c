"""Times as whole numbers.

Range filters on TIMESTAMP_NTZ columns do not reach the statistics of Parquet row groups
(Spark 4.1 lists them as pushed and reads every group all the same), filters on numbers
do. Microseconds since 1970 are exact for both.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000
# a base slab has 2 ** 20 microseconds, about a second
SLAB_BITS = 20


def micros(name: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's zone."""
    whole = F.datediff(name, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(name) * 3600 + F.minute(name) * 60
    return whole * _SECOND + (F.extract(F.lit("SECOND"), F.col(name)) * _SECOND).cast("long")


def micros_of(moment: datetime) -> int:
    """The same of a value without zone."""
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def base_slab(name: str) -> Column:
    return F.shiftright(micros(name), SLAB_BITS)
