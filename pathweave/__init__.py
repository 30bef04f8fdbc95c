"""Spatial-trajectory analytics as PySpark DataFrame transformations.

Points, segments and GeoParquet layouts of GPS trajectories, with bounding-box
and k-nearest-neighbour queries over each of them. Every public operator is a
plain function ``DataFrame -> DataFrame``. Most stay lazy until the caller acts; those
that have to know or store something first say so and run a job when called.
"""

import sys

from pyspark import cloudpickle

from pathweave.schemas import BBox, GridSpec

# The Arrow function and the GeoParquet writer run in Python workers; sent by
# value, they need no copy of this package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BBox", "GridSpec"]
