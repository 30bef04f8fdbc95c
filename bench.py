"""Time the layouts against each other; prints one JSON line.

``build_*`` entries write a layout; the others answer a question from a stored
layout (``knn_batch`` with a stored pyramid), or from the tables directly
(``view_*``). All report the median of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pathweave.operators import bbox, knn  # noqa: E402
from pathweave.operators.bbox_batch import bbox_batch  # noqa: E402
from pathweave.operators.extent import point_extent  # noqa: E402
from pathweave.operators.index import fixed_index, grid_index  # noqa: E402
from pathweave.operators.knn_batch import build_pyramid, knn_batch  # noqa: E402
from pathweave.operators.segmentation import (  # noqa: E402
    fixed_segments,
    grid_segments,
)
from pathweave.plans.layouts import Layouts, open_layouts  # noqa: E402
from pathweave.plans.sample_queries import BOX, FAR_POINT, POINT  # noqa: E402
from pathweave.plans.table_views import (  # noqa: E402
    LINEITEM_ORDER,
    customer_boxes,
    lineitem_points,
    lineitem_rows,
    supplier_queries,
)
from pathweave.session import with_defaults  # noqa: E402
from pathweave.sources.geoparquet import (  # noqa: E402
    without_geometry,
    write_geoparquet,
)
from pathweave.sources.points import write_points, write_points_csv  # noqa: E402
from pathweave.sources.segments import read_segments, write_segments  # noqa: E402

REPEATS = 3
K = 10


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        with_defaults(SparkSession.builder.master(f"local[{cpus}]"))
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = Layouts(tempfile.mkdtemp(prefix="run-"))
    seconds: dict[str, float] = {}

    def build(name: str, run) -> None:
        run()  # starts workers and compiles code
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)

    def ask(name: str, make) -> None:
        consume(make())
        times = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            consume(make())
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)

    consume(lineitem_rows(spark, sf_dir))
    build("build_points", lambda: write_points(lineitem_points(spark, sf_dir), out.points, "overwrite"))
    stored = spark.read.parquet(out.points)
    build("build_csv", lambda: write_points_csv(stored, out.csv, "overwrite"))
    build("build_fixed", lambda: write_segments(fixed_segments(stored), out.fixed, "overwrite"))
    build(
        "build_fixed_index",
        lambda: write_segments(
            fixed_index(read_segments(spark, out.fixed)), out.fixed_index, "overwrite", cluster=False
        ),
    )
    build(
        "build_grid",
        lambda: write_segments(
            grid_segments(stored, point_extent(stored)), out.grid, "overwrite"
        ),
    )
    build(
        "build_grid_index",
        lambda: write_segments(
            grid_index(read_segments(spark, out.grid)), out.grid_index, "overwrite", cluster=False
        ),
    )
    build("build_geo", lambda: write_geoparquet(stored, out.geo, "overwrite"))
    build(
        "build_geo_small_groups",
        lambda: write_geoparquet(
            stored, out.geo_small_groups, "overwrite", row_group_size=10_000
        ),
    )

    at = open_layouts(spark, out)
    points, fixed, grid = at["Base Parquet"], at["Fixed Segments"], at["Grid Segments"]
    fixed_knn, grid_knn = at["Fixed Segments (index)"], at["Grid Segments (index)"]
    geo = without_geometry(at["GeoParquet (small groups)"])
    rows = lineitem_rows(spark, sf_dir)

    ask("bbox_points", lambda: bbox.bbox_points(points, BOX))
    ask("bbox_csv", lambda: bbox.bbox_points(at["CSV"], BOX))
    ask("bbox_geo", lambda: bbox.bbox_points(geo, BOX))
    ask("bbox_fixed", lambda: bbox.bbox_segments(fixed, BOX))
    ask("bbox_grid", lambda: bbox.bbox_segments(grid, BOX))
    ask("bbox_grid_any_point", lambda: bbox.bbox_segments(grid, BOX, "points"))
    ask("knn_points", lambda: knn.knn_points(points, POINT, K))
    ask("knn_points_far", lambda: knn.knn_points(points, FAR_POINT, K))
    ask("knn_fixed_exact", lambda: knn.knn_segments(fixed, POINT, K))
    ask("knn_fixed_nodedup", lambda: knn.knn_segment_points(fixed, POINT, K))
    ask("knn_fixed_index", lambda: knn.knn_fixed_index(fixed_knn, POINT, K))
    ask("knn_grid_exact", lambda: knn.knn_segments(grid, POINT, K))
    ask("knn_grid_index", lambda: knn.knn_grid_index(grid_knn, POINT, K))
    ask("knn_geo", lambda: knn.knn_geoparquet(geo, POINT, K, 0.001))
    ask("bbox_batch", lambda: bbox_batch(points, customer_boxes(spark, sf_dir)))
    pyramid_path = out.at("pyramid")
    build("build_pyramid", lambda: build_pyramid(points, K, pyramid_path))
    pyramid = build_pyramid(points, K, pyramid_path)
    asked = supplier_queries(spark, sf_dir)
    ask("knn_batch", lambda: knn_batch(points, asked, K, pyramid))
    ask("view_bbox", lambda: bbox.bbox_points(rows, BOX, order=LINEITEM_ORDER))
    ask("view_knn", lambda: knn.knn_points(rows, POINT, K))

    print(
        json.dumps(
            {
                "metric": "trajectory_layouts_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
