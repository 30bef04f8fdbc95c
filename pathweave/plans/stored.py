"""Layouts of the sample views, built once per application and table folder."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from pathweave.plans.layouts import DISPLAY_NAMES, build_layouts, open_layouts
from pathweave.plans.table_views import lineitem_points
from pathweave.session import shared_root

def _root(spark: SparkSession, sf_dir: str) -> str:
    app = spark.sparkContext.applicationId
    tables = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return f"{shared_root(spark)}/pathweave-{app}/{tables}"


def stored_layouts(
    spark: SparkSession, sf_dir: str, *names: str
) -> dict[str, DataFrame]:
    """The named layouts (all, if none is named) of the supplier trajectories,
    written below the shared folder unless this application has done so before."""
    chosen = names or DISPLAY_NAMES
    layouts = build_layouts(
        spark, _root(spark, sf_dir), lineitem_points(spark, sf_dir), names=chosen
    )
    found = open_layouts(spark, layouts)
    return {name: found[name] for name in chosen}


def stored_layout(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stored_layouts(spark, sf_dir, name)[name]
