"""Connected components of a graph that may be large, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.common import stage_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long): the smallest node it
    can reach."""
    found = stars(edges, name)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())


def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """``components`` without the nodes that are the smallest of theirs.

    Each round ties every node to the smallest of its neighbours, first the larger
    ones around it (large star), then the smaller ones (small star); it ends when a
    round changes nothing. Neighbours are only ever counted and minimised, never
    gathered, and the number of rounds grows with the logarithm of the longest path.
    """
    links = stage_table(_cleaned(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), name)
    before = _print(links)
    while True:
        links = stage_table(_small_star(_large_star(links)), name)
        after = _print(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _print(links: DataFrame) -> tuple:
    """The number of edges and two sums of hashes of them, which tell sets apart."""
    hashed = [F.xxhash64("a", "b", F.lit(seed)) for seed in (1, 2)]
    found = links.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(h).alias(f"h{k}") for k, h in enumerate(hashed)])
    return tuple(found.first())


def _cleaned(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger end first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    larger = both.where("b > a").join(least, "a")
    return _cleaned(larger.select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    smaller = links.join(least, "a")
    return _cleaned(smaller.select("b", "least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))))
