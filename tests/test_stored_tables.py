"""What is stored on the way leaves nothing behind but itself."""

from pathlib import Path

from pyspark.sql import functions as F

from pathweave.session import staged_table, stored_table


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = blocks.mkString(" ").split()
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_go_with_the_job_that_stores(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = shuffle_files(spark), spark.conf.get(key, None)
    counts = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count()
    assert stored_table(counts, "counts").count() == 7
    left = {n for n in shuffle_files(spark) - before}
    again = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count().collect()
    assert len(again) == 7 and spark.conf.get(key, None) == held
    # counting the stored rows itself shuffles four numbers at most
    assert len(left) <= 2 * 4


def test_staged_rows_last_for_a_block(spark):
    with staged_table(spark.range(10), "staged") as rows:
        files = [f.removeprefix("file:") for f in rows.inputFiles()]
        assert rows.count() == 10 and all(Path(f).exists() for f in files)
    assert files and not any(Path(f).exists() for f in files)
