"""Shuffle files of saved tables."""

from pyspark.sql import functions as F

from vellum.llm.common import saved
from vellum.session import SHUFFLE_CLEANUP, freeing_shuffles


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_a_saved_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-freed", shuffled=True)
    assert shuffle_files(spark) <= before
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6


def test_the_sessions_own_setting_holds_afterwards(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with freeing_shuffles(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
