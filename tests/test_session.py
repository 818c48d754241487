"""Shuffle files of written results, and the setting that frees them."""

import time

import pytest
from pyspark.sql import functions as F

from ricefield.session import SHUFFLE_CLEANUP, shuffles_freed, stored


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}


def test_a_stored_result_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    groups = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    out = stored(groups.repartition(3), "groups")
    for _ in range(50):  # removed by a thread of the cluster's
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert out.count() == 100 and out.agg(F.sum("count")).first()[0] == 10_000


def test_the_setting_comes_back_also_after_an_error(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    with pytest.raises(ZeroDivisionError):
        with shuffles_freed(spark):
            assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
            1 / 0
    assert spark.conf.get(SHUFFLE_CLEANUP) == before


def test_a_frame_can_be_used_again_after_its_shuffles_are_gone(spark):
    groups = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    with shuffles_freed(spark):
        assert [groups.count(), len(groups.collect()), len(groups.collect())] == [10, 10, 10]
