import time

from pyspark.sql import functions as F

from tidemark.plans.workspace import SHUFFLE_CLEANUP, settle


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def test_what_is_settled_leaves_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    settled = settle(rows.join(rows.withColumnRenamed("s", "t"), "k").repartition(3))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # Spark removes them beside what follows
        time.sleep(0.2)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP) == kept
    assert {r.k: r.s for r in settled.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert rows.count() == settled.count() == 7
