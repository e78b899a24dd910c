from pyspark.sql import functions as F

from gridloom.llm.common import CLEANUP, written


def shuffle_files(spark):
    """How many shuffles Spark still holds outputs of."""
    return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, given = shuffle_files(spark), spark.conf.get(CLEANUP)
    made = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "sums")
    assert made.agg(F.sum("n")).first()[0] == 1000
    again = shuffle_files(spark)
    written(spark.range(1000).repartition(3, "id"), "dealt")
    assert shuffle_files(spark) == again <= before + 1
    assert spark.conf.get(CLEANUP) == given
