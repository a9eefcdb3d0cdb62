"""Which side a join broadcasts."""

from tempora.plans.catalog import ESTIMATED, MEASURED, by_own_rule
from tempora.registry import QUERIES


def test_exploded_rows_are_not_gathered_by_the_size_of_their_files(spark, sf_dir):
    by_own_rule(spark)
    before = spark.conf.get(ESTIMATED)
    spark.conf.set(ESTIMATED, "10m")
    spark.conf.set(MEASURED, "1k")  # the rings take more than that, their files less than 10 MB
    try:
        df = QUERIES["F3_ring_morph"](spark, sf_dir)
        assert df.count() > 0
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        by_own_rule(spark)
        assert (spark.conf.get(ESTIMATED), spark.conf.get(MEASURED)) == ("10m", "1k")
    finally:
        spark.conf.set(ESTIMATED, before)
        spark.conf.unset(MEASURED)
