"""What a task gets does not grow with the tables."""

from tempora.plans import catalog
from tempora.registry import QUERIES


def test_shuffles_begin_with_partitions_by_the_size_of_the_tables(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "SHARE", 20_000, raising=False)
    catalog.by_own_rule(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        monkeypatch.setattr(catalog, "ADVICE", "1", raising=False)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1")
        for name in ("L6_event_references", "L5_authority_order", "L9_registry_laws", "L4_partition_structure"):
            df = QUERIES[name](spark, sf_dir)
            df.collect()
            assert df.rdd.getNumPartitions() > 12, name
        catalog.by_own_rule(spark)
        assert spark.conf.get(catalog.FIRST, None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
