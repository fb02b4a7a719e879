"""Sizes of shuffle partitions."""

from leasebook import session


def test_partitions_stay_small_as_the_input_grows(spark):
    wanted = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {k: spark.conf.get(k, None) for k in (session.ADVISORY, wanted)}
    try:
        assert session.size_shuffles(spark, 6 << 30) == 1536 and spark.conf.get(wanted) == "1536"
        spark.conf.set(session.ADVISORY, "64MB")
        session.tune_session(spark)
        assert session.size_bytes(spark.conf.get(session.ADVISORY)) == 16 << 20
        spark.conf.set(session.ADVISORY, "8m")
        session.tune_session(spark)
        assert spark.conf.get(session.ADVISORY) == "8m"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_sizes_are_read_as_settings_give_them():
    assert [session.size_bytes(t) for t in ("1048576", "1048576b", "64MB", "16m", "2g", "4k")] == [1 << 20, 1 << 20, 64 << 20, 16 << 20, 2 << 30, 4 << 10]
