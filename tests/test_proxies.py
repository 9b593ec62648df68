import math
import time

from peakforge import proxies

ODD = (0.29, 1.005, 19.99, 0.0, 1e10, 1e10 + 0.01, 1e300, -3.25, math.nan, math.inf, 1 / 3, 4503599627370497.5, None)


def tables(spark, path, lines, orders):
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_lines_come_as_they_are(spark, tmp_path):
    lines = [(k % 3, n, p, x) for k, x in enumerate(ODD) for n in (0, 7, 255, 256, -1, None) for p in (0, 1999, 123456789, -5, None)]
    d = tables(spark, tmp_path, [*lines, (9, 1, 1, 1.0), (None, 1, 1, 1.0)], [(0, 10), (1, 11), (2, None)])
    want = [({0: 10, 1: 11, 2: None}[o], None if p is None else 1 + int(math.fmod(p, 2000)), x, o, n) for o, n, p, x in lines]
    assert sorted(map(repr, map(tuple, proxies.raw_peaks(spark, d).collect()))) == sorted(map(repr, want))


def exchanged(spark):
    """MB that exchanges have written so far."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    time.sleep(0.5)
    bus.waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite() / 1e6


def test_exchanges_of_lines_are_small(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = exchanged(spark)
        n = proxies.peaks(spark, "/root/testdata/sf0.1").count()
        assert n > 500_000
        assert exchanged(spark) - before < 20  # 600000 lines twice, orders once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
