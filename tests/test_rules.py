"""Rules of peaks against literal loops, running sums over ranges, and joins by block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import scalar
from peakforge.operators import annotation, encode, joins, score, stats, vector_index
from peakforge.plans.config import ISOTOPE, IndexSpec


def followers(mz, intensity):
    """The isotope rule, peak by peak."""
    flagged = [False] * len(mz)
    for i, m in enumerate(mz):
        if flagged[i]:
            continue
        for z in range(1, 8):
            for k in (1, 2, 3):
                target, width = m + k * ISOTOPE / z, m * 20e-6
                near = [j for j, x in enumerate(mz) if target - width < x <= target + width]
                if not near:
                    break
                top = max(near, key=lambda j: (intensity[j], -j))
                if intensity[top] < intensity[i]:
                    flagged[top] = True
    return flagged


def test_isotopes():
    found = encode.isotope_followers(np.array([1000.0, 1001.003, 1001.015]), np.array([100.0, 5.0, 50.0]))
    assert found.tolist() == [False, False, True]  # the most intense within the tolerance follows, not the nearest
    for seed in range(60):
        r = random.Random(seed)
        mz = sorted(500 + r.randrange(12) * ISOTOPE / r.choice((1, 2, 3)) + r.uniform(-0.015, 0.015) for _ in range(25))
        intensity = [float(r.randrange(1, 9)) for _ in mz]
        assert encode.isotope_followers(np.array(mz), np.array(intensity)).tolist() == followers(mz, intensity)


def test_of_equal_peaks_the_first_is_the_maximum():
    assert encode.local_maximum(np.array([1.0, 1.5, 9.0]), np.array([5.0, 5.0, 5.0]), 1.0).tolist() == [True, False, True]


def test_low_intensity_cut(spark):
    def cut(peaks, precursor=500.0):
        df = spark.createDataFrame([(peaks, precursor)], "peaks array<struct<mz:double,intensity:double>>, p double")
        return df.select(encode.low_intensity_cut(F.col("peaks"), F.col("p"))).first()[0]

    assert cut([(300.0, 100.0)]) == 0.0 and cut([]) == 0.0 and cut([(300.0, 100.0), (400.0, 50.0)]) == 1.0
    # twice the m/z is 1000 here: 1002.5 lies in its window, though it does not in that about 998.99
    assert cut([(300.0, 100.0), (1002.5, 90.0), (400.0, 10.0)]) == pytest.approx(0.2)


def test_ions_of_strange_letters(spark):
    df = spark.createDataFrame([(1, "AXB", 1), (2, "A*G", 1), (3, "GA", 1)], "spec_id int, peptide string, charge int")
    by = {}
    for r in scalar.theoretical_ions(df).collect():
        by.setdefault(r.spec_id, []).append(r.mz)
    assert None not in by[1] and len(by[1]) == 4 and set(by[2]) == {None} and len(by[3]) == 2


def test_query_vector_ends_before_the_last_bins(spark):
    q = spark.createDataFrame([(1, 65530, 50), (1, 3, 49)], "query_id int, bin int, w int")
    bins = {r.bin for r in score.expanded(q, 15).collect()}
    assert max(bins) == 65536 - 15 and min(bins) == 1


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    r = random.Random(2)
    values = sorted({round(r.gauss(0, 1) ** 3, 6) for _ in range(3000)} | {0.0, 1e9})
    rows = [(v, r.randrange(5)) for v in values]
    got = {x.v: (x.s, x.s_total) for x in stats.running(spark.createDataFrame(rows, "v double, c long"), "v", {"s": "c"}, descending, 16).collect()}
    upto, total = 0, sum(c for _, c in rows)
    for v, c in sorted(rows, reverse=descending):
        upto += c
        assert got[v] == (upto, total)
    none = spark.createDataFrame([], "v double, c long")
    assert stats.running(none, "v", {"s": "c"}).count() == 0
    assert tuple(stats.bh_threshold(spark.createDataFrame([], "p double")).first()) == (0.0, 0, 0)


def test_files_of_ids(spark):
    files = spark.createDataFrame([(0, "a", 0, 5), (1, "b", 5, 5), (2, "c", 5, 100_000), (3, "d", 100_000, 100_001)], annotation.SPEC_FILES)
    ids = spark.createDataFrame([(i,) for i in (0, 4, 5, 70_000, 99_999, 100_000, 100_001)], "id bigint")
    assert {r.id: r.file_id for r in annotation.file_of(ids, files).collect()} == {0: 0, 4: 0, 5: 2, 70_000: 2, 99_999: 2, 100_000: 3}


def test_both_ways_of_meeting_agree(spark):
    r = random.Random(1)
    q = spark.createDataFrame([(k, r.randrange(40), r.randrange(1, 50)) for k in range(5) for _ in range(9)], "query_id int, key int, v int")
    a = spark.createDataFrame([(k, r.randrange(40), r.randrange(1, 50)) for k in range(30) for _ in range(9)], "idx int, key int, w int")
    sums = [sorted(map(tuple, joins.meet(q, a, "key", "idx", n).groupBy("query_id", "idx").agg(F.sum(F.col("v") * F.col("w"))).collect())) for n in (10, 1000)]
    assert sums[0] == sums[1]
    plan = joins.meet(q, a, "key", "idx").groupBy("query_id", "idx").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_distributed_training_is_that_of_one_machine(spark):
    """Centroids from sums over partitions part vectors as well as those of one machine do."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16)) * 10
    x = np.concatenate([c + rng.normal(size=(60, 16)) for c in centres]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx bigint, v array<float>")
    found = vector_index.train_distributed(rows, 16, IndexSpec(6, 4, 3), seed=3, tasks=3)
    assert found.centroids.shape == (6, 16) and [c.shape for c in found.codebooks] == [(8, 4)] * 4

    def error(index):
        at, codes = index.encode(x.astype(np.float64))
        return ((index.reconstruct(at, codes) - x) ** 2).sum()

    assert error(found) <= 2.5 * error(vector_index.train(x.astype(np.float64), IndexSpec(6, 4, 3), seed=3))


def test_large_samples_stay_distributed(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE_BYTES", 1)
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "idx bigint, v array<double>")
    indexes = vector_index.train_all(v, [(IndexSpec(4, 2, 3), 1), (IndexSpec(4, 2, 3), 2)], 200)
    assert [i.number for i in indexes] == [0, 1] and indexes[0].order.tolist() != indexes[1].order.tolist()
    q = v.where("idx < 10").select(F.col("idx").alias("query_id"), F.col("v").alias("q"))
    found = vector_index.search_all(q, v, indexes, 20, 4).collect()
    assert {(r.query_id, r.idx) for r in found} >= {(k, k) for k in range(10)}
