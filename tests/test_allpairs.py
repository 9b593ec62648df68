import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakforge import proxies, queries, queries_more  # noqa: F401  it adds to the same tables
from peakforge.operators import allpairs, encode, metrics, score, stats


def spectra(seed, n=40, bins=120, most=50):
    """Spectra with near peaks, and each of them twice more under ids that lie apart."""
    rng = random.Random(seed)
    own = [[(rng.randint(0, bins), 50 - i) for i in range(rng.randint(1, most))] for _ in range(n)]
    return {i + k * n: own[i] for i in range(n) for k in range(3)}


def frames(spark, own):
    df = spark.createDataFrame([(i, b, w) for i, s in own.items() for b, w in s], "id bigint, bin int, w int")
    return df.where("id % 5 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "idx")


def norms(q, c):
    n = [x.groupBy(k).agg(F.count("w").alias("n_peaks"), F.sum(F.col("w") * F.col("w")).alias(m)) for x, k, m in ((q, "query_id", "qnorm2"), (c, "idx", "cnorm2"))]
    return n[0].drop("n_peaks"), n[1]


@pytest.mark.parametrize("tolerance,held", [(0, 1 << 26), (1, 1 << 26), (2, 2000), (15, 1 << 26)])
def test_nearest_is_the_best_of_all_pairs(spark, monkeypatch, tolerance, held):
    monkeypatch.setattr(allpairs, "QUERY_BYTES", held)  # several blocks
    q, c = frames(spark, spectra(tolerance))
    qn, cn = norms(q, c)
    pairs = score.with_cosine(score.exact_dp(q, c, tolerance), qn, cn).cache()
    rows = lambda df, *more: sorted(map(tuple, df.select("query_id", "idx", "rank", "dp", *more).collect()))
    assert rows(allpairs.nearest(q, c, tolerance, 7, 6), "dist", "n_peaks") == rows(score.top_n(pairs.where("n_peaks > 6"), 7), "dist", "n_peaks")
    assert rows(allpairs.nearest(q, c, tolerance, 7, min_score=4292)) == rows(score.true_neighbors(pairs, 0.1, 7))


@pytest.mark.parametrize("tolerance", [0, 1, 15])
def test_background_counts_are_those_of_all_pairs(spark, tolerance):
    q, c = frames(spark, spectra(tolerance))
    qn, cn = norms(q, c)
    want = Counter((r.query_id, r.score) for r in score.with_background_score(score.background_dp(q, c, tolerance), qn, cn).collect())
    counts, alike = allpairs.background_counts(q, c, tolerance)
    assert counts.select("query_id").distinct().count() == 8  # 24 queries are 8 spectra, which meet once
    assert {(r.same, r.score): r.n for r in counts.join(alike, "query_id").collect()} == want


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("tolerance", [0, 1, 15])
def test_listed_pairs_score_as_among_all_pairs(spark, tolerance, once):
    q, c = frames(spark, spectra(tolerance))
    pairs = q.select("query_id").distinct().crossJoin(c.select("idx").distinct()).where("query_id % 7 = idx % 7")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "idx", "dp").collect()))
    want = (score.exact_dp if once else score.background_dp)(q, c, tolerance).join(pairs, ["query_id", "idx"], "left_semi")
    assert rows(allpairs.listed_dp(pairs, q, c, tolerance, once)) == rows(want)


@pytest.mark.parametrize("held", [1 << 26, 2000])
@pytest.mark.parametrize("tolerance", [0, 1, 15])
def test_all_pairs_as_by_a_join(spark, monkeypatch, tolerance, held):
    monkeypatch.setattr(allpairs, "QUERY_BYTES", held)  # several blocks
    q, c = frames(spark, spectra(tolerance))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "idx", "dp").collect()))
    assert rows(allpairs.all_dp(q, c, tolerance)) == rows(score.exact_dp(q, c, tolerance))
    assert rows(allpairs.all_dp(q, c, tolerance, once=False)) == rows(score.background_dp(q, c, tolerance))


def test_lists_of_ids_are_cut(monkeypatch):
    monkeypatch.setattr(allpairs, "HELD", 3)
    n, ids = np.array([1, 5, 2]), np.array([7, 10, 11, 12, 13, 14, 20, 21])  # one class is more than a batch may hold
    out = list(allpairs._listed(np.array([0, 2, 1, 1, 0]), n, ids, place=np.arange(5)))
    assert len(out) > 1
    assert [x for b in out for x in b.column("ids").to_pylist()] == [[7], [20, 21], [10, 11, 12, 13, 14], [10, 11, 12, 13, 14], [7]]
    assert [x for b in out for x in b.column("place").to_pylist()] == [0, 1, 2, 3, 4]


def test_empty_query_set(spark):
    q, c = frames(spark, spectra(1))
    assert allpairs.nearest(q.where("false"), c, 1, 3).count() == 0
    assert allpairs.background_counts(q.where("false"), c, 1)[0].count() == 0
    assert allpairs.all_dp(q.where("false"), c, 1).count() == allpairs.all_dp(q, c.where("false"), 1).count() == 0
    assert allpairs.listed_dp(c.select("idx", F.col("idx").alias("query_id")), q.where("false"), c, 1).count() == 0


#: Queries of which no hit of peaks may be dealt out: what they write for exchanges stays near what the peaks take.
SEARCHES = ["topn_neighbors", "graph_links", "node_groups", "rank_histogram", "nearest_other", "p_value_spread", "rank_recall", "neighbor_lists", "archive_search", "true_nn_recall", "tophit_pvalue", "convolution", "unmatched_peaks", "pairwise_edges", "delta_mass", "exact_dp_pairs", "score_histogram"]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_deal_out_no_hits(spark, sf, monkeypatch, name):
    def hits(*_):
        raise AssertionError("hits are rows")

    stored = []
    monkeypatch.setattr(score, "hits", hits)
    monkeypatch.setattr(proxies, "peaks", lambda *a, f=proxies.peaks: stored.append(1) or f(*a))
    queries.QUERIES[name](spark, sf)
    assert len(stored) == 1  # peaks are written once


def brute(a, b, name):
    """The similarity of two vectors, slot by slot."""
    both = sorted(a.keys() & b.keys())
    if name == "cosine":
        return sum(a[s] * b[s] for s in both) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    if name == "pearson":
        return (np.corrcoef([a.get(s, 0) for s in range(30)], [b.get(s, 0) for s in range(30)])[0, 1] + 1) / 2
    if name == "jaccard":
        return len(both) / len(a.keys() | b.keys())
    if name == "p_norm":
        norm = lambda x: sum(abs(v) ** 2 for v in x) ** 0.5
        return 1 - norm(a.get(s, 0) - b.get(s, 0) for s in a.keys() | b.keys()) / (norm(a.values()) + norm(b.values()))

    def mean(x):
        x = [abs(v) for v in x]
        return 0 if min(x) == 0 else float(np.exp(np.mean(np.log(x)))) if name == "geometric" else 1 / float(np.mean(1 / np.array(x)))

    both_means = mean(a[s] for s in both) + mean(b[s] for s in both)
    return 1 - (mean(a[s] - b[s] for s in both) / both_means if both_means else 0)


METRICS = {"cosine": metrics.cosine, "pearson": lambda *v, **kw: metrics.pearson(*v, 30, **kw), "jaccard": metrics.jaccard, "p_norm": metrics.p_norm, "geometric": lambda *v, **kw: metrics.p_norm(*v, p=0, **kw), "harmonic": lambda *v, **kw: metrics.p_norm(*v, p=-1, **kw)}


@pytest.mark.parametrize("held", [1 << 26, 300])
@pytest.mark.parametrize("name", METRICS)
def test_similarities_are_those_of_each_pair(spark, monkeypatch, name, held):
    monkeypatch.setattr(allpairs, "QUERY_BYTES", held)  # several blocks
    rng = random.Random(name)
    own = {i: {s: rng.choice([-2.5, -1.0, 0.5, 1.0, 3.0]) for s in rng.sample(range(30), rng.randint(2, 9))} for i in range(12)}
    df = spark.createDataFrame([(i, s, x) for i, v in own.items() for s, x in v.items()], "spec_id bigint, slot int, x double")
    left = df.where("spec_id % 3 = 0")
    want = {(i, j): brute(own[i], own[j], name) for i in own if i % 3 == 0 for j in own if own[i].keys() & own[j].keys()}
    assert {(r.a, r.b): r.similarity for r in METRICS[name](left, df).collect()} == pytest.approx(want)
    # vectors that stand for several: each pair of ids comes, and no other
    alike = df.select("spec_id").distinct().selectExpr("spec_id", "array(spec_id, spec_id + 100) ids")
    found = METRICS[name](left, df, members=(alike, alike), digits=6).collect()
    assert len(found) == 4 * len(want)
    assert {(r.a, r.b): r.similarity for r in found} == pytest.approx({(i + k, j + m): x for (i, j), x in want.items() for k in (0, 100) for m in (0, 100)}, abs=1e-6)
    assert METRICS[name](left.where("false"), df).count() == METRICS[name](left, df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["cosine_bins", "pearson_bins", "pnorm_bins", "jaccard_bins", "pnorm_geometric"])
def test_similarities_deal_out_no_hits(spark, sf, monkeypatch, name):
    def hits(*_):
        raise AssertionError("hits are rows")

    monkeypatch.setattr(metrics, "meet", hits)
    queries.QUERIES[name](spark, sf)


def test_scan_deviation_joins_scans_not_peaks(spark):
    peaks = {0: [1.0, 4.0, 9.5, 30.0], 1: [2.0, 7.0, 35.5], 2: [], 3: [7.0]}
    df = spark.createDataFrame([(s, m) for s, x in peaks.items() for m in x], "scan_no bigint, mz double")
    found = metrics.scan_deviation(df, 5.0)
    diffs = [1.0, -2.0, -2.5]  # 1 to 2, 4 to 2, 9.5 to 7; 30 has none
    assert found.first().n == 3 and abs(found.first()["mean"] - sum(diffs) / 3) < 1e-12
    assert "explode" not in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["candidate_scores", "candidate_scores_unmasked"])
def test_given_pairs_are_not_scored_row_by_row(spark, sf, monkeypatch, name):
    def row_by_row(*_):
        raise AssertionError("a pair is a row of two arrays")

    monkeypatch.setattr(score, "pair_dp", row_by_row)
    queries.QUERIES[name](spark, sf)


def apart(seed, n, peaks=30, bins=200):
    """Lists of n spectra whose peaks are apart and whose weights differ, as bin * 2^32 + w."""
    rng = np.random.default_rng(seed)
    return [np.sort((3 * rng.choice(bins, peaks, replace=False) + rng.integers(1, 3)) << 32 | rng.permutation(50)[:peaks] + 1) for _ in range(n)]


def test_long_lists_add_up_without_a_row_a_hit(monkeypatch):
    block = allpairs.Block.of(vars(allpairs.Block([np.array([i]) for i in range(9000)], apart(1, 9000), 1)))
    p = np.concatenate(apart(2, 50))
    parts = 50, np.repeat(np.arange(50), 30), p >> 32, p & 0xFFFFFFFF
    tracemalloc.start()
    try:
        dp = block.dp(*parts, True)
        assert tracemalloc.get_traced_memory()[1] < 2 * dp.nbytes  # 22 times the result when each of 2 million hits was a row
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(allpairs, "LONG", 1 << 30)
    assert (block.dp(*parts, True) == dp).all() and (block.dp(*parts, False) == dp).all()


@pytest.mark.parametrize("min_score", [None, 0, 4292])
def test_no_pair_within_the_limit_is_out_of_reach(min_score):
    cosine = np.concatenate([np.random.default_rng(3).random(100000), 1 - np.logspace(-17, -5, 2000), np.arange(0, 42926) / 42925])
    key = allpairs._distance(cosine) if min_score is None else -np.minimum(np.floor(42925 * cosine), 42925)
    some = key < -(min_score or 0) if min_score is not None else cosine > 0
    assert (cosine >= allpairs.reach(key, min_score))[some].all()  # with a limit that the pair just meets
    assert (cosine >= allpairs.reach(np.full(len(key), np.inf), min_score))[some].all()
    assert (allpairs.reach(np.array([np.inf, 0.0, -1.0]), min_score) > 0).all()


@pytest.mark.parametrize("once,held,rows", [(True, 1 << 26, 1 << 20), (False, 1 << 26, 5), (True, 20000, 5)])
def test_pairs_of_a_group_score_as_among_all_pairs(spark, monkeypatch, once, held, rows):
    monkeypatch.setattr(allpairs, "QUERY_BYTES", held)  # several blocks
    monkeypatch.setattr(allpairs, "HELD", rows)
    q, c = (x.withColumn("k", F.when(F.col(i) % 11 > 0, F.col(i) % 7)) for x, i in zip(frames(spark, spectra(5)), ("query_id", "idx")))  # some are in no group
    both = lambda df: sorted(map(tuple, df.select("query_id", "idx", "dp").collect()))
    want = (score.exact_dp if once else score.background_dp)(q, c, 1).where("query_id % 7 = idx % 7 and query_id % 11 > 0 and idx % 11 > 0")
    assert both(allpairs.grouped_dp(q, c, 1, once)) == both(want)
    assert allpairs.grouped_dp(q.where("false"), c, 1, once).count() == 0


def test_rows_of_pairs_of_classes_are_cut(monkeypatch):
    monkeypatch.setattr(allpairs, "HELD", 4)
    n_ids, ids, n_own, own = np.array([2, 6]), np.array([1, 2, 11, 12, 13, 14, 15, 16]), np.array([1, 3]), np.array([100, 200, 201, 202])
    out = list(allpairs._rows(np.array([0, 0, 1]), n_ids, ids, np.array([0, 1, 1]), n_own, own, np.array([7, 8, 9])))
    assert max(b.num_rows for b in out) <= 6 and len(out) > 3
    got = sorted((r["query_id"], r["idx"], r["dp"]) for b in out for r in b.to_pylist())
    assert got == sorted([(100, i, 7) for i in (1, 2)] + [(x, i, 8) for x in (200, 201, 202) for i in (1, 2)] + [(x, i, 9) for x in (200, 201, 202) for i in range(11, 17)])


def test_no_pair_is_listed_for_candidate_scores(spark, sf):
    plan = queries.QUERIES["candidate_scores"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("tolerance,held", [(0, 1 << 26), (1, 1 << 26), (15, 2000)])
def test_counts_of_a_query_are_made_in_one_task(spark, monkeypatch, tolerance, held):
    monkeypatch.setattr(allpairs, "QUERY_BYTES", held)  # several blocks
    monkeypatch.setattr(allpairs, "COUNT_BYTES", 3 * 4 * 42926)  # three queries a task
    q, c = frames(spark, spectra(tolerance))
    qn, cn = norms(q, c)
    want = Counter((r.query_id, r.score) for r in score.with_background_score(score.background_dp(q, c, tolerance), qn, cn).collect())
    told = lambda s, n: (s, n)
    counts, _ = allpairs.background_rows(q, c, tolerance, told, "score bigint, n bigint", each=True)
    assert {(r.query_id, r.score): r.n for r in counts.collect()} == want
    assert counts.rdd.getNumPartitions() >= 4  # groups are tasks of their own
    assert "Exchange" not in allpairs.background_counts(q, c, tolerance)[0]._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_counts_of_its_queries_only(monkeypatch):
    monkeypatch.setattr(allpairs, "LISTED", 1000)  # a task would else list as many spectra
    block = allpairs.Block([np.array([i]) for i in range(60)], apart(1, 60), 1)
    p = apart(2, 4000)
    batches = [pa.RecordBatch.from_pydict({"ids": [[i] for i in range(a, a + 500)], "p": [x.tolist() for x in p[a : a + 500]]}) for a in range(0, 4000, 500)]
    part = allpairs.Block.of(vars(block.part(20, 30)))
    tracemalloc.start()
    try:
        counts = allpairs._score_counts(part, batches)
        assert tracemalloc.get_traced_memory()[1] < counts.nbytes + (8 << 20)
    finally:
        tracemalloc.stop()
    assert counts.shape == (10, 42926)
    assert (counts == allpairs._score_counts(allpairs.Block.of(vars(block)), batches)[20:30]).all()
    dp = allpairs.Block.of(vars(block)).dp(4000, np.repeat(np.arange(4000), 30), np.concatenate(p) >> 32, np.concatenate(p) & 0xFFFFFFFF, False)
    assert counts.sum(axis=1).tolist() == (dp > 0).sum(axis=0)[20:30].tolist()


def test_histograms_and_tails_of_counts(spark):
    rng = np.random.default_rng(4)
    own = {i: np.sort(rng.choice(42926, n, replace=False)) for i, n in enumerate((1, 2, 300, 5000, 20000))} | {9: np.arange(0, 3)}
    many = {i: rng.integers(1, 40, len(s)) for i, s in own.items()}
    df = spark.createDataFrame([(i, int(x), int(y)) for i in own for x, y in zip(own[i], many[i])], "query_id bigint, score int, n bigint")
    hist = stats.histogram(df, count="n")
    rows = lambda x, *names: sorted(tuple(r) for r in x.select("query_id", *names).collect())
    assert rows(hist, "k", "n", "boundary") == sorted((i, *r) for i in own for r in zip(*(c.tolist() for c in stats.counted_histogram(own[i], many[i]))))
    tail = stats.tail_points(stats.survival(hist))
    assert rows(tail, "x", "total") == sorted((i, x, t) for i in own for x, _, t in zip(*(c.tolist() for c in stats.counted_tail(own[i], many[i]))))
    ys = sorted((i, x, float(np.log10(s))) for i in own for x, s, _ in zip(*(c.tolist() for c in stats.counted_tail(own[i], many[i]))))
    assert np.allclose(np.array(rows(tail, "x", "y")), np.array(ys), rtol=0, atol=1e-12)
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in (*stats.counted_histogram(none, none), *stats.counted_tail(none, none))] == [0] * 6


def test_scored_pairs_as_by_a_join(spark):
    q, c = frames(spark, spectra(7))
    qn, cn = norms(q, c)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "idx", "dp", "score").collect()))
    assert rows(allpairs.all_dp(q, c, 1, once=False, scored=True)) == rows(score.with_background_score(score.background_dp(q, c, 1), qn, cn))
    assert allpairs.all_dp(q.where("false"), c, 1, once=False, scored=True).columns == ["query_id", "idx", "dp", "score"]


@pytest.mark.parametrize("name", ["background_scores", "survival_tail", "tail_regression"])
def test_background_scores_deal_out_no_hits(spark, sf, monkeypatch, name):
    def hits(*_):
        raise AssertionError("hits are rows")

    monkeypatch.setattr(score, "hits", hits)
    queries.QUERIES[name](spark, sf)


def test_vectors_of_classes_are_binned_peaks(spark):
    _, c = frames(spark, spectra(8, bins=60))
    c = c.withColumn("bin", F.when(F.col("bin") > 55, F.col("bin") + 10).otherwise(F.col("bin")))  # some beyond the last slot
    found = {i: dict(zip(r.s, r.x)) for r in allpairs.class_vectors(allpairs.classes(c, "idx"), 60).collect() for i in r.ids}
    want = {}
    for r in encode.binned(c, F.col("bin"), F.col("w"), "idx", 60).collect():
        want.setdefault(r.idx, {})[r.slot] = r.x
    assert found == want and max(s for v in found.values() for s in v) == 59
    assert all(r.s == sorted(r.s) for r in allpairs.class_vectors(allpairs.classes(c, "idx"), 60).collect())


@pytest.mark.parametrize("name", ["cosine_bins", "pearson_bins", "pnorm_bins", "jaccard_bins", "pnorm_geometric", "pnorm_harmonic", "exact_dp_pairs", "background_scores"])
def test_pairs_deal_out_classes_only(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == 2  # of peaks by id and of lists by p: neither slots nor what is made of the lists
    assert "SortMergeJoin" not in plan
