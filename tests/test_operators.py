import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import scalar
from peakforge.operators import annotation, encode, graph, metrics, score, stats, timeseries, vector_index
from peakforge.plans import config


def greedy(query, candidate, tolerance):
    """The matcher peak by peak: rows of (bin, w)."""
    vec = {}
    for b, w in sorted(query, key=lambda x: -x[1]):
        for k in range(b - tolerance, b + tolerance + 1):
            if k > 0:
                vec.setdefault(k, w)
    used, total = set(), 0
    for b, w in sorted(candidate, key=lambda x: -x[1]):
        v = vec.get(b) if b > 0 else None
        if v is not None and v not in used:
            used.add(v)
            total += v * w
    return total


@pytest.mark.parametrize("tolerance", [0, 1, 2, 15])
def test_two_maxima_equal_the_greedy_matcher(spark, tolerance):
    rng = random.Random(tolerance)
    spectra = [[(rng.randint(0, 120), 50 - i) for i in range(rng.randint(1, 50))] for _ in range(24)]
    df = spark.createDataFrame([(i, b, w) for i, s in enumerate(spectra) for b, w in s], "id bigint, bin int, w int")
    got = {(r.query_id, r.idx): r.dp for r in score.exact_dp(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "idx"), tolerance).collect()}
    for i, a in enumerate(spectra):
        for j, b in enumerate(spectra):
            assert got.get((i, j), 0) == greedy(a, b, tolerance)


def test_preprocessing_keeps_what_the_rules_allow(spark):
    df = spark.createDataFrame([(0, 500.0, [(100.0, 200.0), (161.0, 200.0)])], f"spec_id bigint, precursor_mz double, peaks {encode.PEAKS}")
    assert [p.mz for p in encode.preprocess(df).first().peaks] == [161.0]


def test_window_and_isotopes():
    mz = np.array([200.0, 201.0032, 202.0064, 300.0])
    assert encode.isotope_followers(mz, np.array([10.0, 5.0, 2.0, 1.0])).tolist() == [False, True, True, False]
    assert encode.weak_in_window(np.arange(8.0), np.array([8.0, 7, 6, 5, 4, 3, 2, 1])).tolist() == [False] * 6 + [True] * 2
    assert encode.local_maximum(np.array([1.0, 1.5, 9.0]), np.array([1.0, 2.0, 1.0]), 1.0).tolist() == [False, True, True]


def test_compact_form(spark):
    peaks = [(float(m), float(i)) for m, i in ((100, 1), (200, 9), (300, 5), (400, 4), (500, 3), (600, 2), (2500, 7))]
    df = spark.createDataFrame([(0, peaks), (1, peaks[:6])], f"spec_id bigint, peaks {encode.PEAKS}")
    bins = {r.spec_id: r.bins for r in df.select("spec_id", encode.compact(F.col("peaks")).alias("bins")).collect()}
    assert bins[0][0] == int(200 / 2000 * 65535) and bins[0][1] == 65535
    assert bins[1] == [16]
    long = encode.long_peaks(spark.createDataFrame([(0, [5, 7, 0, 9])], "spec_id bigint, bins array<int>"))
    assert [(r.bin, r.w) for r in long.orderBy("rank").collect()] == [(5, 50), (7, 49)]


def test_vector_filters(spark):
    v = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate((1, 4, 9, 16))], "spec_id bigint, slot int, x double")
    get = lambda chain: sorted(r.x for r in encode.vector_filter(v, chain).collect())
    assert get("PeakSquareRoot") == [1, 2, 3, 4]
    assert sum(get("PeakToProb")) == pytest.approx(1)
    assert get("AboveMean") == [1.5, 8.5]
    assert get("Top2") == [16.0]
    assert get("PeakSquareRoot+Top3") == [3, 4]


def test_similarities_of_equal_and_disjoint(spark):
    v = spark.createDataFrame([(0, 1, 3.0), (0, 2, 4.0), (1, 1, 3.0), (1, 2, 4.0), (2, 2, 1.0)], "spec_id bigint, slot int, x double")
    for f in (metrics.cosine, metrics.jaccard, metrics.jensen_shannon, metrics.p_norm, lambda a, b: metrics.pearson(a, b, 10)):
        got = {(r.a, r.b): r.similarity for r in f(v, v).collect()}
        assert got[0, 1] == pytest.approx(1) and got[0, 2] < 1


def test_benjamini_hochberg_is_monotone(spark):
    p = [0.0001, 0.0002, 0.01, 0.02, 0.5, 0.9]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert stats.bh_threshold(df, 0.01).first().threshold == 0.0002
    assert stats.bh_threshold(df, 0.05).first().threshold >= stats.bh_threshold(df, 0.01).first().threshold
    assert stats.bh_threshold(df.where("p > 0.4")).first().threshold == 0


def test_tail_fit_and_p_value(spark):
    pts = spark.createDataFrame([(0, 100.0 + i, -1 - 0.02 * i, 1000) for i in range(70)], "query_id bigint, x double, y double, total bigint")
    m = stats.tail_model(pts).first()
    assert m.k == pytest.approx(-0.02) and m.n >= 50
    few = stats.tail_model(pts.where("x < 130"))
    assert few.count() == 0
    row = spark.range(1).select(stats.p_value(F.lit(300.0), F.lit(m.k), F.lit(m.b), F.lit(1000)).alias("p"), stats.p_value(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(1)).alias("none")).first()
    assert row.p == pytest.approx(1 - (1 - 10 ** (m.k * 300 + m.b)) ** 1000, rel=1e-6) and row.none == 10000


def test_mixture():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.normal(6, 1, 1000)])
    m = stats.em_mixture(x)
    assert m["weight"] == pytest.approx(1 / 3, abs=0.03) and m["high"][0] == pytest.approx(6, abs=0.2)
    assert np.all(np.diff(m["fdr"]) < 1e-6)


def test_annotation_update_needs_one_file(spark):
    files = spark.createDataFrame([(0, "/a/x.mzML", 0, 2), (1, "/b/y.mzML", 2, 3), (2, "/c/y.mzML", 3, 4)], annotation.SPEC_FILES)
    gt = annotation.with_columns(spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 1)], "id bigint, file_id int, scan int"), annotation.GROUND_TRUTH)
    new = spark.createDataFrame([("x", 2, "PEP", 0.9), ("x", 2, "OLD", 0.1), ("y", 1, "NO", 1.0)], "filename string, scan int, peptide string, score double")
    got = {r.id: (r.peptide, r.score) for r in annotation.updated(gt, files, new).collect()}
    assert got == {0: (None, None), 1: ("PEP", 0.9), 2: (None, None)}
    assert annotation.files_to_remove(files, 2).first().n == 2
    assert sorted(r.id for r in annotation.without_last(gt, files, 2).collect()) == [0, 1]


def test_cached_neighbors_and_remarks(spark):
    tnn = spark.createDataFrame([(1, 10, 0.5, 100, [(5, 40000), (6, 30000)]), (1, 2, 0.5, 100, []), (2, 10, 0.9, 100, [])], "query_id bigint, topk int, mindp double, archivesize bigint, tnn array<struct<idx:bigint,score:int>>")
    got = annotation.cached_neighbors(annotation.with_columns(tnn, annotation.TNN), 100, 5, 0.8).collect()
    assert [(r.query_id, [x.idx for x in r.tnn]) for r in got] == [(1, [5])]
    remarks = annotation.add_remark(annotation.add_remark(spark.createDataFrame([], annotation.REMARKS), 3, "a; b"), 3, "c")
    assert sorted((r.id, r.remarks) for r in remarks.collect()) == [(0, "a; b"), (1, "c")]


def test_graph(spark):
    n = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.0)], "query_id bigint, idx bigint, dist double")
    gt = spark.createDataFrame([(1, "UNKNOWN"), (2, "PEP")], "id bigint, peptide string")
    nodes = graph.grouped(graph.nodes(n.select("query_id", F.col("query_id").alias("source"), F.col("idx").alias("target"))), gt)
    assert {r.id: r.group for r in nodes.collect()} == {1: 1, 2: 2}
    json = graph.as_json(nodes, graph.links(n)).first().json
    assert '"links":[{"source":1,"target":2,"dist":0.5}]' in json
    df = spark.createDataFrame([([(0.5, 7), (1.0, 8)],)], "n array<struct<dist:double,idx:bigint>>")
    text = df.select(graph.serialised(F.col("n")).alias("t")).first().t
    assert text == "0.5@7;1.0@8"
    assert [tuple(x) for x in df.select(graph.parsed(F.lit(text)).alias("n")).first().n] == [(0.5, 7), (1.0, 8)]


def test_scalar_functions(spark):
    row = (
        spark.createDataFrame([("n[43]PEM[147]K", "a/b/C.MZML")], "t string, path string")
        .select(
            scalar.parsed_peptide(F.col("t")).alias("p"), scalar.base_name(F.col("path")).alias("base"), scalar.extension(F.col("path")).alias("ext"), scalar.stem(F.col("path")).alias("stem"),
            scalar.mz_of_mass(scalar.neutral_mass(F.lit(500.0), F.lit(2)), F.lit(2)).alias("mz"), scalar.same_peptide(F.lit("PIL"), F.lit("PLI")).alias("same"),
            scalar.spectrum_name(F.lit("f"), F.lit(12), F.lit(2)).alias("name"),
        )
        .first()
    )
    assert (row.p.peptide, row.p.nterm, row.p.mods) == ("PEMK", 43.0, {3: 147.0})
    assert (row.base, row.ext, row.stem, row.same, row.name) == ("C.MZML", "mzml", "C", True, "f.00012.00012.2")
    assert row.mz == pytest.approx(500.0)
    mods = spark.createDataFrame([({4: 147.0354, 8: 160.0306}, {})], "m map<int,double>, e map<int,double>")
    got = mods.select(scalar.mods_text(F.col("m")).alias("t"), scalar.mods_text(F.col("e")).alias("e"), scalar.modified_peptide(F.lit("PEPM"), F.col("m")).alias("mp")).first()
    assert (got.t, got.e, got.mp) == ("147.0354@4|160.0306@8|", "UNMODIFIED", "PEPM[147]")
    assert mods.select(scalar.parsed_mods(F.lit(got.t)).alias("m")).first().m == {4: 147.0354, 8: 160.0306}


def test_ions(spark):
    ions = scalar.theoretical_ions(spark.createDataFrame([(0, "GA", 1)], "spec_id bigint, peptide string, charge int")).collect()
    got = {(r.kind, r.position): r.mz for r in ions}
    assert got[("b", 1)] == pytest.approx(57.02146 + 1.007276) and got[("y", 1)] == pytest.approx(71.03711 + 18.010565 + 1.007276)


def test_index_finds_all_with_all_lists(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "idx bigint, v array<double>")
    (index,) = vector_index.train_all(v, [(config.IndexSpec(8, 4), 3)])
    q = v.where("idx < 5").selectExpr("idx as query_id", "v as q")
    found = vector_index.search(q, vector_index.encoded(v, index), index, 300, 8)
    assert found.groupBy("query_id").count().where("count = 300").count() == 5
    for metric in ("l1", "linf", "canberra", "braycurtis"):
        assert vector_index.knn(q, v, 1, metric).where("query_id = idx").count() == 5
    at, codes = index.encode(x)
    assert np.abs(index.reconstruct(at, codes) - x).mean() < 0.5
    for init in ("first", "random", "unit", "projection"):
        assert vector_index.kmeans(x, 4, init).shape == (4, 8)


def test_config():
    assert config.parse_indexes("IVF256,PQ16;IVF64,PQ8x4", "customized:3;4") == [(config.IndexSpec(256, 16, 8), 3), (config.IndexSpec(64, 8, 4), 4)]
    assert [config.valid_nprobe(n) for n in (0, 5, 300)] == [8, 5, 8]
    assert config.merged(config.SearchConfig(), {"topn": 3}, {"topn": 5, "nprobe": 2}).topn == 3
    with pytest.raises(ValueError):
        config.SearchConfig(topn=0)


def test_swath_and_deviation(spark):
    scans = spark.createDataFrame([(0, s, 1 if s % 3 == 1 else 2) for s in range(1, 10)], "file_id int, scan int, ms_level int")
    assert timeseries.swath_cycle(scans).first().cycle == 3
    peaks = spark.createDataFrame([(0, 100.0), (1, 100.01), (1, 100.5), (2, 100.02)], "scan_no bigint, mz double")
    d = metrics.scan_deviation(peaks, 0.1).first()
    assert d.n == 2 and d.mean == pytest.approx(0.01)


def scaled_scores(spark, dps):
    """Background scores of pairs (0, idx) whose norms are 85 on either side."""
    pairs = spark.createDataFrame([(0, i, dp) for i, dp in enumerate(dps)], "query_id bigint, idx bigint, dp bigint")
    own = spark.createDataFrame([(0, 85)], "query_id bigint, qnorm2 bigint"), spark.createDataFrame([(i, 85) for i in range(len(dps))], "idx bigint, cnorm2 bigint")
    return score.with_background_score(pairs, *own)


def test_background_score_is_scaled_before_it_is_divided(spark):
    dps = [49, 57, 85, 100]  # floor(42925 * (49 / 85)) is 24744, floor(42925 * 49 / 85) is 24745
    assert [r.score for r in scaled_scores(spark, dps).orderBy("idx").collect()] == [24745, 28785, 42925, 42925]


def test_score_histogram_of_scaled_scores(spark):
    scores = scaled_scores(spark, [0, 49, 57, 85])
    found = {r.k: r.n for r in stats.histogram(scores, steps=42925).collect()}  # a step is one point
    assert found == {0: 1, 24745: 1, 28785: 1, 42925: 1}
