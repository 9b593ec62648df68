"""Classes, prefixes and hot buckets of the near-duplicate operator."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from peakforge.llm import near_dedup
from test_llm_operators import SCHEMA, classes, prose, shingle_set


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Links 0-1, 1-2, ... of 1000 nodes with rising ids, a star, and a ring."""
    rows = [(i, i + 1) for i in range(1000)] + [(5000, 5001 + i) for i in range(500)] + [(9000 + i, 9000 + (i + 1) % 7) for i in range(7)]
    rounds, real = [], near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: rounds.append(name) or real(df, name))
    links, want = spark.createDataFrame(rows, "a bigint, b bigint"), {i: 0 for i in range(1001)} | {i: 5000 for i in range(5000, 5501)} | {i: 9000 for i in range(9000, 9007)}
    assert {r.id: r["class"] for r in near_dedup.classes_of(links, 0).collect()} == want
    assert 3 <= rounds.count("contracted") <= 12
    rounds.clear()
    assert {r.id: r["class"] for r in near_dedup.classes_of(links, 100).collect()} == want and rounds.count("contracted") <= 6
    rounds.clear()
    assert {r.id: r["class"] for r in near_dedup.classes_of(links).collect()} == want and rounds.count("contracted") == 0


def test_no_links(spark):
    assert near_dedup.classes_of(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert near_dedup.classes_of(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0


def test_prefixes_keep_every_link(spark):
    """Sets as alike as asked share a kept shingle if they are of different classes; a class's own shingles come first."""
    import numpy as np

    r = random.Random(3)
    sets = {}
    for k in range(60):
        base = [r.randrange(1 << 40) for _ in range(40)] if k % 6 == 0 else base
        common = list(range(100, 100 + r.choice((0, 20, 60))))
        sets[k] = sorted({*(x if r.random() < 0.95 else r.randrange(1 << 40) for x in base), *common})
    packed = [(k, np.array(v, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for k, v in sets.items()]
    found = near_dedup.prefixes(spark.createDataFrame([(k, k) for k in sets], "id bigint, class bigint"), spark.createDataFrame(packed, "id bigint, members binary"), 0.8)
    of = collections.defaultdict(set)
    for row in found.collect():
        of[row.id].add(row.key)
    alike = [(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    assert len(alike) > 20 and all(of[a] & of[b] for a, b in alike)
    assert all(len(v) <= len(sets[k]) // 5 + 1 for k, v in of.items())


def test_a_bucket_of_many_classes(spark, monkeypatch):
    """Documents that share a long passage and so a bucket, among them a few pairs that are alike: whole classes, few comparisons."""
    passage = prose(120, 900)
    rows = [(k, f"{prose(60, 1000 + k)} {passage}") for k in range(200)]
    rows += [(300 + k, rows[k * 7][1].rsplit(" ", 3 + k % 4)[0]) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes({i: shingle_set(t) for i, t in rows})


def test_rows_that_share_an_id(spark):
    """The same row of an id stays however the table is partitioned."""
    rows = [(7, f"{prose(80, k)}", str(k)) for k in range(6)] + [(7, None, "n"), (8, prose(80, 50), "x"), (None, prose(80, 51), "y"), (None, prose(80, 51), "z")]
    kept = set()
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, tag string").repartition(n)
        out = near_dedup.one_of_each(docs)
        assert out.columns == docs.columns
        kept.add(tuple(sorted(tuple(map(str, r)) for r in out.collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 4


@pytest.mark.parametrize("changes, share", [(2, 0.99), (6, 0.95)])
def test_recall_by_similarity(spark, changes, share):
    """Pairs of similarity 0.94 and 0.82: nearly all of those of 0.8 or more are found."""
    rows = []
    for k in range(60):
        words = prose(300, 3000 + k).split()
        rows.append((2 * k, " ".join(words)))
        for j in random.Random(k).sample(range(300), changes):
            words[j] = "other"
        rows.append((2 * k + 1, " ".join(words)))
    alike = [k for k in range(60) if (lambda a, b: len(a & b) >= 0.8 * len(a | b))(shingle_set(rows[2 * k][1]), shingle_set(rows[2 * k + 1][1]))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(alike) > 20 and sum(got[2 * k] == got[2 * k + 1] for k in alike) >= share * len(alike)


def test_clashing_columns(spark):
    rows = [(1, prose(60, 1), "a"), (2, prose(60, 1), "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __gone string").withColumn("class_id", F.lit("c")).withColumn("id", F.lit("d"))
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert SCHEMA
