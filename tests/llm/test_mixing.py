"""Which documents a mix takes, against a plain loop over the same keys; sources and documents of size 0."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from peakforge.llm import mixing
from test_llm_operators import SCHEMA, odd_rows, prose

MIX = "doc_id bigint, text string, source string"


def expected(docs, buckets=1024, seed=7, weights=(3, 1, 2)):
    """Counter of (doc_id, size, repeats), one document at a time."""
    rows = mixing._slim(docs, "doc_id", "text", "source", buckets, seed).select("__id", "__source", "__size", "__key", "__hash").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["__source"]].append(((r["__key"], r["__id"] is not None, r["__id"] or 0, r["__hash"]), r["__id"], r["__size"]))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    size = {s: sum(x[2] for x in by[s]) for s in by}
    target, free, total = {}, set(by), 1.5 * sum(size.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * size[s] <= level * weight[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    out = collections.Counter()
    for s, docs_of in by.items():
        docs_of.sort()
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, at, taken = target[s] - epochs * size[s], 0, []
        for _, _, n in docs_of:
            taken.append(rest > 0 and at + n / 2 <= rest)
            at += n
        gap = rest - sum(x[2] for x, t in zip(docs_of, taken) if t)
        left = [(abs(gap - x[2]), x[0], k) for k, (x, t) in enumerate(zip(docs_of, taken)) if not t and 0 < x[2] < 2 * gap]
        if gap > 0 and left:
            taken[min(left)[2]] = True
        for (_, i, n), t in zip(docs_of, taken):
            out[i, n, epochs + t] += 1
    return out


def table(spark, seed, n=150):
    r = random.Random(seed)
    rows = [(k if r.random() < 0.7 else r.choice((None, k % 5)), r.choice((None, "", " ", *[prose(r.randint(1, 200), k)] * 8)), r.choice(("a", "b", "c", None))) for k in range(n)]
    return spark.createDataFrame(rows + rows[:3], MIX)


@pytest.mark.parametrize("seed", [1, 2])
def test_selection(spark, seed):
    """Also with null ids and ids that several texts share; however the table is dealt out."""
    docs = table(spark, seed)
    want = expected(docs)
    for n in (1, 3, 7):
        got = mixing.mix(docs.repartition(n)).collect()
        assert collections.Counter((r.doc_id, r.size, r.repeats) for r in got) == want
        assert all(r.taken == r.repeats * r.size and r.repeats in (0, 1, 2) for r in got)


def test_mixed_documents_are_what_the_mix_takes(spark):
    docs = table(spark, 5).distinct().withColumn("__size", F.lit("own"))
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.repeats
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    n = mixing.word_count(F.col("text"))
    assert collections.Counter((r.doc_id, r.source, r.n) for r in got.select("doc_id", "source", n.alias("n")).collect()) == +want


def test_texts_are_not_dealt_out(spark, sf):
    plan = mixing.mixed_documents(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_empty_sources(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three", "b"), (4, "four", "b"), (5, " ", "b"), (6, None, None)]
    docs = spark.createDataFrame(rows, MIX)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(got) == 6 and got[1].target == 0 and got[1].source_size == 0 and all(got[k].taken == 0 for k in (1, 2, 5, 6))
    assert got[3].target == 6.0 and {got[k].repeats for k in (3, 4, 5)} <= {0, 1, 2} and got[3].taken == 6
    assert mixing.mixed_documents(docs).count() == sum(r.repeats for r in got.values())
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "\n", "b")], MIX)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mixed_documents(nothing).count() == 0


def test_columns(spark, sf):
    assert mixing.op2_mixing(spark, sf).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    assert mixing.mixed_documents(odd).columns == odd.columns
