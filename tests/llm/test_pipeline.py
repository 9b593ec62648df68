import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from peakforge.llm import near_dedup, quality_rules


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        now = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        assert ids is None or set(now) <= set(ids)
        if name == "quality_rules":
            assert set(now) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        if name == "near_dedup":
            assert set(now) == {r.class_id for r in near_dedup.near_duplicates(docs).collect()}
        if name == "sharding":
            assert now == ids
        docs, ids = out, now
    again = corpus_pipeline.run(spark, sf)
    assert collections.Counter((r.doc_id, r.shard) for r in again.collect()) == collections.Counter((r.doc_id, r.shard) for r in docs.collect())


def test_import_without_subpackage(tmp_path):
    """The entry still imports, with the other queries, where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "peakforge", tmp_path / "peakforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topn_neighbors' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def plain_kept(text):
    from test_models import plain_statistics

    s = plain_statistics(text)
    return (
        s["n_words"] >= 50 and s["repeat_ratio"] <= 0.5 and s["symbol_ratio"] <= 0.1 and 2.5 <= s["mean_word_chars"] <= 12 and s["upper_ratio"] <= 0.3
        and s["bang_ratio"] <= 0.3 and s["dup_line_ratio"] <= 0.5 and s["stop_ratio"] >= 0.01
    )


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before it gave, against plain loops; the table also holds odd rows and columns of clashing names."""
    from test_llm_operators import SCHEMA, classes, odd_rows, prose, shingle_set
    from test_mixing import expected

    stop = " the of and to in is that for it as was with be by on not he this are or an at from which"
    more = [(None, prose(80, 1) + stop, None, None, None, *"abcd"), (None, prose(80, 1) + stop, None, None, None, *"abcd"), (7 * 10**6, prose(90, 2) + stop, "en", "s9", 3, *"abcd"), (7 * 10**6, prose(95, 3) + stop, "en", "s9", 3, *"abcd")]
    odd = spark.createDataFrame([*odd_rows(), *more], SCHEMA).withColumn("doc_id", F.col("doc_id") + 10**6)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in ("id", "n_words", "kept", "shard"):
        docs = docs.withColumn(c, F.lit("x"))
    docs = docs.unionByName(odd.select(docs.columns)).repartition(5).cache()
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def grams(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    items = set().union(*map(grams, benchmark))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf).cache()
        after = out.collect()
        if k < 4:
            assert out.columns == columns
        now = collections.Counter((r.doc_id, r.text) for r in after)
        if name == "quality_rules":
            assert now == collections.Counter((r.doc_id, r.text) for r in before if plain_kept(r.text))
        if name == "near_dedup":
            sets = {}
            for r in before:
                if r.doc_id is not None:
                    sets.setdefault(r.doc_id, set()).add(shingle_set(r.text))
            assert len(sets) < len([r for r in before if r.doc_id is not None])  # an id that two texts share
            one = classes({i: min(s, key=len) for i, s in sets.items() if len(s) == 1})
            assert collections.Counter(r.doc_id for r in after) == collections.Counter([*(i for i, c in one.items() if i == c), *(i for i, s in sets.items() if len(s) > 1), *(None for r in before if r.doc_id is None)])
        if name == "decontamination":
            assert now == collections.Counter((r.doc_id, r.text) for r in before if not grams(r.text) & items)
        if name == "mixing":
            want = collections.Counter()
            for (i, n, repeats), rows in expected(docs).items():
                want[i, n] += repeats * rows
            got = collections.Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in after)
            assert got == +want
        if name == "sharding":
            assert now == collections.Counter((r.doc_id, r.text) for r in before) and {r.shard for r in after} <= set(range(40))
        docs = out


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
