"""Hot substrings: texts of one byte, short periods, many of them, and long texts read in parts."""

import random

import pytest

from peakforge.llm import substring_dedup
from test_llm_operators import prose, repeated

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def check(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in substring_dedup.deduplicated(docs).collect())
    assert got == repeated(sorted((i, t.encode()) for i, t in rows))


def test_texts_of_one_byte_and_short_periods(spark):
    rows = [(1, "a" * 300_000), (2, "ab" * 60_000), (3, "x" + "a" * 5_000 + "y"), (4, "abc" * 3_000 + "a" * 99), (5, "b" + "ab" * 200), (6, prose(300, 1)), (7, "é" * 3_000)]
    check(spark, rows)


def test_many_texts_of_one_byte(spark):
    """No key gathers what the documents repeat: each sends a string of a kind once."""
    rows = [(k, "a" * (400 + k % 3) + f" {k} " + "-" * 150) for k in range(500)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    found = substring_dedup.anchor_hashes(docs).groupBy("hash").sum("n").collect()
    assert max(r[1] for r in found) > 100_000  # occurrences inside documents count
    check(spark, rows)


@pytest.mark.parametrize("chunk", [150, 1000])
def test_long_texts_are_read_in_parts(spark, monkeypatch, chunk):
    """Results do not depend on where a long text is cut."""
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 1)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    r = random.Random(4)
    shared = prose(60, 3)
    rows = [(k, " ".join(prose(r.randint(20, 300), 10 + k) + " " + shared for _ in range(2))) for k in range(6)] + [(9, prose(700, 12)), (10, "z" * 2_000)]
    check(spark, rows)


def test_rows_that_share_an_id(spark):
    """Texts of one id stand side by side: neither is before the other."""
    shared = prose(80, 5)
    docs = spark.createDataFrame([(1, shared + " one"), (1, shared + " two"), (2, "and " + shared)], "doc_id bigint, text string")
    got = substring_dedup.deduplicated(docs).collect()
    assert [r.n_removed for r in got if r.doc_id == 1] == [0, 0]
    assert [r.n_removed for r in got if r.doc_id == 2] == [len(shared)]
