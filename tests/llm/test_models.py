"""Classifiers against plain loops over the same models, searches against exhaustive ones, and odd tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.llm import common, decontamination, language_id, licenses, rule_ensemble, secrets, sharding
from test_llm_operators import SCHEMA, base_phrases, base_spans, odd_rows, prose


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- quality -----------------------------------------------------------------------------------


def plain_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    repeat = len({i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)})
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))
    stop = set(rule_ensemble.measures.__globals__["STOP_WORDS"])
    return {
        "n_words": len(w), "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / n, "mean_word_chars": sum(map(len, w)) / n, "upper_ratio": sum(c.isupper() for c in t) / chars, "bang_ratio": t.count("!") / n,
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)), "stop_ratio": sum(x.lower() in stop for x in w) / n, "distinct_ratio": len(set(w)) / n,
        "digit_ratio": len(re.findall("[0-9]", t)) / chars, "line_words": len(w) / max(1, len(lines)), "repeat_ratio": repeat / n,
    }


def test_rules_score_as_a_loop_does(spark, sf, odd):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules, intercept = rule_ensemble.train(documents, labels, lambda i: ~common.held_out(i, 4, 2))
    docs = documents.unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    for r in rule_ensemble.scored(docs, rules, intercept).collect():
        scores = []
        for t in texts[r.doc_id]:
            s, z = plain_statistics(t), intercept
            for rule in rules:
                if all((low is None or s[c] > low) and (high is None or s[c] <= high) for c, low, high in rule.conditions):
                    z += rule.weight
            scores.append(1 / (1 + math.exp(-z)))
        assert min(abs(r.score - x) for x in scores) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_labels_are_learned_alike_however_they_lie(spark, sf, odd):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    usable = lambda i: ~common.held_out(i, 4, 2)
    found = [rule_ensemble.train(d, x, usable, train_docs=40) for d, x in ((documents, labels), (documents.repartition(5), labels.unionByName(labels).repartition(3)))]
    assert [r.conditions for r in found[0][0]] == [r.conditions for r in found[1][0]]
    strange = spark.createDataFrame([(0, None), (1, 7), (None, 1), (4, 0), (4, 1)], "doc_id bigint, quality int")
    rules, intercept = rule_ensemble.train(odd, strange, lambda i: F.lit(True))
    assert rules == [] and rule_ensemble.scored(odd, rules, intercept).count() == odd.count()


def test_samples_by_key(spark):
    """The rows of the smallest hashes of each key, whether there are many or few."""
    rows = spark.createDataFrame([("a" if i % 10 else "b", i) for i in range(4000)], "k string, id bigint")
    got = common.sampled_by_key(rows, "k", "id", 50, 3)
    assert got.columns == ["k", "id"]
    h = common.uniform(F.col("id"), F.lit(3))
    want = {(k, r.id) for k in "ab" for r in rows.where(F.col("k") == k).orderBy(h).limit(50).collect()}
    assert {tuple(r) for r in got.collect()} == want
    few = rows.where("id < 30")
    assert common.sampled_by_key(few, "k", "id", 50, 3).count() == 30


# --- language --------------------------------------------------------------------------------------


def plain_language(text, model):
    words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if not words:
        return "und", 0.0
    total = np.zeros(len(model["langs"]))
    for w in words:
        if w in model["words"]:
            total += model["scores"][model["words"][w]]
            continue
        for n in range(4, 0, -1):
            p = f"^{w}$"
            known = [model["grams"][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in model["grams"]]
            if known:
                total += model["gram_scores"][known].mean(0)
                break
    share = np.exp(total - total.max())
    return model["langs"][int(total.argmax())], float(share.max() / share.sum())


def test_language_scores_as_a_loop_does(spark, sf, odd, empty):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(documents, ~common.held_out(F.col("doc_id"), 3, 1), train_docs=20)
    made = [(10**6 + k, t) for k, t in enumerate(("²½ Ⅷ 123 _", "x² é½y", "qqq zzz", "Straße ΑΒΓ жук", " ", None, "The the THE", prose(3000, 5)))]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string")).unionByName(odd.where("doc_id is not null").select((F.col("doc_id") + 2 * 10**6).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        lang, score = plain_language(texts[r.doc_id], model)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), r.doc_id
    assert plain_language("²½ Ⅷ", model)[0] == "und" and language_id.predict(empty, model).count() == 0


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "xx"), (2, "alpha beta", "aa"), (3, "alpha", None)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"aa"}


# --- secrets, licenses, shards on odd tables ------------------------------------------------------------


def test_odd_tables(spark, odd, empty):
    secret = "password = 'abcdefgh12' " + "0123456789abcdef" * 3
    more = [(50, prose(30_000, 9) + " " + secret + " mit license", *[None] * 7), (51, secret, *["x"] * 2, None, *["y"] * 4), (51, secret, *["x"] * 2, None, *["y"] * 4)]
    docs = odd.unionByName(spark.createDataFrame(more, SCHEMA))
    want = collections.Counter((r.doc_id, base_spans(r.text or "")) for r in docs.collect())
    got = collections.Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in secrets.spans(docs).collect())
    assert got == want and secrets.spans(empty).count() == 0
    want = collections.Counter((r.doc_id, *base_phrases(r.text)) for r in docs.collect())
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect())
    assert got == want and licenses.scan(empty).count() == 0


def test_trigram_index():
    index = secrets.TrigramIndex(["abc", "akia"[:3], "x_y", "éab"])
    texts = ["xABCx", "ab", "", "c akI", "aéabc", "zzab", "cx_"]
    raw = [t.encode() for t in texts]
    got = index.postings(b"".join(raw), np.cumsum([0, *map(len, raw)]))
    assert got["abc"] == {0, 4} and got["aki"] == {3} and got["x_y"] == set() and got["éab"] == set(range(7))


def test_license_wording():
    """Each signature's keywords stand in a text that it matches, and a text of each license is told by its own label."""
    rules = licenses.signatures()
    for _, _, label, regex, words in rules:
        assert words and all(re.fullmatch(rb"[a-z0-9]{2,}", w) for w in words), label
    texts = {
        "isc": b"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this",
        "zlib": b"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "gpl-3.0-only": b"under the terms of the gnu general public license version 3 as published by the free software foundation.",
        "mpl-2.0": b"this source code form is subject to the terms of the mozilla public license, v. 2.0.", "unlicense": b"this is free and unencumbered software released into the public domain.",
        "cc-by-sa-4.0": b"https://creativecommons.org/licenses/by-sa/4.0/", "apache-2.0": b'licensed under the apache license, version 2.0 (the "license")',
        "bsd-3-clause": b"neither the name of the\n university nor the names of its contributors may be used to endorse or promote products derived from this software",
        "ofl-1.1": b"this font software is licensed under the sil open font license, version 1.1.",
    }
    for label, text in texts.items():
        some = [r for r in rules if any(w in text for w in r[-1])]
        found = licenses.detect(text, some, [])[1]
        assert label in {x for _, _, x, _ in found}, label
        assert sorted(found) == sorted(licenses.detect(text, rules, [])[1])  # the keywords lose nothing


def test_containment_as_a_loop_has_it():
    r = random.Random(4)
    for _ in range(50):
        covered, kept = licenses.Covered(), []
        for _ in range(12):
            new = []
            for _ in range(r.randint(0, 4)):
                a = r.randrange(60)
                b = a + r.randint(1, 20)
                inside = any(x <= a and b <= y for x, y in kept)
                assert covered.holds(a, b) == inside
                if not inside:
                    new.append((a, b))
            if new:
                covered.add(new)
                kept += new


def test_many_detections_take_linear_time():
    import time

    rules, spent = licenses.signatures(), []
    for n in (2_000, 8_000):
        text = b"mit license\n" * n
        began = time.process_time()
        assert len(licenses.detect(text, [r for r in rules if b"license" in r[-1] or b"mit" in r[-1]], [])[1]) == n
        spent.append(time.process_time() - began)
    assert spent[1] < 12 * spent[0] + 0.5


def test_shards_keep_clashing_columns(spark, odd):
    docs = odd.withColumn("old_shard", F.lit("o")).withColumn("input_shard", F.lit(5))
    out = sharding.with_shards(docs)
    assert {"shard", "old_shard"} < set(out.columns) and len(set(out.columns)) == len(docs.columns) + 2
    names = [c for c in out.columns if c not in ("shard", "old_shard")]
    assert collections.Counter(map(tuple, out.select(*names).collect())) == collections.Counter(map(tuple, docs.collect()))
    assert {r.shard for r in out.collect()} <= set(range(40))


def test_shards_from_where_documents_lie(spark, tmp_path):
    """Old shards from a column; the rewritten files hold what the plan says."""
    docs = spark.createDataFrame([(k, prose(5 + k % 40, k), 0 if k < 300 else k % 4) for k in range(400)], "doc_id bigint, text string, at int")
    placed = sharding.with_shards(docs, shards=4, old_col="at").cache()
    assert placed.where("old_shard <> at").count() == 0
    sizes = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 400
    moved = placed.where("shard <> old_shard").agg(F.sum(F.octet_length("text") + 16)).first()[0]
    old = collections.Counter()
    for r in docs.collect():
        old[r.at] += len(r.text) + 16
    mean = sum(old.values()) / 4
    assert moved <= 1.05 * sum(max(0, old[k] - mean) for k in range(4)) + 400  # no more than must leave the fuller shards
    sharding.rewrite(placed, str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()} <= {(r.doc_id, r.shard) for r in placed.collect()}


# --- decontamination --------------------------------------------------------------------------------------


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_recall_of_paraphrases(spark):
    """Against an exhaustive search over all regions of all documents: at least nine in ten are found, nothing else is."""
    r = random.Random(8)
    items = [(k, prose(r.randint(20, 50), 700 + k)) for k in range(24)]
    docs = []
    for k, t in items:
        w = [x for x in t.split() if r.random() > 0.04 * (k % 6)]  # up to a fifth of the words gone
        w = [r.choice(w) if r.random() < 0.03 * (k % 6) else x for x in w]  # up to a seventh replaced
        docs.append((k, f"{prose(r.randint(30, 90), 800 + k)} {' '.join(w)} {prose(40, 900 + k)}"))
    docs += [(100 + k, prose(200, 1200 + k)) for k in range(10)]
    truth = set()
    for i, t in docs:
        words = t.split()
        for k, item in items:
            x = item.split()
            answer = x[-max(1, len(x) // 4) :]
            for a in range(0, len(words), 4):
                region = words[a : a + 2 * len(x)]
                if plain_lcs(x, region) >= 0.65 * len(x) and plain_lcs(answer, region) >= 0.5 * len(answer):
                    truth.add((i, k))
                    break
    kind = "id bigint, text string"
    found = decontamination.search(spark.createDataFrame(docs, kind), spark.createDataFrame(items, kind)).collect()
    got = {(x.id, h.item) for x in found for h in x.hits}
    own = {(k, k) for k, _ in items}
    assert len(truth & own) >= 20 and len(got & truth & own) >= 0.9 * len(truth & own) and got <= truth | own


def test_many_blocks_are_searched_in_the_documents_themselves(spark):
    """Several passes give what one gives, for texts that hold several items, null texts and repeated rows; other columns stay."""
    items = [(k, prose(30, 60 + k)) for k in range(9)]
    docs = [(1, items[0][1] + " " + items[8][1], "a"), (2, None, "b"), (3, items[4][1], "c"), (3, items[4][1], "c"), (4, "", None), (None, prose(50, 99), "d")]
    d, b = spark.createDataFrame(docs, "id bigint, text string, tag string"), spark.createDataFrame(items, "id bigint, text string")
    few, one = (sorted(((r.id, r.text, r.tag, [(h.item, round(h.share, 6)) for h in r.hits]) for r in decontamination.search(d, b, block_items=n).collect()), key=str) for n in (2, 100))
    assert few == one and [x[0] for r in one if r[0] == 1 for x in r[3]] == [0, 8]
