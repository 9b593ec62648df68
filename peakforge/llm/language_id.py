"""Language identification: known words first, then shorter and shorter n-grams.

Training counts words and n-grams of whole texts, by language, over a bounded
sample of labelled documents (``train_docs`` a language, those of the smallest
hash); the model has all of them, so its size follows that of the sample. A word that the model knows scores its log frequency in each language;
an unseen word scores the mean log frequency of its n-grams of the greatest
length of which any is known. A document's language has the greatest sum.

Texts that are null or have no letter are ``und`` with score 0; so are all texts
if nothing was learned. Ties go to the first language by code point. Rows are
judged one by one; only the id, text and language columns are read, and the
language only for training.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, read, sampled_by_key, slices

#: Letters only: no digits, superscripts, fractions or Roman numerals.
LETTERS = regex.compile(r"\p{L}+")
LONGEST = 4
KNOWN_CACHE = 200_000


def ngrams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 1500) -> dict:
    """The model: all words and n-grams of at most so many documents a language."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    chosen = sampled_by_key(labelled.distinct(), "lang", "id", train_docs, 5).select("id").distinct()
    texts = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def count(batches):
        import pyarrow as pa

        seen: dict[str, tuple[Counter, Counter]] = {}
        for batch in slices(batches):
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen.setdefault(lang, (Counter(), Counter()))[0].update(LETTERS.findall((text or "").lower()))
        for lang, (own, parts) in seen.items():
            for word, k in own.items():
                for n in range(1, LONGEST + 1):
                    for g in ngrams(word, n):
                        parts[g] += k
            for kind, found in (("w", own), ("g", parts)):
                tokens = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(tokens)), pa.array([kind] * len(tokens)), pa.array(tokens, pa.string()), pa.array([found[t] for t in tokens], pa.int64())],
                    names=["lang", "kind", "token", "n"],
                )

    counts = texts.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(count, "lang string, kind string, token string, n bigint")
    rows = counts.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")).toArrow().to_pydict()  # of the sample
    langs = sorted(set(rows["lang"]))
    place = {x: i for i, x in enumerate(langs)}
    tables = {}
    for kind in "wg":
        ids: dict[str, int] = {}
        cells = [(ids.setdefault(t, len(ids)), place[x], n) for x, k, t, n in zip(rows["lang"], rows["kind"], rows["token"], rows["n"]) if k == kind]
        table = np.zeros((len(ids), len(langs)))
        for i, j, n in cells:
            table[i, j] = n
        tables[kind] = (ids, table)
    word_ids, table = tables["w"]
    scores = np.log((table + 0.5) / (table.sum(0) + 0.5 * len(word_ids))) if langs else table
    gram_ids, table = tables["g"]
    by_length = np.array([len(g) for g in gram_ids], dtype=np.int64)
    grams_scores = np.zeros(table.shape)
    for n in range(1, LONGEST + 1):
        own = by_length == n
        if own.any():
            grams_scores[own] = np.log((table[own] + 0.5) / (table[own].sum(0) + 0.5 * own.sum()))
    return {"langs": langs, "words": word_ids, "scores": scores.astype(np.float32), "grams": gram_ids, "gram_scores": grams_scores.astype(np.float32)}


class Scorer(dict):
    """Row of each word in a table of scores; unseen words get a row when first met."""

    def __init__(self, model: dict):
        super().__init__(model["words"])
        self.model, self.known = model, len(model["words"])
        self.table = np.concatenate([model["scores"], np.zeros((KNOWN_CACHE, len(model["langs"])), dtype=np.float32)])

    def __missing__(self, word: str) -> int:
        row = len(self)
        self.table[row] = self.backoff(word)
        self[word] = row
        return row

    def backoff(self, word: str) -> np.ndarray:
        ids = self.model["grams"]
        for n in range(LONGEST, 0, -1):
            rows = [ids[g] for g in ngrams(word, n) if g in ids]
            if rows:
                return self.model["gram_scores"][rows].mean(0)
        return np.zeros(len(self.model["langs"]), dtype=np.float32)

    def room(self, tokens: int) -> None:
        if len(self) + tokens > len(self.table):
            self.clear()
            self.update(self.model["words"])
        if self.known + tokens > len(self.table):  # one very long text
            self.table = np.concatenate([self.table, np.zeros((tokens, self.table.shape[1]), dtype=np.float32)])


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, lang_pred and score, the share of the likeliest language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def run(batches):
        import pyarrow as pa

        scorer, langs = Scorer(shared.value), shared.value["langs"]
        for batch in slices(batches, chars=1_000_000):
            words = [LETTERS.findall(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            lengths = np.array([len(w) for w in words])
            best, score = ["und"] * len(words), np.zeros(len(words))
            if langs and lengths.any():
                scorer.room(int(lengths.sum()))
                rows = np.fromiter((scorer[w] for own in words for w in own), dtype=np.int64, count=int(lengths.sum()))
                some = np.flatnonzero(lengths)
                total = np.add.reduceat(scorer.table[rows], (np.cumsum(lengths) - lengths)[some], axis=0, dtype=np.float64)
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, k, s in zip(some.tolist(), total.argmax(1).tolist(), share.max(1).tolist()):
                    best[i], score[i] = langs[k], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema[0].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs, ~out)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
