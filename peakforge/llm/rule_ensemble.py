"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over text statistics are grown on a bounded sample of
labelled documents; every path from a root is a conjunctive rule, lasso logistic
regression keeps few of them, and those are compiled into one Spark column over
the same statistics. The score is the logistic of the weighted rules that hold.

Only statistics of the text enter a score: null and empty texts score as texts
without words. With no labels all scores are those of an even prior; with labels
of one class, of a prior smoothed by one document. Rows are judged one by one,
so repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, read, sampled_by_key
from .quality_rules import measures

#: The statistics that rules may name.
STATISTICS = (
    "n_words", "symbol_ratio", "mean_word_chars", "upper_ratio", "bang_ratio", "dup_line_ratio", "stop_ratio", "distinct_ratio", "digit_ratio", "line_words", "repeat_ratio",
)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, low exclusive, high inclusive) that must all hold, and the weight."""

    conditions: tuple[tuple[str, float | None, float | None], ...]
    weight: float


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], depth: int, least: float):
    """A tree as (feature, cut, left, right) or a leaf's value."""
    value = gradient.sum() / (hessian.sum() + 1.0)
    best = (1e-6, None, None)
    if depth and len(x) >= 2:
        whole = gradient.sum() ** 2 / (hessian.sum() + 1.0)
        for f in range(x.shape[1]):
            for c in cuts[f]:
                left = x[:, f] <= c
                hl, hr = hessian[left].sum(), hessian[~left].sum()
                if min(hl, hr) < least:
                    continue
                gain = gradient[left].sum() ** 2 / (hl + 1.0) + gradient[~left].sum() ** 2 / (hr + 1.0) - whole
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    if best[1] is None:
        return float(value)
    _, f, c = best
    left = x[:, f] <= c
    return f, float(c), grow(x[left], gradient[left], hessian[left], cuts, depth - 1, least), grow(x[~left], gradient[~left], hessian[~left], cuts, depth - 1, least)


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, left, right = tree
    return np.where(x[:, f] <= c, apply_tree(left, x), apply_tree(right, x))


def paths(tree, held=()):
    """The conjunctions of all nodes but the root, as dicts feature -> (low, high)."""
    if held:
        box: dict[int, tuple[float, float]] = {}
        for f, low, high in held:
            a, b = box.get(f, (-np.inf, np.inf))
            box[f] = (max(a, low), min(b, high))
        yield tuple(sorted(box.items()))
    if isinstance(tree, tuple):
        f, c, left, right = tree
        yield from paths(left, (*held, (f, -np.inf, c)))
        yield from paths(right, (*held, (f, c, np.inf)))


def holds(path, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > a) & (x[:, f] <= b) for f, (a, b) in path])


def lasso_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, strength: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by accelerated proximal gradient steps; the intercept is not shrunk."""
    w = weights / weights.sum()
    coefficients, intercept = np.zeros(x.shape[1]), 0.0
    look, look0, t = coefficients.copy(), 0.0, 1.0
    lipschitz = 0.25 * np.linalg.norm(np.column_stack([x, np.ones(len(x))]) * np.sqrt(w)[:, None], 2) ** 2 + 1e-9
    p0 = np.clip((w * y).sum(), 1e-6, 1 - 1e-6)
    penalty = strength * np.abs(x.T @ (w * (y - p0))).max(initial=0.0)
    for _ in range(steps):
        error = w * (1 / (1 + np.exp(-(x @ look + look0))) - y)
        moved = look - x.T @ error / lipschitz
        new = np.sign(moved) * np.maximum(np.abs(moved) - penalty / lipschitz, 0)
        new0 = look0 - error.sum() / lipschitz
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look0 = new + (t - 1) / t1 * (new - coefficients), new0 + (t - 1) / t1 * (new0 - intercept)
        coefficients, intercept, t = new, new0, t1
    return coefficients, float(intercept)


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray, names=STATISTICS, trees: int = 30, depth: int = 3, strength: float = 0.01, seed: int = 1) -> tuple[list[Rule], float]:
    """(rules, intercept) from statistics x and labels y in {0, 1}."""
    total = weights.sum()
    prior = ((weights * y).sum() + 0.5) / (total + 1.0) if len(y) else 0.5
    intercept = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return [], intercept
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    margin, found = np.full(len(y), intercept), {}
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.5
        features = rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        p = 1 / (1 + np.exp(-margin))
        own = [cuts[f] if f in features else cuts[f][:0] for f in range(x.shape[1])]
        tree = grow(x[rows], (weights * (y - p))[rows], (weights * p * (1 - p))[rows], own, depth, 1e-4 * total)
        margin += 0.3 * apply_tree(tree, x)
        found.update(dict.fromkeys(paths(tree)))
    rules = list(found)
    if not rules:
        return [], intercept
    table = np.column_stack([holds(r, x) for r in rules]).astype(float)
    coefficients, intercept = lasso_logistic(table, y, weights, strength)
    kept = []
    for path, c in zip(rules, coefficients):
        if abs(c) > 1e-3:
            limits = tuple((names[f], None if a == -np.inf else float(a), None if b == np.inf else float(b)) for f, (a, b) in path)
            kept.append(Rule(limits, float(c)))
    return kept, intercept


def compiled(rules: list[Rule], intercept: float) -> Column:
    """The score as a column over the statistics."""
    z = F.lit(intercept)
    for r in rules:
        ok = F.lit(True)
        for name, low, high in r.conditions:
            if low is not None:
                ok = ok & (F.col(name) > low)
            if high is not None:
                ok = ok & (F.col(name) <= high)
        z = z + F.when(ok, F.lit(r.weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, usable, train_docs: int = 3000, **options) -> tuple[list[Rule], float]:
    """Rules learned from at most ``train_docs`` documents of each label, those of the smallest hash.

    docs: (doc_id, text); labels: (doc_id, quality); usable: a condition on a doc_id
    column. Classes weigh as they are found among all usable labels.
    """
    seen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable(F.col("doc_id")))
    own = seen.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in seen.groupBy("quality").count().collect()}
    chosen = sampled_by_key(own, "quality", "doc_id", train_docs, 17)
    # at most 2 * train_docs rows
    sample = measures(docs.join(F.broadcast(chosen), "doc_id"), "text", "doc_id", "quality", more=True).select("doc_id", "quality", *STATISTICS)
    rows = sample.toPandas().sort_values(["doc_id", *STATISTICS])
    x, y = rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float)
    weights = np.array([counts[int(q)] / max(1, (y == q).sum()) for q in y])
    return fit(x, y, weights / max(1e-9, weights.mean()) if len(y) else weights, **options)


def scored(docs: DataFrame, rules: list[Rule], intercept: float, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.7) -> DataFrame:
    """One row a document: id, score, predicted."""
    m = measures(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", "__id", more=True)
    out = m.select(F.col("__id").alias(id_col), compiled(rules, intercept).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int"))


def op3_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    rules, intercept = train(docs, labels, lambda i: ~held_out(i, 4, 2))
    return scored(docs, rules, intercept).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
