"""Background scores, tail fits, p-values, false discovery rates and summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import NO_MODEL

STEPS = 10_000
LEFT_BOUND = 1e-3


def sample_size(total: int, fraction: float = 0.01, most: int = 10_000, least: int = 5_000) -> int:
    n = int(total * fraction)
    return most if n > most else min(most, total) if n < least else n


def background_sample(spectra: DataFrame, total: int, seed: int = 42, id_col: str = "spec_id", **limits) -> DataFrame:
    """The sample of the smallest hashes of (id, seed); its size follows the archive's."""
    key = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    return spectra.orderBy(key, id_col).limit(sample_size(total, **limits))


def histogram(scores: DataFrame, key: str = "query_id", score: str = "score", steps: int = STEPS, count: str | None = None) -> DataFrame:
    """(key, k, n, boundary): counts by steps of the range of each key; keys without a range have none. count: a column of how often a row counts."""
    bounds = scores.groupBy(key).agg(F.min(score).cast("double").alias("low"), F.max(score).cast("double").alias("high"))
    bounds = bounds.withColumn("step", (F.col("high") - F.col("low")) / steps).where("step >= 1e-10")
    k = F.floor((F.col(score) - F.col("low")) / F.col("step"))
    counted = scores.join(bounds, key).groupBy(key, k.alias("k")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"), F.min("low").alias("low"), F.min("step").alias("step"))
    return counted.select(key, "k", "n", (F.col("low") + F.col("k") * F.col("step")).alias("boundary"))


def counted_histogram(score: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, n, boundary) of one key, as histogram gives them, of distinct scores, ascending, and how often each counts."""
    low, high = (float(score[0]), float(score[-1])) if len(score) else (0.0, 0.0)
    step = (high - low) / steps
    if step < 1e-10:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    k = np.floor((score - low) / step).astype(np.int64)
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(n, first), low + k[first] * step


def counted_tail(score: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, survival, total) of one key, as histogram, survival and tail_points give them; y is log10 of survival."""
    _, n, boundary = counted_histogram(score, n, steps)
    some = boundary > LEFT_BOUND
    n, boundary = n[some][::-1], boundary[some][::-1]
    upto = np.cumsum(n)
    survival = upto / upto[-1:]
    upper = np.concatenate([[0.0], survival[:-1]])[: len(n)] <= 0.1
    return boundary[upper], survival[upper], np.repeat(upto[-1:], int(upper.sum()))


def score_histogram(scores: DataFrame, score: str = "score", overflow: int | None = None) -> DataFrame:
    at = F.least(F.col(score), F.lit(overflow)) if overflow is not None else F.col(score)
    return scores.groupBy(at.alias(score)).agg(F.count(F.lit(1)).alias("n"))


def survival(counts: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, boundary, survival, total): share of scores at or above each boundary that is above 1e-3."""
    counts = counts.where(F.col("boundary") > LEFT_BOUND)
    down = W.partitionBy(key).orderBy(F.col("boundary").desc()).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum("n").over(W.partitionBy(key))).withColumn("survival", F.sum("n").over(down) / F.col("total")).select(key, "boundary", "survival", "total")


def tail_points(surviving: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, x, y): log10 survival where it changes, from the rarest down to the first above 0.1."""
    order = W.partitionBy(key).orderBy(F.col("boundary").desc())
    points = surviving.withColumn("__before", F.lag("survival").over(order)).where("__before is null or survival <> __before")
    points = points.withColumn("__last", F.lag("survival").over(order))
    return points.where("__last is null or __last <= 0.1").select(key, F.col("boundary").alias("x"), F.log10("survival").alias("y"), "total")


def regression(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, k, b, r2) of y on x; null where x does not vary."""
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("y")
    sums = points.groupBy(*keys).agg(
        n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy")
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") ** 2
    cov, var = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("syy") - F.col("sy") ** 2
    k = F.when(F.abs(det) >= 1e-8, cov / det)
    return sums.select(*keys, "n", k.alias("k"), ((F.col("sy") - k * F.col("sx")) / F.col("n")).alias("b"), F.when((F.abs(det) >= 1e-8) & (var > 1e-12), cov * cov / (det * var)).alias("r2"))


def tail_model(points: DataFrame, key: str = "query_id", least: int = 50, r2: float = 0.95) -> DataFrame:
    """(key, lo, n, k, b, r2): the fit over y in [lo, -1] for the first lo of -2.5, -2.4, ... whose R2 is enough.

    The fifteen ranges are a constant list exploded by row, no join.
    """
    lows = [round(-2.5 + 0.1 * i, 1) for i in range(15)]
    each = points.where("y <= -1").select(key, "x", "y", F.explode(F.array(*[F.lit(x) for x in lows])).alias("lo")).where("y >= lo")
    fits = regression(each, key, "lo").where((F.col("n") >= least) & (F.col("r2") >= r2))
    return fits.groupBy(key).agg(F.min(F.struct("lo", "n", "k", "b", "r2")).alias("m")).select(key, "m.*")


def tail_model_early(points: DataFrame, key: str = "query_id", least: int = 10, r2: float = 0.99) -> DataFrame:
    """(key, lo, n, k, b, r2): the older fit, of fewer points but a better line."""
    return tail_model(points, key, least, r2)


def p_value(dp: Column, k: Column, b: Column, size: Column) -> Column:
    """1 - (1 - 10^(k dp + b))^size, 1 where above 0.1; spectra without a model get the constant of no model."""
    p = F.least(F.pow(F.lit(10.0), k * dp + b), F.lit(1.0))
    q = F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(size * F.log1p(-p)))
    return F.when(k.isNull(), F.lit(NO_MODEL)).when(F.isnan(q) | (q > 0.1), F.lit(1.0)).otherwise(q)


def p_value_spread(p_values: DataFrame, *keys: str) -> DataFrame:
    """(keys, p, p_std) over seeds."""
    return p_values.groupBy(*keys).agg(F.avg("p").alias("p"), F.stddev_pop("p").alias("p_std"))


def running(rows: DataFrame, column: str, sums: dict[str, str], descending: bool = False, buckets: int = 64) -> DataFrame:
    """rows with, for each name, the sum of a column over the rows up to and with this one, and name_total over all.

    column: a number that is distinct and not null. Its quantiles, a row of at most
    ``buckets`` numbers, cut it into ranges; sums of ranges come first, then each
    range is ordered on its own, so no task has all rows.
    """
    steps = [k / buckets for k in range(1, buckets)]
    found = rows.agg(F.percentile_approx(F.col(column).cast("double"), steps, 4 * buckets)).first()[0] or []
    cuts = sorted(set(found))

    def place(low: int, high: int) -> Column:
        """Number of cuts below the value, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) > F.lit(cuts[middle]), place(middle + 1, high)).otherwise(place(low, middle))

    marked = rows.withColumn("__b", place(0, len(cuts)))
    ranges = marked.groupBy("__b").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])  # at most as many rows as buckets
    direction = F.col("__b").desc() if descending else F.col("__b")
    earlier = W.orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("__b", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}_before") for n in sums], *[F.sum(f"__{n}").over(W.partitionBy()).alias(f"{n}_total") for n in sums])
    upto = W.partitionBy("__b").orderBy(F.col(column).desc() if descending else F.col(column)).rowsBetween(W.unboundedPreceding, 0)
    out = marked.join(F.broadcast(ranges), "__b").withColumns({n: F.col(f"__{n}_before") + F.sum(c).over(upto) for n, c in sums.items()})
    return out.drop("__b", *[f"__{n}_before" for n in sums])


def q_values(p_values: DataFrame, key: str, p: str = "p") -> DataFrame:
    """p_values with upto, total and bh = p total / upto (Benjamini-Hochberg). Ranks are running counts of distinct values."""
    counts = p_values.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("c"))
    ordered = running(counts, p, {"upto": "c"}).withColumnRenamed("upto_total", "total")
    return p_values.join(ordered.select(F.col(p).alias("__p"), "upto", "total"), F.col(p) == F.col("__p")).withColumn("bh", F.col(p) * F.col("total") / F.col("upto")).drop("__p")


def bh_threshold(p_values: DataFrame, level: float = 0.01, p: str = "p") -> DataFrame:
    """One row: the greatest p whose Benjamini-Hochberg value is within the level, else 0; and how many pass."""
    counts = p_values.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("c"))
    own = running(counts, p, {"upto": "c"})
    passes = F.col(p) * F.col("upto_total") / F.col("upto") <= level
    limit = own.agg(F.coalesce(F.max(F.when(passes, F.col(p))), F.lit(0.0)).alias("threshold"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max(F.when(passes, F.col("upto"))).alias("passed"))
    return limit.select("threshold", "n", F.coalesce("passed", F.lit(0)).alias("passed"))


def target_decoy_curve(scores: DataFrame, score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    """(score, targets, decoys, fdr) at each score: how many are at or above it; one row a distinct score."""
    by = scores.groupBy(score).agg(F.sum(F.when(F.col(decoy) == 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col(decoy) != 0, 1).otherwise(0)).alias("d"))
    out = running(by.where(F.col(score).isNotNull()), score, {"targets": "t", "decoys": "d"}, descending=True)
    return out.select(score, "targets", "decoys", (F.col("decoys") / F.greatest(F.col("targets"), F.lit(1))).alias("fdr"))


def prophet_threshold(error_points: DataFrame, level: float = 0.01) -> DataFrame:
    """min_prob of the error point (charge, error, min_prob) for all charges at the level."""
    return error_points.where((F.col("charge") == "all") & (F.col("error") == level)).agg(F.max("min_prob").alias("min_prob"))


def entropy(values: DataFrame, column: str, normalised: bool = False, base: float | None = None) -> DataFrame:
    """One row: entropy (natural log unless base is given) of a column's values, and how many values there are."""
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c")
    # -sum(p ln p) = ln n - sum(c ln c) / n
    h = (F.log(total.cast("double")) - F.sum(F.col("c") * F.log(F.col("c").cast("double"))) / total) / (float(np.log(base)) if base else 1.0)
    n = F.count(F.lit(1))
    out = F.when(n > 1, h / F.log(n.cast("double"))).otherwise(0.0) if normalised else h
    return counts.agg(out.alias("entropy"), n.alias("n_values"))


def ranking_histogram(ranks: DataFrame, rank: str = "rank", most: int = 10) -> DataFrame:
    return ranks.groupBy(F.least(F.col(rank), F.lit(most + 1)).alias(rank)).agg(F.count(F.lit(1)).alias("n"))


def charge_length_summary(annotations: DataFrame, charge: str = "charge", peptide: str = "peptide") -> DataFrame:
    """(kind, value, n): spectra by charge 1..7 and by peptide length 1..100, others in their own row."""
    known = F.col(peptide).isNotNull() & ~F.col(peptide).isin("", "UNKNOWN")
    length = F.length(peptide)
    kinds = F.array(
        F.struct(F.lit("charge").alias("kind"), F.when(F.col(charge).between(1, 7), F.col(charge).cast("string")).otherwise("other").alias("value")),
        F.struct(F.lit("length").alias("kind"), F.when(known & length.between(1, 100), length.cast("string")).otherwise("other").alias("value")),
    )
    return annotations.select(F.explode(kinds).alias("e")).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def agreement(first: DataFrame, second: DataFrame, key: str = "spec_id", peptide: str = "peptide") -> DataFrame:
    """One row: found by both with one peptide (I and L alike), by both with two, by either alone; recall, the share of the second's that the first has alike."""
    a = first.select(key, F.translate(peptide, "I", "L").alias("p1"))
    b = second.select(key, F.translate(peptide, "I", "L").alias("p2"))
    j = a.join(b, key, "full")
    return j.agg(
        F.count_if(F.col("p1") == F.col("p2")).alias("same"), F.count_if(F.col("p1") != F.col("p2")).alias("different"),
        F.count_if(F.col("p1").isNotNull() & F.col("p2").isNull()).alias("only_first"), F.count_if(F.col("p1").isNull() & F.col("p2").isNotNull()).alias("only_second"),
        F.try_divide(F.count_if(F.col("p1") == F.col("p2")), F.count("p2")).alias("recall"),
    )


def first_match_rank(neighbors: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank): rank of the first significant neighbour with the query's peptide. neighbors: (query_id, rank, peptide, significance)."""
    j = neighbors.where("significance = 1").join(truth.select("query_id", F.translate("peptide", "I", "L").alias("t")), "query_id")
    return j.where(F.translate("peptide", "I", "L") == F.col("t")).groupBy("query_id").agg(F.min("rank").alias("rank"))


def rank_recall(ranks: DataFrame, truth: DataFrame, most: int = 1) -> DataFrame:
    """One row: how many of truth (query_id, ...) have a first match (query_id, rank), how many at rank ``most`` or before, and both shares."""
    j = truth.select("query_id").distinct().join(ranks.select("query_id", "rank"), "query_id", "left")
    n, found, early = F.count(F.lit(1)), F.count("rank"), F.count_if(F.col("rank") <= most)
    return j.agg(n.alias("n"), found.alias("found"), early.alias("early"), F.try_divide(found, n).alias("recall"), F.try_divide(early, n).alias("early_recall"))


def generalised_mean(values: DataFrame, column: str, power: float) -> DataFrame:
    """One row: (mean of x ** power) ** (1 / power); power 0 is the geometric mean."""
    x = F.col(column).cast("double")
    return values.agg((F.exp(F.avg(F.log(x))) if power == 0 else F.pow(F.avg(F.pow(x, F.lit(float(power)))), F.lit(1.0 / power))).alias("mean"))


def means(values: DataFrame, column: str) -> DataFrame:
    """One row of averages; zeros are put right to the least positive value over n for the geometric and harmonic ones."""
    x = F.col(column).cast("double")
    base = values.agg(F.min(F.when(x > 0, x)).alias("__least"), F.count(x).alias("__n"))
    y = F.when(x == 0, F.col("__least") / F.col("__n")).otherwise(x)
    return values.select(x.alias(column)).crossJoin(F.broadcast(base)).agg(  # one row
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.exp(F.avg(F.log(y))).alias("geometric"), (1 / F.avg(1 / y)).alias("harmonic"),
        F.sqrt(F.avg(x * x)).alias("quadratic"), F.pow(F.avg(x * x * x), F.lit(1 / 3)).alias("cubic"),
    )


def fourth_power_std(values: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    m = values.agg(F.avg(x).alias("__m"))
    return values.select(x.alias(column)).crossJoin(F.broadcast(m)).agg(F.pow(F.avg((F.col(column) - F.col("__m")) ** 4), F.lit(0.25)).alias("std4"))


def merged_matrices(a: DataFrame, b: DataFrame, how: str = "harmonic") -> DataFrame:
    """(i, j, x) of matrices (i, j, x) merged cell by cell."""
    y = F.col("y")
    value = 2 * F.col("x") * y / (F.col("x") + y) if how == "harmonic" else F.sqrt(F.col("x") * y)
    return a.join(b.withColumnRenamed("x", "y"), ["i", "j"]).select("i", "j", value.alias("x"))


# --- mixtures --------------------------------------------------------------------------


def em_mixture(scores: np.ndarray, kind: str = "gaussian", steps: int = 200) -> dict:
    """Two components fitted to a bounded array of scores: gaussian, gumbel or gamma (by moments in each step)."""
    x = np.asarray(scores, dtype=float)
    x = np.maximum(x, 1e-9) if kind == "gamma" else x
    share = np.where(x > np.median(x), 0.9, 0.1)

    def fitted(w):
        m = (w * x).sum() / w.sum()
        v = max((w * (x - m) ** 2).sum() / w.sum(), 1e-9)
        if kind == "gaussian":
            return m, v, lambda z: np.exp(-((z - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
        if kind == "gumbel":
            beta = np.sqrt(6 * v) / np.pi
            mu = m - 0.5772156649 * beta
            return mu, beta, lambda z: np.exp(-(z - mu) / beta - np.exp(-(z - mu) / beta)) / beta
        shape, scale = m * m / v, v / m
        from math import lgamma

        return shape, scale, lambda z: np.exp((shape - 1) * np.log(z) - z / scale - lgamma(shape) - shape * np.log(scale))

    for _ in range(steps):
        pi = share.mean()
        low, high = fitted(1 - share + 1e-12), fitted(share + 1e-12)
        a, b = (1 - pi) * low[2](x), pi * high[2](x)
        new = b / np.maximum(a + b, 1e-300)
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    grid = np.linspace(x.min(), x.max(), 1000)
    a, b = (1 - pi) * low[2](grid), pi * high[2](grid)
    pep = a / np.maximum(a + b, 1e-300)
    tail_a, tail_b = np.cumsum(a[::-1])[::-1], np.cumsum(b[::-1])[::-1]
    return {"weight": float(pi), "low": low[:2], "high": high[:2], "grid": grid, "pep": pep, "fdr": tail_a / np.maximum(tail_a + tail_b, 1e-300)}
