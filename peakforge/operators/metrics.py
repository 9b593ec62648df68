"""Similarities of sparse vectors (id, slot, x); pairs are rows (a, b)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import allpairs
from .joins import meet


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, x, y) of slots that both have; equality join by slot."""
    return meet(left.select(F.col("spec_id").alias("a"), "slot", "x"), right.select(F.col("spec_id").alias("b"), "slot", F.col("x").alias("y")), "slot", "b")


def _totals(vectors: DataFrame, *aggregates) -> DataFrame:
    return vectors.groupBy("spec_id").agg(*aggregates)


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def cosine(left: DataFrame, right: DataFrame, members: tuple | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, similarity) of pairs that share a slot. members: see allpairs.similarities; digits: rounded to so many, once a pair of classes."""
    of = F.col("dot") / (F.sqrt("a_q") * F.sqrt("b_q"))
    return allpairs.similarities(left, right, {"dot": np.multiply}, {"q": np.square}, _rounded(of, digits), members)


def pearson(left: DataFrame, right: DataFrame, slots: int, members: tuple | None = None, digits: int | None = None) -> DataFrame:
    """Correlation over all slots (absent ones are 0), moved to 0..1."""
    n = float(slots)
    r = (n * F.col("dot") - F.col("a_s") * F.col("b_s")) / (F.sqrt(n * F.col("a_q") - F.col("a_s") ** 2) * F.sqrt(n * F.col("b_q") - F.col("b_s") ** 2))
    return allpairs.similarities(left, right, {"dot": np.multiply}, {"s": np.positive, "q": np.square}, _rounded((r + 1) / 2, digits), members)


def p_norm(left: DataFrame, right: DataFrame, p: float = 2.0, members: tuple | None = None, digits: int | None = None) -> DataFrame:
    """1 - |x - y| / (|x| + |y|) in the p-norm, p at least 1, of pairs that share a slot; p of 0 and -1 see _mean_norm.

    Slots of only one side come in by the totals: nothing but shared slots is met.
    """
    if p in (0, -1):
        return _mean_norm(left, right, p, members, digits)
    if p < 1:
        raise ValueError("p must be 1 or more, or 0 or -1")
    power = lambda x: np.abs(x) ** float(p)
    root = lambda c: F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / p))
    of = 1 - root(F.col("d") + F.col("a_t") + F.col("b_t")) / (root(F.col("a_t")) + root(F.col("b_t")))
    return allpairs.similarities(left, right, {"d": lambda x, y: power(x - y) - power(x) - power(y)}, {"t": power}, _rounded(of, digits), members)


def _mean_norm(left: DataFrame, right: DataFrame, p: float, members: tuple | None, digits: int | None) -> DataFrame:
    """As p_norm with the geometric (p = 0) or harmonic (p = -1) mean of absolute values over shared slots, where zeros make either 0."""

    def part(x: np.ndarray) -> np.ndarray:
        size = np.where(x == 0, 1.0, np.abs(x))
        return np.log(size) if p == 0 else 1 / size

    def mean(c: str) -> Column:
        avg = F.col(c) / F.col("shared")
        return F.when(F.col(f"{c}0") > 0, 0.0).otherwise(F.exp(avg) if p == 0 else F.try_divide(F.lit(1.0), avg))

    cells = {}
    for name, f in (("d", np.subtract), ("n", lambda x, y: x), ("m", lambda x, y: y)):
        cells[name] = lambda x, y, f=f: part(f(x, y))
        cells[f"{name}0"] = lambda x, y, f=f: f(x, y) == 0
    of = 1 - F.coalesce(F.try_divide(mean("d"), mean("n") + mean("m")), F.lit(0.0))
    return allpairs.similarities(left, right, cells, {}, _rounded(of, digits), members)


def jaccard(left: DataFrame, right: DataFrame, members: tuple | None = None, digits: int | None = None) -> DataFrame:
    """Shared slots over all slots."""
    of = F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared"))
    return allpairs.similarities(left, right, {}, {"n": np.ones_like}, _rounded(of, digits), members)


def jensen_shannon(left: DataFrame, right: DataFrame) -> DataFrame:
    """1 less the divergence of the vectors as distributions, natural log: 1 if equal, 1 - ln 2 without shared slots."""
    own = []
    for v in (left, right):
        total = _totals(v, F.sum("x").alias("t"))
        own.append(v.join(total, "spec_id").select("spec_id", "slot", (F.col("x") / F.col("t")).alias("x")))
    x, y = F.col("x"), F.col("y")
    # a slot of one side alone adds x ln 2 / 2; a shared slot is put right for both sides
    m = (x + y) / 2
    gain = (x * F.log(x / m) + y * F.log(y / m) - (x + y) * F.log(F.lit(2.0))) / 2
    return _shared(*own).groupBy("a", "b").agg((1 - (F.log(F.lit(2.0)) + F.sum(gain))).alias("similarity"))


def banded(pairs: DataFrame, band: int) -> DataFrame:
    """Pairs whose ids differ by no more than the band."""
    return pairs.where(F.abs(F.col("a") - F.col("b")) <= band)


def random_projection(vectors: DataFrame, width: int, seed: int = 1) -> DataFrame:
    """(spec_id, slot, x): projections on random signs that a hash of (slot, axis) gives; no matrix is sent."""
    sign = F.when(F.pmod(F.xxhash64("slot", "axis", F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    each = vectors.withColumn("axis", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return each.groupBy("spec_id", F.col("axis").alias("slot")).agg((F.sum(F.col("x") * sign) / F.sqrt(F.lit(float(width)))).alias("x"))


def scan_deviation(peaks: DataFrame, tolerance: float) -> DataFrame:
    """(n, mean, std) of m/z differences to the nearest peak of the next scan, of two the lower. peaks: (scan_no, mz), scan_no dense.

    A scan meets the next one as one sorted array each, so no pair of peaks is a row.
    """
    scans = peaks.groupBy("scan_no").agg(F.sort_array(F.collect_set("mz")).alias("mz"))
    both = scans.join(scans.select((F.col("scan_no") - 1).alias("scan_no"), F.col("mz").alias("next")), "scan_no").select("mz", "next")

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for own, then in zip(batch.column("mz"), batch.column("next")):
                own, then = own.values.to_numpy(), then.values.to_numpy()
                at = np.searchsorted(then, own)
                below, above = own - then[np.maximum(at - 1, 0)], then[np.minimum(at, len(then) - 1)] - own
                below, above = np.where(at > 0, below, np.inf), np.where(at < len(then), above, np.inf)
                d = np.where(below <= above, -below, above)
                out.append(d[np.abs(d) <= tolerance])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["d"])

    near = both.where("size(mz) > 0 and size(next) > 0").mapInArrow(run, "d double")
    return near.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
