"""From raw peaks to ranked, binned peaks and vectors.

Raw spectra are rows (spec_id, precursor_mz, charge, peaks), peaks an array of
(mz, intensity); encoded ones are long rows (spec_id, rank, bin, w). Rules whose
result depends on the order in which peaks are visited run in one Arrow function
a spectrum; the others are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import BINS, DUMMY_MZ, ISOTOPE, MAX_MZ, MAX_PEAKS, PROTON, VECTOR_BINS, VECTOR_DIMS, VECTOR_WIDTH

PEAKS = "array<struct<mz:double,intensity:double>>"


def tolerance_to_mz(tolerance: Column | int) -> Column:
    return F.lit(tolerance) * MAX_MZ / BINS


def mz_to_bin(mz: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(mz / MAX_MZ * BINS)).cast("int")


def bin_to_mz(b: Column) -> Column:
    return b / float(BINS) * MAX_MZ


# --- filters on the array of raw peaks ------------------------------------------------


def by_intensity(peaks: Column) -> Column:
    """Peaks, the most intense first; ties by m/z."""
    keyed = F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("k"), p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    return F.transform(F.sort_array(keyed), lambda p: F.struct(p["mz"], p["intensity"]))


def in_precursor_window(mz: Column, precursor: Column, double: Column | None = None) -> Column:
    """Whether a peak is near the precursor or near its doubled m/z (by default that of the singly charged ion)."""
    double = 2 * precursor - PROTON if double is None else double
    near = lambda c: (mz > c - 17) & (mz < c + 3)
    return F.coalesce(near(precursor) | near(double), F.lit(False))


def is_reporter(mz: Column) -> Column:
    return (mz > 125) & (mz < 136)


def is_immonium(mz: Column) -> Column:
    return mz < 160


def low_intensity_cut(peaks: Column, precursor: Column, remove_precursor: bool = True, share: float = 0.02) -> Column:
    """2 % of the second most intense of the peaks that count; 0 if fewer than two do. The doubled window is about twice the precursor's m/z here."""
    counted = F.filter(
        peaks,
        lambda p: ~is_reporter(p["mz"]) & ~is_immonium(p["mz"]) & (~in_precursor_window(p["mz"], precursor, 2 * precursor) if remove_precursor else F.lit(True)),
    )
    ordered = F.sort_array(F.transform(counted, lambda p: p["intensity"]), asc=False)
    return F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0)) * share


def between(peaks: Column, left: float, right: float) -> Column:
    """Peaks in [left, right)."""
    return F.filter(peaks, lambda p: (p["mz"] >= left) & (p["mz"] < right))


def without(peaks: Column, left: float, right: float) -> Column:
    """Peaks outside [left, right]."""
    return F.filter(peaks, lambda p: ~p["mz"].between(left, right))


def most_intense(peaks: Column, n: int) -> Column:
    return F.slice(by_intensity(peaks), 1, n)


def rank_as_intensity(peaks: Column, n: int = MAX_PEAKS) -> Column:
    """Peaks with intensities n, n - 1, ... by rank, 0 at least."""
    return F.transform(by_intensity(peaks), lambda p, i: F.struct(p["mz"], F.greatest(F.lit(n) - i, F.lit(0)).cast("double").alias("intensity")))


def sum_normalised(peaks: Column) -> Column:
    total = F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"])
    return F.transform(F.array(total), lambda s: F.transform(peaks, lambda p: F.struct(p["mz"], F.when(s != 0, p["intensity"] / s).otherwise(0.0).alias("intensity"))))[0]


def shifted_concat(*lists: Column) -> Column:
    """Peak lists one after another, the k-th moved up by 2000 k."""

    def moved(x: Column, by: float) -> Column:
        return F.transform(x, lambda p: F.struct((p["mz"] + by).alias("mz"), p["intensity"].alias("intensity")))

    return F.concat(*[moved(x, MAX_MZ * k) for k, x in enumerate(lists)])


# --- rules that visit peaks in order ---------------------------------------------------


def isotope_followers(mz: np.ndarray, intensity: np.ndarray, ppm: float = 20.0, most: int = 3) -> np.ndarray:
    """Which peaks follow a more intense peak at isotope spacing, for charges 1 to 7; mz ascending.

    Of the peaks within the tolerance (of the first peak's m/z, open below) the most intense is the follower, and a charge's series ends where there is none.
    """
    flagged = np.zeros(len(mz), dtype=bool)
    for i in range(len(mz)):
        if flagged[i]:
            continue
        width = mz[i] * ppm * 1e-6
        for z in range(1, 8):
            for k in range(1, most + 1):
                target = mz[i] + k * ISOTOPE / z
                lo, hi = np.searchsorted(mz, [target - width, target + width], side="right")
                if lo >= hi:
                    break
                j = lo + int(np.argmax(intensity[lo:hi]))
                if intensity[j] < intensity[i]:
                    flagged[j] = True
    return flagged


def weak_in_window(mz: np.ndarray, intensity: np.ndarray, most: int = 6, width: float = 100.0) -> np.ndarray:
    """Which peaks fall out when a window of ``width`` moves over them and keeps the ``most`` strongest; mz ascending."""
    dropped, live = np.zeros(len(mz), dtype=bool), []
    for i in range(len(mz)):
        live.append(i)
        if len(live) > most:
            live = [j for j in live if mz[j] > mz[i] - width]
            if len(live) > most:
                weakest = min(live, key=lambda j: (intensity[j], j))
                dropped[weakest] = True
                live.remove(weakest)
    return dropped


def local_maximum(mz: np.ndarray, intensity: np.ndarray, width: float) -> np.ndarray:
    """Which peaks are the greatest within (mz - width, mz + width], of equal ones the first; mz ascending."""
    lo, hi = np.searchsorted(mz, mz - width, side="right"), np.searchsorted(mz, mz + width, side="right")
    return np.array([a + int(np.argmax(intensity[a:b])) == i for i, (a, b) in enumerate(zip(lo, hi))], dtype=bool)


def preprocess(
    spectra: DataFrame, remove_precursor: bool = True, remove_reporter: bool = True, remove_immonium: bool = True, deisotope: bool = True, tolerance: int = 15, sliding: bool = True
) -> DataFrame:
    """spectra with peaks cleaned; every rule looks at the spectrum as it came."""
    width = tolerance * MAX_MZ / BINS * 2

    @F.pandas_udf("array<boolean>")
    def visited(mz: pd.Series, intensity: pd.Series) -> pd.Series:
        out = []
        for m, i in zip(mz, intensity):
            m, i = np.asarray(m, dtype=float), np.asarray(i, dtype=float)
            order = np.argsort(m, kind="stable")
            keep = np.ones(len(m), dtype=bool)
            if len(m):
                own = local_maximum(m[order], i[order], width)
                if deisotope:
                    own &= ~isotope_followers(m[order], i[order])
                if sliding:
                    own &= ~weak_in_window(m[order], i[order])
                keep[order] = own
            out.append(keep)
        return pd.Series(out)

    peaks, precursor = F.col("peaks"), F.col("precursor_mz")
    ok = visited(F.transform(peaks, lambda p: p["mz"]), F.transform(peaks, lambda p: p["intensity"]))
    staged = spectra.withColumn("__ok", ok).withColumn("__cut", low_intensity_cut(peaks, precursor, remove_precursor))
    kept = F.filter(
        F.zip_with("peaks", "__ok", lambda p, k: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"), k.alias("k"))),
        lambda p: (
            p["k"]
            & (p["intensity"] >= F.col("__cut"))
            & (p["mz"] <= MAX_MZ)
            & (~in_precursor_window(p["mz"], precursor) if remove_precursor else F.lit(True))
            & (~is_reporter(p["mz"]) if remove_reporter else F.lit(True))
            & (~is_immonium(p["mz"]) if remove_immonium else F.lit(True))
        ),
    )
    return staged.withColumn("peaks", F.transform(kept, lambda p: F.struct(p["mz"], p["intensity"]))).drop("__ok", "__cut")


# --- the compact form --------------------------------------------------------------------


def compact(peaks: Column, min_peaks: int = 6) -> Column:
    """Array of at most 50 bins by intensity; spectra of few peaks are one dummy peak."""
    dummy = F.array(mz_to_bin(F.lit(DUMMY_MZ)))
    return F.when(F.size(peaks) <= min_peaks, dummy).otherwise(F.transform(most_intense(peaks, MAX_PEAKS), lambda p: mz_to_bin(p["mz"])))


def long_peaks(encoded: DataFrame, bins: str = "bins", id_col: str = "spec_id") -> DataFrame:
    """(spec_id, rank, bin, w) of arrays of bins; the first bin 0 ends a list."""
    end = F.array_position(bins, F.lit(0))
    own = F.when(end > 0, F.slice(bins, 1, (end - 1).cast("int"))).otherwise(F.col(bins))
    return encoded.select(id_col, F.posexplode(own).alias("p", "bin")).select(id_col, (F.col("p") + 1).alias("rank"), "bin", (MAX_PEAKS - F.col("p")).alias("w"))


def to_compact(peaks: DataFrame, id_col: str = "spec_id") -> DataFrame:
    """Arrays of bins of long peaks; a spectrum has 50 peaks at most, so groups are small."""
    return peaks.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "bin"))), lambda x: x["bin"]).alias("bins"))


def ranked(raw: DataFrame, id_col: str = "spec_id", bin_col: str = "bin", intensity: str = "intensity", ties: tuple[str, ...] = ()) -> DataFrame:
    """Long peaks of rows (spec_id, bin, intensity): the 50 most intense, weight 50 and down."""
    order = W.partitionBy(id_col).orderBy(F.col(intensity).desc(), *ties)
    return raw.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_PEAKS).select(id_col, "rank", bin_col, (MAX_PEAKS + 1 - F.col("rank")).alias("w"))


def local_maxima(peaks: DataFrame, reach: int, id_col: str = "spec_id") -> DataFrame:
    """Long peaks without those that have a heavier one of the spectrum within ``reach`` bins; weights stay."""
    near = W.partitionBy(id_col).orderBy("bin").rangeBetween(-reach, reach)
    return peaks.withColumn("__top", F.max("w").over(near)).where("w = __top").drop("__top")


def norms(peaks: DataFrame, id_col: str = "spec_id") -> DataFrame:
    """(spec_id, n_peaks, norm2) of long peaks."""
    return peaks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_peaks"), F.sum(F.col("w") * F.col("w")).cast("bigint").alias("norm2"))


# --- vectors -----------------------------------------------------------------------------


def binned(peaks: DataFrame, position: Column, weight: Column, id_col: str = "spec_id", bins: int = VECTOR_BINS, flank: bool = True) -> DataFrame:
    """Sparse vectors (spec_id, slot, x): weight to the slot and, if flank, half to either neighbour; beyond the end the last slot gets it."""
    at = F.least(position.cast("int"), F.lit(bins - 1))
    parts = [F.struct(at.alias("slot"), weight.cast("double").alias("x"))]
    if flank:
        parts += [F.struct((at + d).alias("slot"), (weight / 2.0).alias("x")) for d in (-1, 1)]
    rows = peaks.select(id_col, F.explode(F.array(*parts)).alias("e")).select(id_col, "e.slot", "e.x").where(F.col("slot").between(0, bins - 1))
    return rows.groupBy(id_col, "slot").agg(F.sum("x").alias("x"))


def binned_mz(peaks: DataFrame, id_col: str = "spec_id", flank: bool = True) -> DataFrame:
    """Vectors of half-Thomson slots of long peaks."""
    return binned(peaks, F.floor(bin_to_mz(F.col("bin")) / VECTOR_WIDTH), F.col("w"), id_col, VECTOR_BINS, flank)


def l2_normalised(vectors: DataFrame, id_col: str = "spec_id") -> DataFrame:
    """Vectors of length 1; those whose square sum is 1e-8 or less stay."""
    total = F.sum(F.col("x") * F.col("x")).over(W.partitionBy(id_col))
    return vectors.withColumn("__s", total).withColumn("x", F.when(F.col("__s") > 1e-8, F.col("x") / F.sqrt("__s")).otherwise(F.col("x"))).drop("__s")


def dense(cells: Column, dims: int = VECTOR_DIMS) -> Column:
    """An array of ``dims`` numbers of an array of (slot, x); absent slots are 0."""

    @F.pandas_udf("array<float>")
    def filled(cells: pd.Series) -> pd.Series:
        out = []
        for own in cells:
            v = np.zeros(dims, dtype=np.float32)
            for c in own:
                v[c["slot"]] = c["x"]
            out.append(v)
        return pd.Series(out)

    return filled(cells)


def vector_filter(vectors: DataFrame, chain: str, id_col: str = "spec_id") -> DataFrame:
    """Applies filters named in ``chain``, joined by ``+``: PeakSquareRoot, PeakToProb, NormalizeByMax (which divides by the sum, as ever), AboveMean, AboveMedian, TopN, Dummy."""
    own = W.partitionBy(id_col)
    for name in chain.split("+"):
        if name == "PeakSquareRoot":
            vectors = vectors.withColumn("x", F.sqrt("x"))
        elif name in ("PeakToProb", "NormalizeByMax"):
            vectors = vectors.withColumn("x", F.col("x") / F.sum("x").over(own))
        elif name == "AboveMean":  # subtracts the mean
            vectors = vectors.withColumn("x", F.col("x") - F.avg("x").over(own)).where("x > 0")
        elif name == "AboveMedian":
            base = F.when(F.count(F.lit(1)).over(own) >= 40, F.percentile("x", F.lit(0.5)).over(own)).otherwise(0.0)
            vectors = vectors.withColumn("x", F.col("x") - base).where("x > 0")
        elif name.startswith("Top"):
            order = own.orderBy(F.col("x").desc(), "slot")
            vectors = (
                vectors.withColumn("__k", F.row_number().over(order))
                .withColumn("__n", F.max(F.when(F.col("__k") == int(name[3:]), F.col("x"))).over(own))
                .where("__n is null or x > __n")
                .drop("__k", "__n")
            )
        elif name not in ("", "Dummy"):
            raise ValueError(name)
    return vectors


def peak_count_histogram(peaks: DataFrame, id_col: str = "spec_id") -> DataFrame:
    return norms(peaks, id_col).groupBy("n_peaks").agg(F.count(F.lit(1)).alias("n_spectra"))
