"""Chromatograms and maps over retention time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import ISOTOPE


def chromatogram(targets: DataFrame, survey: DataFrame, peaks: DataFrame, tolerance: float, rt_tolerance: float) -> DataFrame:
    """(target_id, scan, rt, mz, intensity) of extracted ions.

    targets: (target_id, mz, rt); survey: the MS1 scans (scan, rt); peaks: their
    (scan, mz, intensity). Each survey scan within the RT window gives its most
    intense peak in (mz - tolerance, mz + tolerance], else 0. A target without a
    survey scan before it has no trace. Scans and targets meet by RT buckets, so
    each scan is compared with near targets only.
    """
    bucket = F.floor(F.col("rt") / rt_tolerance)
    t = targets.select("target_id", F.col("mz").alias("target_mz"), F.col("rt").alias("target_rt"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    near = survey.select("scan", "rt", bucket.alias("k")).join(t, "k").where((F.col("rt") > F.col("target_rt") - rt_tolerance) & (F.col("rt") < F.col("target_rt") + rt_tolerance)).drop("k")
    first = survey.agg(F.min("rt").alias("first"))
    near = near.join(F.broadcast(first), F.col("target_rt") >= F.col("first")).drop("first")  # one row
    met = near.join(peaks.select("scan", F.col("mz").alias("pmz"), "intensity"), "scan").where(
        (F.col("pmz") > F.col("target_mz") - tolerance) & (F.col("pmz") <= F.col("target_mz") + tolerance)
    )
    best = met.groupBy("target_id", "scan").agg(F.max(F.struct("intensity", "pmz")).alias("best"))
    return near.join(best, ["target_id", "scan"], "left").select(
        "target_id", "scan", "rt", F.coalesce("best.pmz", "target_mz").alias("mz"), F.coalesce("best.intensity", F.lit(0.0)).alias("intensity")
    )


def isotope_targets(targets: DataFrame, first: int = -1, last: int = 3) -> DataFrame:
    """targets (target_id, mz, charge, ...) once an isotope, with its number and shifted m/z."""
    each = targets.withColumn("isotope", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return each.withColumn("mz", F.col("mz") + F.col("isotope") * ISOTOPE / F.col("charge"))


def pixels(points: DataFrame, bounds: tuple[float, float, float, float] | None = None, size: int = 100) -> DataFrame:
    """(px, py, n, total, mean_mz, mean_rt, log_total) of points (rt, mz, intensity) on a grid; points on the far edge are in the last pixel."""
    if bounds is None:
        box = points.agg(F.min("rt").alias("r0"), F.max("rt").alias("r1"), F.min("mz").alias("m0"), F.max("mz").alias("m1"))
        points = points.crossJoin(F.broadcast(box))  # one row
    else:
        points = points.withColumns({k: F.lit(float(v)) for k, v in zip(("r0", "r1", "m0", "m1"), bounds)}).where("rt between r0 and r1 and mz between m0 and m1")

    def at(x: str, lo: str, hi: str) -> Column:
        width = F.col(hi) - F.col(lo)
        return F.least(F.lit(size - 1), F.floor((F.col(x) - F.col(lo)) / F.when(width > 0, width).otherwise(1.0) * size)).cast("int")

    keyed = points.select(at("rt", "r0", "r1").alias("px"), at("mz", "m0", "m1").alias("py"), "rt", "mz", "intensity")
    return keyed.groupBy("px", "py").agg(
        F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("total"), F.avg("mz").alias("mean_mz"), F.avg("rt").alias("mean_rt"), F.log(F.sum("intensity") + 1).alias("log_total")
    )


def swath(scans: DataFrame, current: int, cycle: int) -> DataFrame:
    """The scans of one window of a cycle."""
    return scans.where(F.pmod(F.col("scan") + cycle - current, F.lit(cycle)) == 0)


def swath_cycle(scans: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, cycle): scans from one MS1 scan to the next, by the second MS1 of each file."""
    order = W.partitionBy(key).orderBy("scan")
    second = scans.where("ms_level = 1").withColumn("k", F.row_number().over(order)).where("k = 2").select(key, F.col("scan").alias("second"))
    first = scans.groupBy(key).agg(F.min("scan").alias("first"))
    return second.join(first, key).select(key, (F.col("second") - F.col("first")).alias("cycle"))
