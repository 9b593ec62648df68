"""Spectra, files and annotations as they are read out of the general tables.

A customer is a spectrum, its order lines are peaks, its nation is its file;
events are an MS1 series; embeddings are dense vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encode
from .sources.sinks import shared_folder

TOLERANCE = 1
#: The query set: every spectrum whose id is divisible by this.
QUERY_SET = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ("intensity", "l_linenumber", "bin")


def packed_line() -> Column:
    """An intensity of whole hundredths, a line number below 2^8 and a bin below 2^12 as one number; null if that would change any.

    Exchanges of lines are most of what a search writes to disk, and this takes a third off them.
    """
    x, fit = F.col("intensity"), F.col("intensity").between(0, 1e10) & F.col("l_linenumber").between(0, 255) & F.col("bin").between(0, 4095)
    cents = F.when(fit, F.round(x * 100).cast("bigint"))
    both = F.shiftleft(F.col("l_linenumber").cast("bigint"), 12).bitwiseOR(F.col("bin").cast("bigint"))
    return F.when(cents / F.lit(100.0) == x, F.shiftleft(cents, 20).bitwiseOR(both))


def unpacked_line() -> list[Column]:
    """The columns of LINE, of ``line`` or else of the struct ``whole``."""
    line = F.col("line")
    parts = (F.shiftright(line, 20) / F.lit(100.0), F.shiftright(line, 12).bitwiseAND(F.lit(255)).cast("int"), line.bitwiseAND(F.lit(4095)).cast("int"))
    return [F.coalesce(F.when(line.isNull(), F.col(f"whole.{name}")), part).alias(name) for name, part in zip(LINE, parts)]


def raw_peaks(spark, sf_dir) -> DataFrame:
    """(spec_id, bin, intensity, l_orderkey, l_linenumber), dealt by spec_id; on its way a line is one number, see packed_line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 2000).cast("int").alias("bin"), F.col("l_extendedprice").alias("intensity"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("spec_id"))
    small = lines.select("l_orderkey", packed_line().alias("line"), *LINE)
    small = small.select("line", "l_orderkey", F.when(F.col("line").isNull(), F.struct(*LINE)).alias("whole"))
    return small.join(orders, "l_orderkey").repartition("spec_id").select("spec_id", *unpacked_line(), "l_orderkey").select("spec_id", "bin", "intensity", "l_orderkey", "l_linenumber")


def peaks(spark, sf_dir) -> DataFrame:
    """(spec_id, rank, bin, w): the 50 most intense that are the heaviest within two bins.

    Written once a query, as an archive stores its peaks, since queries read them several times.
    """
    own = encode.local_maxima(encode.ranked(raw_peaks(spark, sf_dir), ties=("l_orderkey", "l_linenumber")), 2 * TOLERANCE)
    return stored(own, "peaks")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def queries_of(peaks: DataFrame) -> DataFrame:
    return peaks.where(F.col("spec_id") % QUERY_SET == 0).select(F.col("spec_id").alias("query_id"), "bin", "w")


def candidates_of(peaks: DataFrame) -> DataFrame:
    return peaks.select(F.col("spec_id").alias("idx"), "bin", "w")


def ground_truth(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("file_id"), F.col("c_mktsegment").alias("peptide"), F.col("c_custkey").cast("int").alias("scan"),
        (1 + F.col("c_custkey") % 4).cast("int").alias("charge"), F.col("c_acctbal").alias("score"), (F.col("c_acctbal") > 0).cast("int").alias("significance"),
        (F.col("c_custkey") % 10 == 0).cast("int").alias("isdecoy"), F.abs(F.col("c_acctbal") % 100).cast("int").alias("energy"),
    )


def spec_files(spark, sf_dir) -> DataFrame:
    """A file a nation: (file_id, filename, n)."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_id"), F.concat(F.lit("/data/"), "n_name", F.lit(".mzML")).alias("filename"))
    return n.join(names, "file_id")


def points(spark, sf_dir) -> DataFrame:
    """(scan, rt, mz, intensity, level) of events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("scan"), F.unix_seconds(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).cast("double").alias("rt"), F.col("user_id").cast("double").alias("mz"), F.col("value").alias("intensity"), F.col("event_type").alias("level"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), "label")
