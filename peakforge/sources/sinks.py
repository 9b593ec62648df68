"""Writers of peaks, tables, reports and graphs."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import MAX_PEAKS


def write_store(df: DataFrame, path: str, mode: str = "append", partition_by: str | None = None) -> None:
    """Parquet; a write either commits whole or not at all."""
    w = df.write.mode(mode)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of our own on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def write_compact(encoded: DataFrame, path: str, bins: str = "bins", rows: int = 10_000) -> None:
    """One file of 50 16-bit numbers a spectrum, in the order of spec_id.

    Records are made where the peaks are, and go to the file, on whatever file
    system the path names, a partition at a time: the format is one file.
    """

    def run(batches):
        for pdf in batches:
            x = np.zeros((len(pdf), MAX_PEAKS), dtype="<u2")
            for k, own in enumerate(pdf[bins]):
                x[k, : min(MAX_PEAKS, len(own))] = own[:MAX_PEAKS]
            for at in range(0, len(x), rows):
                yield pd.DataFrame({"data": [x[at : at + rows].tobytes()]})

    spark = encoded.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for r in encoded.orderBy("spec_id").select(bins).mapInPandas(run, "data binary").toLocalIterator():
            out.write(bytearray(r[0]))
    finally:
        out.close()


def write_neighbor_lists(neighbors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The k-NN graph: (id, neighbors) with an array of ids, the nearest first, of (query_id, idx, rank)."""
    lists = neighbors.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda x: x["idx"]).alias("neighbors"))  # topn at most
    lists.write.mode(mode).parquet(path)


def read_neighbor_lists(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, idx, rank) of a k-NN graph."""
    return spark.read.parquet(path).select(F.col("id").alias("query_id"), F.posexplode("neighbors").alias("p", "idx")).select("query_id", "idx", (F.col("p") + 1).alias("rank"))


def quality_report(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The validation table: (query_id, peptide, rank), rank the first neighbour of the other engine's peptide, null if none."""
    return truth.select("query_id", "peptide").join(found.select("query_id", "rank"), "query_id", "left")


def p_value_dump(p_values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line a hit: query, hit, p-value and its spread over seeds."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("query_id", "idx", "p", "p_std")])
    p_values.select(line.alias("value")).write.mode(mode).text(path)


def batch_report(neighbors: DataFrame, annotations: DataFrame, only_significant: bool = True) -> DataFrame:
    """Rows of a batch search: one a hit, with the annotation of the hit. neighbors: (query_id, rank, idx, dist, p, p_std, score)."""
    a = annotations.select(F.col("id").alias("idx"), "peptide", "protein", "iprophetprob", "peptideprophetprob", "significance", "precursor", "charge", "modification")
    j = neighbors.join(a, "idx", "left")
    j = j.where("significance = 1") if only_significant else j
    return j.select(
        F.col("query_id").alias("QueryId"), F.col("rank").alias("HitRank"), F.col("idx").alias("HitId"), F.col("dist").alias("HitL2dist"), F.col("p").alias("p-value"), F.col("p_std").alias("STD"),
        F.col("score").alias("Score"), F.col("idx").alias("GtIdx"), F.col("peptide").alias("Gt peptide"), "protein", F.col("iprophetprob").alias("iProb"), F.col("peptideprophetprob").alias("pProb"),
        "significance", F.col("precursor").alias("parentMass"), "charge", "modification",
    )


def wide_report(report: DataFrame) -> DataFrame:
    """One line a query: its hits, in order of rank, one after the other; a query has at most topn hits."""
    rest = [c for c in report.columns if c not in ("QueryId",)]
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")) for c in rest])
    hits = F.array_sort(F.collect_list(F.struct(F.col("HitRank").alias("r"), line.alias("line"))))
    return report.groupBy("QueryId").agg(F.array_join(F.transform(hits, lambda h: h["line"]), "\t").alias("hits"))


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str, column: str = "json", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def combined_scans(scans: DataFrame) -> DataFrame:
    """(file_id, last): the running number of the last spectrum of each file."""
    per_file = scans.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return per_file.select("file_id", (F.sum("n").over(W.orderBy("file_id").rowsBetween(W.unboundedPreceding, 0)) - 1).alias("last"))


def rows_as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
