"""The annotation tables as DataFrames: lookups, searches, updates, block lists.

``ground_truth`` has a row a spectrum, ``spec_files`` one a file with its id range
[start, end), ``remarks`` free notes, ``tnn`` stored true neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Schemas of the tables.
GROUND_TRUTH = (
    "id bigint, file_id int, ms2counts int, peptide string, score double, scan int, cterm double, nterm double, modification string, precursor double, charge int, rt double, "
    "peptideprophetprob double, iprophetprob double, rfscore double, isdecoy int, significance int, protein string, ce string, alterpeptide string, "
    "neighbor array<struct<dist:double,idx:bigint>>, rescuedpeptide string"
)
SPEC_FILES = "file_id int, filename string, start bigint, end bigint"
GT_FILES = "file_id int, filename string"
REMARKS = "id bigint, spec_id bigint, remarks string"
TNN = "query_id bigint, topk int, mindp double, indexnum int, archivesize bigint, nprobe int, date timestamp, tnn array<struct<idx:bigint,score:int>>"


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of the schema that it lacks, as nulls (older tables)."""
    have = {c.lower() for c in df.columns}
    for field in df.sparkSession.createDataFrame([], schema).schema:
        if field.name.lower() not in have:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df


def file_ranges(files: DataFrame, start: int = 0, first_id: int = 0) -> DataFrame:
    """spec_files of (file_id, filename, n): ranges follow one another in the order of file_id."""
    upto = W.orderBy("file_id").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("n").over(upto) + start
    return files.select((F.col("file_id") + first_id).alias("file_id"), "filename", (end - F.col("n")).alias("start"), end.alias("end"))


def total_spectra(spec_files: DataFrame) -> DataFrame:
    return spec_files.agg(F.coalesce(F.max_by("end", "file_id"), F.lit(0)).alias("total"), F.max("file_id").alias("last_file"), F.count(F.lit(1)).alias("n_files"))


def by_id(ground_truth: DataFrame, ids: DataFrame, spec_files: DataFrame) -> DataFrame:
    """Annotations of many ids with their file names: one join instead of a lookup an id."""
    return ground_truth.join(ids.select("id").distinct(), "id", "left_semi").join(spec_files.select("file_id", "filename"), "file_id", "left")


def file_of(ids: DataFrame, spec_files: DataFrame, block: int = 1 << 14) -> DataFrame:
    """ids with the file whose range holds them.

    An equality join by block of ids: a file stands in each block that its range
    touches, so files are repeated by their spectra over the block size, at most once more than that.
    """
    files = spec_files.where("start < end").withColumn("__k", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    return ids.withColumn("__k", F.floor(F.col("id") / block)).join(files, "__k").where("id >= start and id < end").drop("__k")


def files_ending(spec_files: DataFrame, suffix: str, limit: int = 10) -> DataFrame:
    return spec_files.where(F.col("filename").endswith(suffix)).orderBy("file_id").limit(limit)


def files_containing(spec_files: DataFrame, part: str, limit: int = 10) -> DataFrame:
    return spec_files.where(F.col("filename").contains(part)).orderBy("file_id").limit(limit)


def search_scan(ground_truth: DataFrame, spec_files: DataFrame, name: str, first: int, last: int, a_file: int = 100, limit: int = 100) -> DataFrame:
    """Annotations of scans first..last in files whose name contains ``name``; so many a file and in all."""
    files = files_containing(spec_files, name).select("file_id", "filename", "start", "end")
    rows = ground_truth.where(F.col("scan").between(first, last)).join(files, "file_id").where("id >= start and id < end")
    order = W.partitionBy("file_id").orderBy("id")
    rows = rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= a_file).drop("__k", "start", "end")
    return rows.orderBy("file_id", "id").limit(limit)


def search_peptide(ground_truth: DataFrame, spec_files: DataFrame, peptide: str, limit: int = 10) -> DataFrame:
    found = ground_truth.where(F.col("peptide") == peptide).orderBy("id").limit(limit)
    return found.join(spec_files.select("file_id", "filename"), "file_id", "left")


def in_search_space(peptides: DataFrame, ground_truth: DataFrame, excluded_files: DataFrame) -> DataFrame:
    """peptides with whether a significant annotation outside the excluded files has them."""
    known = ground_truth.where("significance = 1").join(excluded_files.select("file_id"), "file_id", "left_anti").select("peptide").distinct().withColumn("known", F.lit(True))
    return peptides.join(known, "peptide", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def ending_at(spec_files: DataFrame, end: int) -> DataFrame:
    """Files whose range ends at an id."""
    return spec_files.where(F.col("end") == end)


def without_charge(ground_truth: DataFrame) -> DataFrame:
    """Annotated spectra with charge 0."""
    known = F.col("peptide").isNotNull() & ~F.col("peptide").isin("", "UNKNOWN")
    return ground_truth.where((F.col("charge") == 0) & known)


def with_energy(ground_truth: DataFrame) -> DataFrame:
    return ground_truth.where("ce is not null and ce <> ''")


def block_list_energy(ground_truth: DataFrame, target: float = 35.0) -> DataFrame:
    """(idx): of consecutive spectra of one peptide and charge all but the first nearest to the target energy.

    Runs are found within blocks of ids, so no partition holds all rows: a run is
    cut where peptide or charge change from one row to the next.
    """
    energy = F.when(F.length("ce") > 2, F.expr("try_cast(substring(ce, 1, length(ce) - 2) as double)")).otherwise(0.0)
    rows = with_energy(ground_truth).select("id", "file_id", "peptide", "charge", F.coalesce(energy, F.lit(0.0)).alias("energy"))
    order = W.partitionBy("file_id").orderBy("id")
    change = F.when((F.lag("peptide").over(order) == F.col("peptide")) & (F.lag("charge").over(order) == F.col("charge")), 0).otherwise(1)
    run = rows.withColumn("change", change).withColumn("run", F.sum("change").over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = W.partitionBy("file_id", "run").orderBy(F.abs(F.col("energy") - target), "id")
    return run.withColumn("k", F.row_number().over(best)).where("k > 1").select(F.col("id").alias("idx"))


def block_list_files(spec_files: DataFrame, ids: DataFrame, part: str) -> DataFrame:
    """(idx): the ids of all files whose name contains the part."""
    return file_of(ids, spec_files.where(F.col("filename").contains(part))).select(F.col("id").alias("idx"))


def updated(ground_truth: DataFrame, spec_files: DataFrame, updates: DataFrame) -> DataFrame:
    """ground_truth after updates (filename, scan, new columns...): the last basename must name exactly one file.

    Values of an update that are null leave the old ones. Of several updates of a
    scan the greatest score wins.
    """
    base = F.regexp_replace(F.regexp_extract("filename", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    own = spec_files.select("file_id", base.alias("base"))
    unique = own.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.first("file_id").alias("file_id")).where("n = 1")
    columns = [c for c in updates.columns if c not in ("filename", "scan")]
    first = [F.col("score").alias("__first")] if "score" in columns else []
    order = F.struct(*first, *columns)
    new = updates.select(base.alias("base"), "scan", *columns).join(unique.select("base", "file_id"), "base").groupBy("file_id", "scan").agg(F.max(order).alias("u"))
    j = ground_truth.join(new, ["file_id", "scan"], "left")
    return j.select(*[F.coalesce(F.col("u")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in ground_truth.columns])


def new_files(spec_files: DataFrame, files: DataFrame) -> DataFrame:
    """Files (filename, ...) that no known name ends with."""
    tail = F.regexp_extract("filename", r"([^/\\]*)$", 1)
    return files.withColumn("__t", tail).join(spec_files.select(tail.alias("__t")).distinct(), "__t", "left_anti").drop("__t")


def with_source(gt_files: DataFrame, path: str) -> DataFrame:
    """gt_files with the annotation source, if none of its basename is there."""
    tail = F.regexp_extract("filename", r"([^/\\]*)$", 1)
    row = gt_files.agg(F.coalesce(F.max("file_id") + 1, F.lit(0)).cast("int").alias("file_id")).select("file_id", F.lit(path).alias("filename"))
    new = row.withColumn("__t", tail).join(gt_files.select(tail.alias("__t")), "__t", "left_anti")  # one row against the list of sources
    return gt_files.unionByName(new.drop("__t"))


def without_last(table: DataFrame, spec_files: DataFrame, n: int) -> DataFrame:
    """table (with file_id) without the rows of the last n files."""
    limit = spec_files.agg((F.max("file_id") - n).alias("keep"))
    return table.join(F.broadcast(limit), F.col("file_id") <= F.col("keep")).drop("keep")  # one row


def files_to_remove(spec_files: DataFrame, size: int) -> DataFrame:
    """(n): how many of the last files must go so that no more than ``size`` spectra stay."""
    return spec_files.agg(F.count_if(F.col("end") > size).alias("n"))


def unencoded(ground_truth: DataFrame, encoded: DataFrame) -> DataFrame:
    """ids that have an annotation but no encoded peaks: what a repair must index again."""
    return ground_truth.select("id").join(encoded.select(F.col("spec_id").alias("id")).distinct(), "id", "left_anti")


def add_remark(remarks: DataFrame, spec_id: int, text: str) -> DataFrame:
    next_id = remarks.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("id"))
    return remarks.unionByName(next_id.select("id", F.lit(spec_id).cast("bigint").alias("spec_id"), F.lit(text).alias("remarks")))


def cached_neighbors(tnn: DataFrame, archive_size: int, topk: int, min_dp: float) -> DataFrame:
    """Stored true neighbours that serve the request: same archive, at least as many, at most as strict."""
    usable = tnn.where((F.col("archivesize") == archive_size) & (F.col("topk") >= topk) & (F.col("mindp") <= min_dp))
    newest = usable.groupBy("query_id").agg(F.max_by("tnn", F.struct(F.col("date"), F.col("topk"))).alias("tnn"))
    cut = F.filter("tnn", lambda x: x["score"] > int(min_dp * 42925))
    return newest.select("query_id", F.slice(cut, 1, topk).alias("tnn"))


def store_neighbors(ground_truth: DataFrame, neighbors: DataFrame) -> DataFrame:
    """ground_truth with the column neighbor of (query_id, idx, dist); few neighbours a query."""
    lists = neighbors.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dist", "idx"))).alias("__n"))
    base = ground_truth if "neighbor" in ground_truth.columns else ground_truth.withColumn("neighbor", F.lit(None).cast("array<struct<dist:double,idx:bigint>>"))
    return base.join(lists, "id", "left").withColumn("neighbor", F.coalesce("__n", "neighbor")).drop("__n")


# --- text tables --------------------------------------------------------------------------


def numbered(table: DataFrame, key: str, name: str = "__i") -> DataFrame:
    """table with the place of each row in the order of a key, from 0: sorted by range, numbered by partition sizes."""
    from pyspark.sql import types as T

    rows = table.orderBy(key).rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    return table.sparkSession.createDataFrame(rows, T.StructType([*table.schema.fields, T.StructField(name, T.LongType())]))


def joined_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of two tables side by side, in the order of a key each; the tables have equally many rows."""
    return numbered(left, left_key).join(numbered(right, right_key), "__i").drop("__i")


def first_by_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the first."""
    return table.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__k = 1").drop("__k")
