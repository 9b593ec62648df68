"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The characters that end a word for the whitespace word rule.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of one of the tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of our own on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage in a way that outlives lost executors, and lets several
    readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a staged df that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows; else Spark chooses the join."""
    return F.broadcast(df) if rows <= most else df


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone."""
    h = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 53) - 1))
    return (h.cast("double") + 0.5) / float(1 << 53)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def sampled_by_key(rows: DataFrame, key: str, id_col: str, most: int, seed: int) -> DataFrame:
    """rows (key, id, ...) less all but the ``most`` of each key whose ids have the smallest hashes.

    A limit from the keys' counts, with room for six standard deviations, leaves
    little more than that before rows are ordered, so a frequent key is no large group.
    """
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    h = uniform(F.col(id_col), F.lit(seed))
    near = rows.withColumn("__h", h).join(counts, F.col(key) == F.col("__key")).where(F.col("__h") * F.col("__n") <= most + 6 * most**0.5 + 20)
    order = W.partitionBy(key).orderBy("__h", id_col)
    return near.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k", "__h", "__n", "__key")


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Bytes of an Arrow batch. The memory that batches are built in lies beside the heap and is seldom given back.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Bounds the bytes of the Arrow batches of what is run meanwhile."""
    old = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, old)


def utf8(column):
    """The bytes of an Arrow text column, and where each row's bytes start (one more entry at the end); nulls are empty."""
    import numpy as np
    import pyarrow as pa

    values = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    if not len(values) or data is None:
        return b"", np.zeros(len(values) + 1, dtype=np.int64)
    return data[int(bounds[0]) : int(bounds[-1])].to_pybytes(), bounds - bounds[0]


def slices(batches, chars: int = 500_000, rows: int = 2_000, column: int = 1):
    """Arrow batches cut so that a slice has about so many bytes of text at most, but one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + chars, side="right"))))
            yield batch.slice(at, to - at)
            at = to
