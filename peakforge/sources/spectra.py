"""Readers of spectra: MGF, sptxt, mzML, mzXML, scan lists, and compact peak files.

All give rows (file, scan, idx, ms_level, rt, precursor_mz, charge, name, protein,
ce, peaks), peaks an array of (mz, intensity). Text formats are split by their
record separator, so one large file is read by many tasks; an XML file is read by
one.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import MAX_PEAKS

SPECTRA = (
    "file string, scan int, idx bigint, ms_level int, rt double, precursor_mz double, charge int, name string, protein string, ce string, peaks array<struct<mz:double,intensity:double>>"
)
COLUMNS = [x.split()[0] for x in SPECTRA.split(", ")]
NUMBER = r"[-+0-9.eE]+"


def _peaks(body: Column, pattern: str) -> Column:
    mz, intensity = (F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def _in_order(spark: SparkSession, path: str, separator: str, wanted) -> DataFrame:
    """(file, value, idx): the wanted records of text files and their ordinals in their file.

    A block of a file is read whole by one task, in order, so a record's ordinal
    is its place in the block and the count of records in the file's earlier
    blocks. Only these counts are dealt out, the records stay where they are read.
    """
    rows = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = rows.where(wanted(F.col("value"))).withColumn("__id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    earlier = W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(blocks, ["file", "__block"]).select("file", "value", (F.col("__before") + F.col("__id") - F.col("__first")).alias("idx"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of MGF files; a scan is the second of four or more dotted parts of the title, else the ordinal from 1."""
    rows = _in_order(spark, path, "END IONS", lambda v: v.contains("BEGIN IONS"))
    body = F.regexp_replace(F.col("value"), r"(?m)^#.*$", "")
    rows = rows.withColumn("body", F.regexp_extract(body, r"(?s)BEGIN IONS(.*)", 1))
    get = lambda k, p: F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^{k}=({p})", 1)), F.lit(""))
    title = F.coalesce(get("TITLE", r"[^\r\n]*"), F.lit(""))
    parts = F.split(title, r"\.")
    dotted = F.when((F.size(parts) >= 4) & ~title.contains("/"), F.when(F.get(parts, F.lit(1)).rlike("^[0-9]{1,9}$"), F.get(parts, F.lit(1)).cast("int")))
    return rows.select(
        "file", F.coalesce(dotted, (F.col("idx") + 1).cast("int")).alias("scan"), "idx", F.lit(2).alias("ms_level"),
        get("RTINSECONDS", NUMBER).cast("double").alias("rt"), get("PEPMASS", NUMBER).cast("double").alias("precursor_mz"),
        F.coalesce(get("CHARGE", r"[0-9]+").cast("int"), F.lit(0)).alias("charge"), title.alias("name"), F.lit(None).cast("string").alias("protein"),
        F.lit(None).cast("string").alias("ce"), _peaks(F.col("body"), rf"(?m)^[ \t]*([0-9.]+(?:[eE][-+]?[0-9]+)?)[ \t]+({NUMBER})").alias("peaks"),
    )


def read_sptxt(spark: SparkSession, path: str) -> DataFrame:
    """Entries of spectral libraries; a scan is LibID + 1."""
    rows = _in_order(spark, path, "\n\n", lambda v: F.regexp_replace(v, r"(?m)^###.*\n?", "").rlike(r"(?m)^Name: "))
    rows = rows.withColumn("value", F.regexp_replace("value", r"(?m)^###.*\n?", ""))
    get = lambda k, p: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}: *({p})", 1)), F.lit(""))
    comment = F.coalesce(get("Comment", r"[^\r\n]*"), F.lit(""))
    word = lambda k: F.nullif(F.regexp_extract(comment, rf"(?:^| ){k}=(\"[^\"]*\"|[^ ]*)", 1), F.lit(""))
    name = get("Name", r"[^\r\n]*")
    return rows.select(
        "file", (get("LibID", r"[0-9]+").cast("int") + 1).alias("scan"), "idx", F.lit(2).alias("ms_level"),
        F.split(word("RetentionTime"), ",")[0].cast("double").alias("rt"), get("PrecursorMZ", NUMBER).cast("double").alias("precursor_mz"),
        F.coalesce(F.nullif(F.regexp_extract(name, r"/([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("charge"), name.alias("name"),
        F.regexp_replace(word("Protein"), r"^[^/]*/", "").alias("protein"), word("HCD").alias("ce"),
        _peaks(F.col("value"), rf"(?m)^([0-9.]+(?:[eE][-+]?[0-9]+)?)\t({NUMBER})").alias("peaks"),
    )


CV = "cvParam array<struct<_accession:string,_value:string,_unitAccession:string>>"
MZML = (
    f"_id string, _index bigint, _defaultArrayLength int, {CV}, scanList struct<scan:array<struct<{CV.replace(' ', ':', 1)}>>>, "
    f"precursorList struct<precursor:array<struct<selectedIonList:struct<selectedIon:array<struct<{CV.replace(' ', ':', 1)}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<{CV.replace(' ', ':', 1)},binary:string>>>"
)


def decode_array(text: str | None, bits: int, compressed: bool, big_endian: bool = False) -> np.ndarray:
    """Numbers of a base64 text, inflated if need be."""
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if compressed and raw else raw
    return np.frombuffer(raw, dtype=np.dtype("f8" if bits == 64 else "f4").newbyteorder(">" if big_endian else "<")).astype(np.float64)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decoded(text: pd.Series, bits: pd.Series, compressed: pd.Series) -> pd.Series:
    return pd.Series([decode_array(t, b, c) for t, b, c in zip(text, bits, compressed)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])))
def decoded_pairs(text: pd.Series, bits: pd.Series, compressed: pd.Series) -> pd.Series:
    out = []
    for t, b, c in zip(text, bits, compressed):
        x = decode_array(t, int(b), bool(c), True)
        out.append([{"mz": m, "intensity": i} for m, i in zip(x[::2], x[1::2])])
    return pd.Series(out)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "spectrum").option("recursiveFileLookup", "true").schema(MZML).load(path).select("*", F.col("_metadata.file_path").alias("file"))

    def cv(params: Column, accession: str, field: str = "_value") -> Column:
        return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))[field]

    def array_of(accession: str) -> Column:
        own = F.get(F.filter("binaryDataArrayList.binaryDataArray", lambda a: F.exists(a["cvParam"], lambda p: p["_accession"] == accession)), F.lit(0))
        has = lambda x: F.exists(own["cvParam"], lambda p: p["_accession"] == x)
        return decoded(own["binary"], F.when(has("MS:1000523"), 64).otherwise(32), F.coalesce(has("MS:1000574"), F.lit(False)))

    scan = F.get(F.col("scanList.scan"), F.lit(0))["cvParam"]
    ion = F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    rt = cv(scan, "MS:1000016").cast("double") * F.when(cv(scan, "MS:1000016", "_unitAccession") == "UO:0000031", 60.0).otherwise(1.0)
    number = F.nullif(F.regexp_extract("_id", r"scan=([0-9]+)", 1), F.lit("")).cast("int")
    out = rows.select(
        "file", F.coalesce(number, (F.col("_index") + 1).cast("int")).alias("scan"), F.col("_index").alias("idx"), cv(F.col("cvParam"), "MS:1000511").cast("int").alias("ms_level"),
        rt.alias("rt"), cv(ion, "MS:1000744").cast("double").alias("precursor_mz"), F.coalesce(cv(ion, "MS:1000041").cast("int"), F.lit(0)).alias("charge"),
        F.col("_id").alias("name"), F.lit(None).cast("string").alias("protein"), F.lit(None).cast("string").alias("ce"), array_of("MS:1000514").alias("m"), array_of("MS:1000515").alias("i"),
    )
    return out.withColumn("peaks", F.zip_with("m", "i", lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))).select(*COLUMNS)


_SCAN = (
    "_num:int,_msLevel:int,_retentionTime:string,_collisionEnergy:string,precursorMz:array<struct<_VALUE:double,_precursorCharge:int>>,"
    "peaks:struct<_VALUE:string,_precision:int,_compressionType:string>"
)
MZXML = ", ".join(x.replace(":", " ", 1) for x in ("_num:int", "_msLevel:int", "_retentionTime:string", "_collisionEnergy:string")) + (
    ", precursorMz array<struct<_VALUE:double,_precursorCharge:int>>, peaks struct<_VALUE:string,_precision:int,_compressionType:string>, scan array<struct<" + _SCAN + ">>"
)


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """Scans of mzXML files; MS2 scans may stand within their MS1 scan."""
    rows = spark.read.format("xml").option("rowTag", "scan").option("recursiveFileLookup", "true").schema(MZXML).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    names = ["_num", "_msLevel", "_retentionTime", "_collisionEnergy", "precursorMz", "peaks"]
    each = rows.select("file", F.explode(F.concat(F.array(F.struct(*names)), F.coalesce("scan", F.expr(f"cast(array() as array<struct<{_SCAN}>>)")))).alias("s"))
    first = F.get(F.col("s.precursorMz"), F.lit(0))
    rt = F.regexp_extract("s._retentionTime", r"PT([0-9.]+(?:[eE][-+]?[0-9]+)?)S", 1)
    return each.select(
        "file", F.col("s._num").alias("scan"), F.col("s._num").cast("bigint").alias("idx"), F.col("s._msLevel").alias("ms_level"), F.nullif(rt, F.lit("")).cast("double").alias("rt"),
        first["_VALUE"].alias("precursor_mz"), F.coalesce(first["_precursorCharge"], F.lit(0)).alias("charge"), F.concat(F.lit("scan="), F.col("s._num").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("protein"), F.col("s._collisionEnergy").alias("ce"),
        decoded_pairs(F.col("s.peaks._VALUE"), F.coalesce("s.peaks._precision", F.lit(32)), F.coalesce(F.col("s.peaks._compressionType") == "zlib", F.lit(False))).alias("peaks"),
    )


READERS = {"mgf": read_mgf, "sptxt": read_sptxt, "mzml": read_mzml, "mzxml": read_mzxml}


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of a file by its extension; a scan list names a data file and the scans to take."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "scanlist":
        return read_scanlist(spark, path)
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind](spark, path)


def read_scanlist(spark: SparkSession, path: str) -> DataFrame:
    """The scans that the list names, of the data file in its first line."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("word"))
    words = lines.withColumn("scan", F.expr("try_cast(word as int)"))
    target = words.where("scan is null").first()["word"]  # one name
    wanted = words.where("scan is not null").select("scan").distinct()
    return read_spectra(spark, target).join(wanted, "scan", "left_semi").select(*COLUMNS)


def one_scan(spectra: DataFrame, file: str, scan: int) -> DataFrame:
    return spectra.where((F.col("file").endswith(file)) & (F.col("scan") == scan))


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, bins) of files of 50 16-bit numbers a spectrum."""

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                x = np.frombuffer(content, dtype="<u2")
                x = x[: len(x) // MAX_PEAKS * MAX_PEAKS].reshape(-1, MAX_PEAKS).astype("int32")
                yield pd.DataFrame({"file": file, "idx": np.arange(len(x), dtype="int64"), "bins": list(x)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, idx bigint, bins array<int>")


def find_files(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """(path, length) of files below a folder whose names end with one of the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.lower("path").endswith(s.lower())
    return files.where(ok).orderBy("path")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line")).where("line <> ''")


def read_table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, skip: int = 0) -> DataFrame:
    """A delimited table, all columns text; without a header they are C0, C1, ..."""
    if not skip:
        df = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    else:
        lines = spark.read.text(path).rdd.zipWithIndex().filter(lambda r: r[1] >= skip).map(lambda r: r[0]["value"])
        df = spark.read.csv(lines, sep=sep, header=header, inferSchema=False)
    return df if header else df.toDF(*[f"C{k}" for k in range(len(df.columns))])


def parse_key_values(text: Column) -> Column:
    """Map of ``key=value`` words; values may be quoted."""
    keys = F.regexp_extract_all(text, F.lit(r'([^\s=]+)=("[^"]*"|[^\s]*)'), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(r'([^\s=]+)=("[^"]*"|[^\s]*)'), F.lit(2)), lambda v: F.regexp_replace(v, r'^"|"$', ""))
    return F.map_from_entries(F.array_distinct(F.zip_with(keys, values, lambda k, v: F.struct(k, v))))


def inline_spectrum(spark: SparkSession, text: str) -> DataFrame:
    """(query_id, rank, bin, w) of ``b1,b2,...`` or ``#raw#mz:intensity_mz:intensity...``; its id is -1."""
    from ..operators import encode

    df = spark.createDataFrame([(-1, text)], "query_id bigint, t string")
    if text.startswith("#raw#"):
        pairs = F.filter(F.split(F.regexp_replace("t", "^#raw#", ""), "_"), lambda x: x.contains(":"))
        peaks = F.transform(pairs, lambda x: F.struct(F.split(x, ":")[0].cast("double").alias("mz"), F.split(x, ":")[1].cast("double").alias("intensity")))
        bins = encode.compact(peaks)
    else:
        bins = F.slice(F.transform(F.split("t", ","), lambda x: x.cast("int")), 1, MAX_PEAKS)
    return encode.long_peaks(df.select("query_id", bins.alias("bins")), id_col="query_id")


def parse_request(body: str) -> dict[str, str]:
    """Parameters of a request body ``TOPN=10;QUERYID=3;...`` (or joined by ``&`` or lines); names in upper case."""
    import re

    return {k.upper(): v.strip() for k, v in re.findall(r"([A-Za-z]+)=([^;&\r\n]*)", body)}


def request_of(body: str):
    """The typed parameters of a request body."""
    from ..plans.config import request

    return request(parse_request(body))
