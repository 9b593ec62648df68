"""Growth of an archive from a folder that files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.archive import Archive
from ..sources.spectra import SPECTRA


def follow(spark: SparkSession, archive: Archive, folder: str, checkpoint: str, once: bool = True):
    """Adds every new Parquet file of spectra rows in the folder to the archive; a batch is added whole.

    A batch is one commit of the archive: a failed one left nothing, and of one that was committed all files are known
    by their names, so a replay adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        archive.add(batch)

    stream = spark.readStream.schema(SPECTRA).parquet(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
