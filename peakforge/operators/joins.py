"""Joins whose pairs are aggregated afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a query side that are sent to all tasks; a row is a key, an id and a number.
BROADCAST_ROWS = 1_000_000


def meet(queries: DataFrame, archive: DataFrame, key: str, archive_id: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The equality join by key of a query side with an archive.

    A query side of at most so many rows is counted and sent to the archive, which
    is dealt by its id: all that a pair has then meets in one task, and aggregating
    by (query, archive_id) needs no exchange of the hits, which are many times the
    rows of either side. A larger query side is joined by the key.
    """
    if queries.limit(rows + 1).count() <= rows:
        return archive.repartition(archive_id).join(F.broadcast(queries), key)
    return queries.join(archive, key)


def among(rows: DataFrame, ids: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows whose key is among the ids, distinct ones; at most so many, which are counted, are sent to the rows, so that these stay in place."""
    return rows.join(F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids, key, "left_semi")
