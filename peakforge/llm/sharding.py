"""Resharding by minimum-cost flow.

Documents lie in old shards (by default the hash of their text, so that equal
texts lie together). From the old shards' bytes and the new capacities, a
minimum-cost flow gives how many bytes go from which shard to which; staying is
free, so the plan moves the fewest bytes. Flows are carried out with blocks:
each shard is cut by hash into blocks, a block above a fraction of a shard (a
large group of equal texts) is cut further by id, and whole blocks move. Only
shards that give or take a block are rewritten.

What reaches the driver is the table of blocks, whose size depends on the
numbers of shards and blocks alone. Null texts count as empty; rows with equal
ids and texts stay together; an empty table gives an empty result. Only id and
text are read. Where the input has columns of the names that are added, its own
are kept as ``input_shard`` and ``input_old_shard`` (with more ``input_`` in front
while such a name is taken too).
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, staged

OVERHEAD = 16


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow from suppliers to takers of the least total cost, by successive shortest paths.

    Sums of supply and demand are equal. Returns the matrix of flows.
    """
    n, m = len(supply), len(demand)
    left, room = list(map(int, supply)), list(map(int, demand))
    flow = np.zeros((n, m), dtype=np.int64)
    for i in range(min(n, m)):  # free arcs are shortest paths from the start
        if cost[i, i] == 0:
            x = min(left[i], room[i])
            flow[i, i] += x
            left[i] -= x
            room[i] -= x
    while sum(left):
        dist, back, queue = {}, {}, deque()
        for i in range(n):
            if left[i]:
                dist[("s", i)] = 0
                queue.append(("s", i))
        while queue:  # label correcting: residual arcs can have negative cost
            side, k = queue.popleft()
            d = dist[(side, k)]
            arcs = [(("t", j), d + cost[k, j]) for j in range(m)] if side == "s" else [(("s", i), d - cost[i, k]) for i in range(n) if flow[i, k]]
            for node, new in arcs:
                if new < dist.get(node, np.inf) - 1e-12:
                    dist[node] = new
                    back[node] = (side, k)
                    queue.append(node)
        end = min((("t", j) for j in range(m) if room[j] and ("t", j) in dist), key=dist.__getitem__)
        path = [end]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0][1]], room[end[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "t":
                amount = min(amount, int(flow[b[1], a[1]]))
        for a, b in zip(path, path[1:]):
            if a[0] == "s":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return flow


def plan_moves(units: list[tuple[int, int]], shards: int) -> list[int]:
    """New shard of each unit (old shard, bytes): flows are filled with whole units, then evened out."""
    old = np.zeros(shards, dtype=np.int64)
    for s, b in units:
        old[s] += b
    total = int(old.sum())
    capacity = [total // shards + (i < total % shards) for i in range(shards)]
    flow = min_cost_flow(old.tolist(), capacity, 1.0 - np.eye(shards))
    new = [s for s, _ in units]
    load = old.copy()
    by_shard: dict[int, list[int]] = {}
    for k in sorted(range(len(units)), key=lambda k: (-units[k][1], k)):
        by_shard.setdefault(units[k][0], []).append(k)
    for i in range(shards):
        for j in range(shards):
            rest = int(flow[i, j]) if i != j else 0
            if rest:
                for k in by_shard.get(i, []):
                    if new[k] == i and 0 < units[k][1] <= rest:
                        new[k] = j
                        rest -= units[k][1]
                        load[i] -= units[k][1]
                        load[j] += units[k][1]
    members: list[list[int]] = [[] for _ in range(shards)]
    for k, s in enumerate(new):
        members[s].append(k)
    for _ in range(20 * shards):  # what whole units left over
        a, b = int(load.argmax()), int(load.argmin())
        gap = int(load[a] - load[b])
        best = min((k for k in members[a] if 0 < units[k][1] < gap), key=lambda k: (abs(gap - 2 * units[k][1]), k), default=None)
        if best is None:
            break
        members[a].remove(best)
        members[b].append(best)
        new[best] = b
        load[a] -= units[best][1]
        load[b] += units[best][1]
    return new


def old_shard(text: Column, old_col: str | None, shards: int) -> Column:
    """The shard that a row lies in: a column of the input (of a number from 0), or the hash of its text."""
    h = F.xxhash64(text) if old_col is None else F.coalesce(F.col(old_col).cast("long"), F.lit(0))
    return F.pmod(h, F.lit(shards)).cast("int")


def assigned(docs: DataFrame, shards: int = 40, blocks: int = 256, grain: int = 128, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None):
    """(slim, plan): rows (id, size, crc, h, doc_h), and the plan of units.

    A unit is (old, block, part); its rows have old_shard = old,
    pmod(h >> 20, blocks) = block and pmod(doc_h, parts) = part. grain: units
    are at most about one grain-th of a shard. old_col: where documents lie now, as
    a column; shards beyond the new number are taken modulo it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(text)
    slim = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            old_shard(text, old_col, shards).alias("old"),
            F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int").alias("block"),
            F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(11)), 2).alias("doc_h"),
        ),
        "shard-documents",
    )
    total = F.sum("size").alias("bytes")
    first = slim.groupBy("old", "block").agg(total).collect()  # at most shards * blocks rows
    mean = max(1, sum(r["bytes"] for r in first) // shards)
    parts = [(r["old"], r["block"], -(-r["bytes"] // max(1, mean // grain)) if r["bytes"] > 2 * mean // grain else 1) for r in first]
    spark = docs.sparkSession
    parts_table = F.broadcast(spark.createDataFrame(parts, "old int, block int, parts int"))
    slim = slim.join(parts_table, ["old", "block"]).withColumn("part", F.pmod(F.col("doc_h"), F.col("parts")).cast("int"))
    units = slim.groupBy("old", "block", "part").agg(total, F.count(F.lit(1)).alias("n")).collect()  # at most shards * (blocks + grain) rows
    units.sort(key=lambda r: (r["old"], r["block"], r["part"]))
    new = plan_moves([(r["old"], r["bytes"]) for r in units], shards)
    offset = [0] * shards
    plan = []
    for r, s in zip(units, new):
        plan.append((r["old"], r["block"], r["part"], s, offset[s], r["bytes"]))
        offset[s] += r["n"]
    return slim, parts_table, F.broadcast(spark.createDataFrame(plan, "old int, block int, part int, shard int, offset long, unit_bytes long"))


def reshard(docs: DataFrame, shards: int = 40, **options) -> DataFrame:
    """One row a row of docs: id, size, crc, old, shard and slot."""
    slim, _, plan = assigned(docs, shards, **options)
    order = W.partitionBy("old", "block", "part").orderBy(F.col("id").asc_nulls_first(), "crc", "size")
    return slim.join(plan, ["old", "block", "part"]).select(
        "id", "size", "crc", "old", "shard", (F.col("offset") + F.row_number().over(order) - 1).alias("slot")
    )


def with_shards(docs: DataFrame, shards: int = 40, blocks: int = 256, old_col: str | None = None) -> DataFrame:
    """docs with the columns old_shard and shard; texts are not shuffled."""
    _, parts, plan = assigned(docs, shards, blocks, old_col=old_col)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select(
        row,
        old_shard(F.coalesce(docs["text"], F.lit("")), old_col, shards).alias("old"),
        F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int").alias("block"),
        F.shiftrightunsigned(F.xxhash64(docs["doc_id"], F.lit(11)), 2).alias("doc_h"),
    )
    placed = keyed.join(parts, ["old", "block"]).withColumn("part", F.pmod(F.col("doc_h"), F.col("parts")).cast("int")).join(plan, ["old", "block", "part"])
    names = {"old_shard": "old", "shard": "shard"}
    taken, own = {c.lower() for c in (*docs.columns, *names)}, []
    for c in docs.columns:
        new = c
        while c.lower() in names and new.lower() in taken:
            new = f"input_{new}"
        taken.add(new.lower())
        own.append(F.col("__row")[c].alias(new))
    return placed.select(*own, *[F.col(v).alias(k) for k, v in names.items()])


def rewrite(placed: DataFrame, path: str) -> DataFrame:
    """Writes the files of affected shards (those that give or take rows) under path/shard=N, and returns which they were."""
    moved = placed.where("old_shard <> shard")
    affected = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    out = placed.join(F.broadcast(affected), "shard", "left_semi")  # at most as many rows as shards
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected


def op8_sharding(spark, sf_dir):
    out = reshard(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_law(spark, sf_dir):
    """One row that says whether the law holds: shards used, rows, bytes, gapless slots, and no shard's bytes above another's by more than the largest row."""
    rows = op8_sharding(spark, sf_dir)
    by = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    gapless = (F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    return by.agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.every(gapless).alias("gapless"),
        (F.max("bytes") - F.min("bytes") <= F.max("most")).alias("even"),
    )


SHARD_LAW_SQL = "select 40::bigint shards, count(*)::bigint as rows, sum(octet_length(encode(coalesce(text, ''))) + 16)::bigint bytes, true gapless, true even from documents"
