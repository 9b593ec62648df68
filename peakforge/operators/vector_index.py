"""Exact and approximate nearest neighbours of dense vectors.

IVF-PQ: coarse centroids cut the space into lists, a vector is stored as the list
and one code per subspace of its residual, and a search visits the nprobe lists
nearest to the query and sums looked-up distances. Models are trained with numpy
on a bounded sample (``training`` rows, those of the smallest hash), on one machine
or, if it is large, where the sample lies; encoding and search run over all rows, and
a search sends the query set, in blocks, to the codes.
Several indexes permute the dimensions by their seed; their results are united.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import IndexSpec, valid_nprobe


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


#: Distances by name, as columns of two arrays.
METRICS = {
    "l2": squared_distance,
    "ip": lambda a, b: -inner_product(a, b),
    "l1": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x),
    "linf": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))),
    "canberra": lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x.cast("double") - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x
    ),
    "braycurtis": lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    / F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") + y)), F.lit(0.0), lambda s, x: s + x),
}


def _rowwise(metric: str, p: float):
    """The distance of one vector to many, in numpy."""
    if metric == "js":

        def js(q, v):
            a, b = q / max(q.sum(), 1e-300), v / np.maximum(v.sum(1, keepdims=True), 1e-300)
            m = (a + b) / 2
            with np.errstate(divide="ignore", invalid="ignore"):
                parts = np.where(a > 0, a * np.log(a / m), 0) + np.where(b > 0, b * np.log(b / m), 0)
            return np.sqrt(np.maximum(parts.sum(1) / 2, 0))

        return js

    def canberra(q, v):
        total = np.abs(q) + np.abs(v)
        return np.where(total > 0, np.abs(q - v) / np.where(total > 0, total, 1), 0).sum(1)

    return {
        "l1": lambda q, v: np.abs(q - v).sum(1), "linf": lambda q, v: np.abs(q - v).max(1), "lp": lambda q, v: (np.abs(q - v) ** p).sum(1) ** (1 / p),
        "canberra": canberra, "braycurtis": lambda q, v: np.abs(q - v).sum(1) / np.abs(q + v).sum(1),
    }[metric]


def distances(q: np.ndarray, v: np.ndarray, metric: str = "l2", p: float = 3.0) -> np.ndarray:
    """Distances of all rows of q to all rows of v; the squared one for l2, the negative product for ip."""
    if metric == "ip":
        return -(q @ v.T)
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * (q @ v.T), 0)
    f = _rowwise(metric, p)
    return np.stack([f(x, v) for x in q]) if len(q) else np.zeros((0, len(v)))


def nearest_of(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the k least of a row, by distance and id; all that tie with the k-th are weighed."""
    if len(d) > k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[some], ids[some]
    order = np.lexsort((ids, d))[:k]
    return d[order], ids[order]


class Best:
    """The k nearest of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in range(queries)]

    def meet(self, query: int, d: np.ndarray, ids: np.ndarray) -> None:
        # rounding decides no tie: the last digits are dropped before ids do
        own = nearest_of(np.round(d, 9), ids, self.k)
        old = self.found[query]
        self.found[query] = nearest_of(np.append(old[0], own[0]), np.append(old[1], own[1]), self.k)

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        n = [len(x) for x, _ in self.found]
        return pd.DataFrame({
            "query_id": np.repeat(query_ids, n).astype("int64"), "idx": np.concatenate([i for _, i in self.found] or [np.zeros(0)]).astype("int64"),
            "dist": np.concatenate([d for d, _ in self.found] or [np.zeros(0)]).astype("float64"),
        })


#: Bytes of query vectors that go to the executors at once.
QUERY_BYTES = 64 << 20


def query_blocks(queries: DataFrame, most: int = 1 << 30):
    """(ids, vectors) of the stated query set (query_id, q), in blocks of bounded size, read a partition at a time."""
    ids, held = [], []
    for r in queries.select("query_id", "q").toLocalIterator(prefetchPartitions=True):
        ids.append(r["query_id"])
        held.append(np.asarray(r["q"], dtype=np.float64))
        if len(held) >= most or len(held) * held[-1].nbytes >= QUERY_BYTES:
            yield np.array(ids, dtype=np.int64), np.stack(held)
            ids, held = [], []
    if held:
        yield np.array(ids, dtype=np.int64), np.stack(held)


FOUND = "query_id bigint, idx bigint, dist double"


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", p: float = 3.0, block: int = 512) -> DataFrame:
    """(query_id, idx, dist, rank): the exact k nearest. queries: (query_id, q), vectors: (idx, v).

    The query set goes in blocks over all vectors: each partition keeps the k best
    of its rows for each query, and only those are merged. p: of the metric "lp".
    """
    sc, out = queries.sparkSession.sparkContext, None
    for part in query_blocks(queries):
        shared = sc.broadcast(part)

        def run(batches, shared=shared):
            ids, q = shared.value
            best = Best(len(ids), k)
            for pdf in batches:
                if len(pdf):
                    v, own = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["idx"].to_numpy()
                    for a in range(0, len(ids), block):
                        for i, row in enumerate(distances(q[a : a + block], v, metric, p)):
                            best.meet(a + i, row, own)
            yield best.rows(ids)

        found = vectors.select("idx", "v").mapInPandas(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return _merged(out if out is not None else queries.sparkSession.createDataFrame([], FOUND), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("dist", "idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- training ------------------------------------------------------------------------------


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, by |x|^2 - 2xy + |y|^2."""
    return ((centroids**2).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)


def kmeans(x: np.ndarray, k: int, init: str = "random", seed: int = 42, steps: int = 100, gain: float = 1e-3) -> np.ndarray:
    """Centroids after at most ``steps`` rounds, or when the error falls by less than a share of ``gain``."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    if init == "first":
        c = x[:k].copy()
    elif init == "random":
        c = x[rng.choice(len(x), k, replace=False)].copy()
    elif init == "unit":
        c = rng.random((k, x.shape[1]))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    elif init == "projection":
        order = np.argsort(x @ rng.standard_normal(x.shape[1]))
        c = np.stack([p.mean(0) for p in np.array_split(x[order], k)])
    else:
        raise ValueError(init)
    last = np.inf
    for _ in range(steps):
        at = assign(x, c)
        error = ((x - c[at]) ** 2).sum()
        if last - error < gain * max(last, 1e-12) and last < np.inf:
            break
        last = error
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


@dataclass
class Index:
    """A trained IVF-PQ index: coarse centroids, one codebook a subspace, and the order of dimensions."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    order: np.ndarray
    number: int = 0

    def parts(self) -> tuple:
        return self.centroids, self.codebooks, self.order, self.number

    def permuted(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.order]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.permuted(x)
        at = assign(x, self.centroids)
        rest = x - self.centroids[at]
        parts = np.split(rest, len(self.codebooks), axis=1)
        return at, np.column_stack([assign(p, c) for p, c in zip(parts, self.codebooks)])

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        d = (self.centroids**2).sum(1)[None, :] - 2 * self.permuted(q) @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, : valid_nprobe(n)]

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """Squared distance of the residuals of queries to each code of each subspace: (queries, subspaces, codes)."""
        rest = np.split(self.permuted(q) - self.centroids[at], len(self.codebooks), axis=1)
        out = np.zeros((len(q), len(self.codebooks), max(map(len, self.codebooks))))
        for k, (r, c) in enumerate(zip(rest, self.codebooks)):
            out[:, k, : len(c)] = ((r[:, None, :] - c[None, :, :]) ** 2).sum(2)
        return out

    def looked_up(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances (queries, vectors) of codes (vectors, subspaces)."""
        out = np.zeros((len(tables), len(codes)))
        for k in range(codes.shape[1]):
            out += tables[:, k, codes[:, k]]
        return out

    def reconstruct(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = self.centroids[at] + np.concatenate([c[codes[:, k]] for k, c in enumerate(self.codebooks)], axis=1)
        out = np.empty_like(x)
        out[:, self.order] = x
        return out


#: Bytes of training vectors that one machine holds; larger samples stay distributed.
SAMPLE_BYTES = 256 << 20


def training_rows(vectors: DataFrame, n: int = 100_000, seed: int = 42) -> DataFrame:
    """The n rows of the smallest hashes of (idx, seed)."""
    return vectors.select("idx", "v").orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(n)


def as_matrix(rows: list) -> np.ndarray:
    return np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 0))


def residual_parts(x: np.ndarray, centroids: np.ndarray, subspaces: int) -> list[np.ndarray]:
    return np.split(x - centroids[assign(x, centroids)], subspaces, axis=1)


def train(sample: np.ndarray, spec: IndexSpec, seed: int = 0, number: int = 0) -> Index:
    dims = sample.shape[1]
    if dims % spec.subspaces:
        raise ValueError("dimensions must be a multiple of the subspaces")
    order = np.random.default_rng(seed).permutation(dims)
    x = sample[:, order]
    centroids = kmeans(x, spec.lists, seed=seed)
    books = [kmeans(p, 1 << spec.bits, seed=seed) for p in residual_parts(x, centroids, spec.subspaces)]
    return Index(centroids, books, order, number)


def _distributed_steps(rows: DataFrame, views, starts: list[np.ndarray], steps: int, gain: float) -> list[np.ndarray]:
    """k-means of several views of the rows at once: each round sums, partition by partition, what the rows give.

    views: a function of a matrix of rows that gives a matrix for each start.
    """
    sc, at, last = rows.sparkSession.sparkContext, [c.copy() for c in starts], np.inf
    for _ in range(steps):
        shared = sc.broadcast(at)

        def run(batches, shared=shared):
            at = shared.value
            sums, counts, error = [np.zeros_like(c) for c in at], [np.zeros(len(c)) for c in at], 0.0
            for pdf in batches:
                if len(pdf):
                    for k, x in enumerate(views(as_matrix(list(pdf["v"])))):
                        near = assign(x, at[k])
                        np.add.at(sums[k], near, x)
                        counts[k] += np.bincount(near, minlength=len(at[k]))
                        error += ((x - at[k][near]) ** 2).sum()
            for k, (total, n) in enumerate(zip(sums, counts)):
                yield pd.DataFrame({"k": [k], "sums": [total.astype("f4").tobytes()], "counts": [n.tobytes()], "error": [error if k == 0 else 0.0]})

        parts = rows.select("v").mapInPandas(run, "k int, sums binary, counts binary, error double").toPandas()
        shared.destroy()
        for k, own in parts.groupby("k"):
            n = np.sum([np.frombuffer(x) for x in own["counts"]], axis=0)
            total = np.sum([np.frombuffer(x, dtype="f4").reshape(at[k].shape) for x in own["sums"]], axis=0, dtype=np.float64)
            at[k] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at[k])
        error = parts["error"].sum()
        if last < np.inf and last - error < gain * max(last, 1e-12):
            break
        last = error
    return at


def train_distributed(rows: DataFrame, dims: int, spec: IndexSpec, seed: int = 0, number: int = 0, steps: int = 100, gain: float = 1e-3, tasks: int = 16) -> Index:
    """The index of a sample that no machine has to hold: only centroids and their sums reach the driver, ``tasks`` of each a round."""
    if dims % spec.subspaces:
        raise ValueError("dimensions must be a multiple of the subspaces")
    order = np.random.default_rng(seed).permutation(dims)
    few = max(spec.lists, 1 << spec.bits)
    first = as_matrix([r["v"] for r in rows.orderBy(F.xxhash64("idx", F.lit(seed + 1)), "idx").limit(few).select("v").toLocalIterator()])[:, order]
    spread = rows.repartition(tasks).persist(StorageLevel.DISK_ONLY)
    (centroids,) = _distributed_steps(spread, lambda x: [x[:, order]], [first[: spec.lists]], steps, gain)
    starts = [p[: 1 << spec.bits] for p in residual_parts(first, centroids, spec.subspaces)]
    books = _distributed_steps(spread, lambda x: residual_parts(x[:, order], centroids, spec.subspaces), starts, steps, gain)
    spread.unpersist()
    return Index(centroids, books, order, number)


def train_all(vectors: DataFrame, specs: list[tuple[IndexSpec, int]], training: int = 100_000) -> list[Index]:
    """One index a spec, each trained on its own part of the sample.

    A sample of at most SAMPLE_BYTES is trained on one machine, a larger one where it lies; both by the same rounds.
    """
    rows = training_rows(vectors, training)
    one = rows.limit(1).collect()
    if not one:
        raise ValueError("there is nothing to train on")
    dims = len(one[0]["v"])
    if training * dims * 8 <= SAMPLE_BYTES or (n := rows.count()) * dims * 8 <= SAMPLE_BYTES:
        sample = as_matrix([r["v"] for r in rows.select("v").collect()])
        parts = [sample[k :: len(specs)] for k in range(len(specs))]
        return [train(p if len(p) >= s.lists else sample, s, seed, k) for k, (p, (s, seed)) in enumerate(zip(parts, specs))]
    part = F.pmod(F.xxhash64("idx", F.lit(12345)), F.lit(len(specs)))
    return [train_distributed(rows.where(part == k) if n >= len(specs) * s.lists else rows, dims, s, seed, k) for k, (s, seed) in enumerate(specs)]


# --- encoding and search -----------------------------------------------------------------


def encoded(vectors: DataFrame, index: Index) -> DataFrame:
    """(idx, list_id, codes) of (idx, v). Write it sorted by list_id, so that a search reads few lists a task."""
    shared = vectors.sparkSession.sparkContext.broadcast(index.parts())

    def run(batches):
        for pdf in batches:
            if len(pdf):
                at, codes = Index(*shared.value).encode(np.stack(pdf["v"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"idx": pdf["idx"], "list_id": at.astype("int32"), "codes": list(codes.astype("int32"))})

    return vectors.select("idx", "v").mapInPandas(run, "idx bigint, list_id int, codes array<int>")


def probes(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """(query_id, place, list_id) of (query_id, q): the lists to visit, the nearest first."""
    shared = queries.sparkSession.sparkContext.broadcast(index.parts())

    def run(batches):
        for pdf in batches:
            if len(pdf):
                lists = Index(*shared.value).probes(np.stack(pdf["q"].to_numpy()).astype(np.float64), nprobe)
                n = lists.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "place": np.tile(np.arange(1, n + 1, dtype="int32"), len(pdf)), "list_id": lists.ravel().astype("int32")})

    return queries.select("query_id", "q").mapInPandas(run, "query_id bigint, place int, list_id int")


def search(queries: DataFrame, codes: DataFrame, index: Index, k: int, nprobe: int = 8, block: int = 2000) -> DataFrame:
    """(query_id, idx, dist, rank): the k nearest by looked-up distances among the lists visited.

    The query set goes in blocks to the codes: a task looks up the lists that it
    has for the queries that visit them and keeps k rows a query. No code and no
    table of distances is dealt out, and a long list is read by many tasks.
    """
    sc, out = queries.sparkSession.sparkContext, None
    for ids, q in query_blocks(queries, block):
        shared = sc.broadcast((ids, q, index.parts()))

        def run(batches, shared=shared):
            ids, q, parts = shared.value
            index, best, tables = Index(*parts), Best(len(ids), k), {}
            visits = index.probes(q, nprobe)
            for pdf in batches:
                lists = pdf["list_id"].to_numpy()
                for at in np.unique(lists).tolist():
                    who = np.flatnonzero((visits == at).any(1))
                    if not len(who):
                        continue
                    own = lists == at
                    codes, names = np.stack(pdf["codes"].to_numpy()[own]), pdf["idx"].to_numpy()[own]
                    for a in range(0, len(who), 64):
                        some = who[a : a + 64]
                        if (at, a) not in tables:
                            if len(tables) >= 64:
                                tables.clear()
                            tables[at, a] = index.tables(q[some], at)
                        for i, row in zip(some.tolist(), index.looked_up(tables[at, a], codes)):
                            best.meet(i, row, names)
            yield best.rows(ids)

        found = codes.select("list_id", "idx", "codes").mapInPandas(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return _merged(out if out is not None else queries.sparkSession.createDataFrame([], FOUND), k)


def search_all(queries: DataFrame, vectors: DataFrame, indexes: list[Index], k: int, nprobe: int = 8, use: int | None = None) -> DataFrame:
    """(query_id, idx, index_no, rank): candidates of the first ``use`` indexes, once each. vectors: to be encoded first; see search_stored."""
    codes = None
    for index in indexes[:use]:
        own = encoded(vectors, index).withColumn("index_no", F.lit(index.number))
        codes = own if codes is None else codes.unionByName(own)
    return search_stored(queries, codes, indexes, k, nprobe, use)


def search_stored(queries: DataFrame, codes: DataFrame, indexes: list[Index], k: int, nprobe: int = 8, use: int | None = None) -> DataFrame:
    """(query_id, idx, index_no, rank): candidates of the first ``use`` indexes, once each, from codes (index_no, list_id, idx, codes)."""
    from .score import union_of_indexes

    found = None
    for index in indexes[:use]:
        own = search(queries, codes.where(F.col("index_no") == index.number), index, k, nprobe).withColumn("index_no", F.lit(index.number))
        found = own if found is None else found.unionByName(own)
    return union_of_indexes(found)


# --- models as rows --------------------------------------------------------------------------

MODEL = "index_no int, part string, place int, width int, data binary"


def model_rows(indexes: list[Index]) -> list[tuple]:
    """Rows of MODEL: centroids, codebooks and the order of dimensions of each index."""
    rows = []
    for x in indexes:
        rows.append((x.number, "centroids", 0, x.centroids.shape[1], x.centroids.astype("<f8").tobytes()))
        rows += [(x.number, "codebook", k, c.shape[1], c.astype("<f8").tobytes()) for k, c in enumerate(x.codebooks)]
        rows.append((x.number, "order", 0, len(x.order), x.order.astype("<f8").tobytes()))
    return rows


def read_models(rows: list) -> list[Index]:
    """The indexes of rows of MODEL, by number."""
    by: dict[int, dict] = {}
    for r in rows:
        by.setdefault(r["index_no"], {})[r["part"], r["place"]] = np.frombuffer(bytes(r["data"]), dtype="<f8").reshape(-1, r["width"])
    out = []
    for number, x in sorted(by.items()):
        books = [x["codebook", k] for k in range(sum(part == "codebook" for part, _ in x))]
        out.append(Index(x["centroids", 0], books, x["order", 0].ravel().astype(np.int64), number))
    return out


def list_report(codes: DataFrame) -> DataFrame:
    """(list_id, n, share); there are as many rows as lists."""
    by = codes.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def list_entropy(codes: DataFrame) -> DataFrame:
    """One row: entropy of list sizes in bits, the number of lists used, and the bytes of codes (one a subspace) in all."""
    by = codes.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("codes")).alias("code_bytes"))
    by = by.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
    return by.agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"), F.count(F.lit(1)).alias("n_lists"), F.sum("code_bytes").alias("code_bytes"))


def removed(codes: DataFrame, first: int, last: int) -> DataFrame:
    """codes without the ids in [first, last)."""
    return codes.where((F.col("idx") < first) | (F.col("idx") >= last))
