"""Benchmark decontamination by latent semantic retrieval.

Benchmark items, cut into pieces of at most 57 words, are TF-IDF vectors over
their own terms, with document frequencies counted over all documents. A
randomised SVD, whose products with the pieces' matrix are summed over
partitions, gives the latent space. Every document is cut into cells of eight
words; passages of four and of eight cells begin at every cell, are projected,
and those whose cosine and share of a piece's mass pass the limits are
candidates, as are those that hold all of its mass whatever else they hold. A
candidate counts if the longest common subsequence of the whole item's words and
the region's covers enough of the item, and enough of its answer (its last
quarter) too.

Pieces are searched in blocks, so the terms, factors and vectors that are
broadcast are bounded by the block size; each block is searched in the documents
themselves, and where there are several, what they find meets by the text's hash.
Terms' projections are multiplied with the pieces' vectors beforehand, so a
passage's products are sums of what its words give. Within a block, at most RANK pieces
share a latent space, which thus holds each of them whole: no part of an item is
lost in it, however many items there are. A term that many documents hold weighs
nothing, unless it is among the rarest eight of a piece. Null texts are clean;
an item without words matches nothing; an empty benchmark finds nothing. Rows
are judged one by one; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, read, slices, small_batches, staged, utf8
from .licenses import WORD
from .shingles import word_hashes

BLOCK_ITEMS, RANK, OVERSAMPLE, POWERS = 4096, 256, 8, 2
CELL, PASSAGES = 8, (4, 8)
#: Terms whose documents are counted in one pass, and cells whose passages are held at once.
COUNTED_TERMS, CELLS = 1 << 22, 1024
#: Texts with an item that are sent to all documents; beyond, Spark joins them.
BROADCAST_ROWS = 200_000
#: So many words lie within one of the longest passages wherever they begin in a cell.
PIECE = CELL * (PASSAGES[-1] - 1) + 1
COMMON, RARE_KEPT = 0.1, 8
COSINE, MASS, WHOLE = 0.25, 0.4, 0.99
LCS, ANSWER = 0.65, 0.5
SEPARATORS = ~WORD
HITS = "array<struct<item:bigint,share:double>>"
KIND = pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64())]))


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words of each text)."""
    data, bounds = utf8(column)
    return word_hashes(data.lower(), bounds, SEPARATORS)


def places(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted terms, -1 if it is none of them."""
    if not len(terms):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    return np.where(terms[at] == words, at, -1)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of documents that hold each term, number of documents), over all of docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        counts, n = np.zeros(len(shared.value), dtype=np.int64), 0
        for batch in slices(batches, column=0):
            words, of_text = tokens(batch.column(0))
            at = places(words, shared.value)
            owner = np.repeat(np.arange(len(of_text)), of_text)[at >= 0]
            once = np.unique(owner * len(counts) + at[at >= 0])
            counts += np.bincount(once % max(1, len(counts)), minlength=len(counts))
            n += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], n))], names=["term", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    shared.destroy()
    out, total = np.zeros(len(terms), dtype=np.int64), 0
    for t, n in zip(rows["term"], rows["n"]):
        if t < 0:
            total = n
        else:
            out[t] = n
    return out, total


def weights_of(items: list[np.ndarray], df: np.ndarray, n: int) -> np.ndarray:
    """IDF of each term; 0 for common terms that no item needs. items: places of each item's words."""
    idf = np.log((n + 1.0) / (df + 1.0)) + 0.1
    needed = np.zeros(len(df), dtype=bool)
    for own in items:
        own = np.unique(own)
        needed[own[np.argsort(df[own], kind="stable")[:RARE_KEPT]]] = True
    return np.where(needed | (df <= COMMON * n), idf, 0.0)


def latent_space(spark, items: list[np.ndarray], idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (terms by rank) of the TF-IDF matrix of items (places of each item's words), its rows scaled to length 1.

    Randomised range finder with power iterations; each product A'(A X) is a sum
    over partitions of what their items give.
    """
    sc = spark.sparkContext
    fixed = sc.broadcast(idf)
    matrix = spark.createDataFrame([(x.tolist(),) for x in items], "places array<int>").coalesce(4)

    def times(x: np.ndarray) -> np.ndarray:
        factor = sc.broadcast(x.astype(np.float32))

        def run(batches):
            idf, right = fixed.value, factor.value
            out = np.zeros(right.shape, dtype=np.float32)
            for batch in batches:
                for places in batch.column(0):
                    own, tf = np.unique(places.values.to_numpy(), return_counts=True)
                    row = (tf * idf[own]).astype(np.float32)
                    row /= max(np.linalg.norm(row), 1e-9)
                    out[own] += np.outer(row, row @ right[own])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.large_binary())], names=["part"])

        parts = matrix.mapInArrow(run, "part binary").toArrow().column(0).to_pylist()
        factor.destroy()
        return np.sum([np.frombuffer(p, dtype=np.float32).reshape(x.shape) for p in parts], axis=0, dtype=np.float64)

    width = min(len(idf), rank + OVERSAMPLE)
    basis = np.random.default_rng(3).standard_normal((len(idf), width))
    for _ in range(1 + POWERS):
        basis, _ = np.linalg.qr(times(basis))
    # A'A in the basis; its eigenvectors turn the basis into singular vectors
    small = basis.T @ times(basis)
    fixed.destroy()
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:rank]
    return basis @ vector[:, order[value[order] > 1e-9]]


def lcs(item: dict[int, int], length: int, words) -> int:
    """Length of the longest common subsequence, bit-parallel. item: the bits of each word's places in the item."""
    full = (1 << length) - 1
    row = full
    for w in words:
        m = item.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return length - row.bit_count()


def bits(words) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """An item's words cut into as few parts of at most PIECE words as there can be, of about equal length."""
    return np.array_split(words, -(-len(words) // PIECE)) if len(words) else []


def passages_of(known: np.ndarray, cell: np.ndarray, n: int, products: np.ndarray, idf: np.ndarray, of_doc: np.ndarray):
    """Yields (number of cells, products with each item, norms) of the passages that begin at each of n cells; their sizes are powers of two."""
    sums, mass = np.zeros((n, products.shape[1]), dtype=np.float32), np.zeros(n)
    if len(known):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums[cell[first]] = np.add.reduceat(products[known], first, axis=0)
        mass = np.bincount(cell, weights=idf[known] ** 2, minlength=n)
    size = 1
    while True:
        if size in PASSAGES:
            yield size, sums, np.sqrt(mass)
        if size >= PASSAGES[-1]:
            return
        # a passage of twice the size is two that follow one another, but where the document ends
        apart = np.flatnonzero(of_doc[: max(0, n - size)] != of_doc[size:])
        both, weight = sums.copy(), mass.copy()
        both[: max(0, n - size)] += sums[size:]
        weight[: max(0, n - size)] += mass[size:]
        both[apart], weight[apart] = sums[apart], mass[apart]
        sums, mass, size = both, weight, size * 2


def search(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs (with a column text) with the column hits, an array of (item, lcs share), by item.

    benchmark: (id, text); its items are taken in blocks by order of id. The items,
    which are the queries of the search, are on the driver; documents never are, and
    of a document only its text goes to Python and only its hits come back.
    """
    blocks: list[list] = [[]]
    for r in benchmark.where("id is not null and text is not null").orderBy("id", "text").toLocalIterator():
        if len(blocks[-1]) == block_items:
            blocks.append([])
        blocks[-1].append((r["id"], r["text"]))
    passes = []
    for block in blocks:
        pieces = [(k, w) for k, own in enumerate(words_of(block)) for w in pieces_of(own)]
        passes += [(block, pieces[at : at + block_items]) for at in range(0, len(pieces), block_items)]
    if not passes:
        return docs.withColumn("hits", F.array().cast(HITS))
    texts = docs.select("text")
    terms = np.unique(np.concatenate([w for _, pieces in passes for _, w in pieces]))
    df = np.zeros(len(terms), dtype=np.int64)
    for at in range(0, len(terms), COUNTED_TERMS):
        df[at : at + COUNTED_TERMS], n = document_frequencies(texts, terms[at : at + COUNTED_TERMS])
    spark = docs.sparkSession
    if len(passes) == 1:
        return docs.withColumn("hits", hits_of(spark, *passes[0], terms, df, n, rank)[0](F.col("text")))
    text_hash = [F.xxhash64("text", F.lit(k)).alias(f"__h{k}") for k in (1, 2)]
    found = None
    for block, pieces in passes:
        hits, shared = hits_of(spark, block, pieces, terms, df, n, rank)
        some = texts.withColumn("hits", hits(F.col("text"))).where(F.size("hits") > 0)
        own = staged(some.select(*text_hash, F.explode("hits").alias("hit")).select("__h1", "__h2", "hit.*").distinct(), "hits")
        shared.destroy()
        found = own if found is None else found.unionByName(own)
    # an item that two passes hold parts of is found by either
    found = found.groupBy("__h1", "__h2", "item").agg(F.max("share").alias("share"))
    found = staged(found.groupBy("__h1", "__h2").agg(F.sort_array(F.collect_list(F.struct("item", "share"))).alias("hits")), "hits")
    joined = docs.select("*", *text_hash).join(bounded_broadcast(found, found.count(), BROADCAST_ROWS), ["__h1", "__h2"], "left")
    return joined.select(*docs.columns, F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def words_of(block: list) -> list[np.ndarray]:
    """The words of each item of a block of (id, text)."""
    words, counts = tokens(pa.array([t for _, t in block], pa.string()))
    return np.split(words, np.cumsum(counts)[:-1])


def space_of(spark, items: list[np.ndarray], terms: np.ndarray, idf: np.ndarray, rank: int) -> dict:
    """The latent space of some items and their vectors in it. items: places of each item's words in terms.

    There are at most rank items, so the space holds each of them whole, and
    the products in it are those of the TF-IDF vectors themselves.
    """
    own = np.unique(np.concatenate(items))
    local = np.full(len(terms) + 1, -1, dtype=np.int32)  # the last entry is for words that are no term
    local[own] = np.arange(len(own))
    v = latent_space(spark, [local[x] for x in items], idf[own], min(rank, len(items)))
    vectors = np.zeros((len(items), v.shape[1]))
    norms = np.zeros(len(items))
    for k, x in enumerate(items):
        at, tf = np.unique(local[x], return_counts=True)
        vectors[k] = (tf * idf[own][at]) @ v[at]
        norms[k] = np.linalg.norm(tf * idf[own][at])
    local[own[idf[own] <= 0]] = -1
    return {
        "local": local, "idf": idf[own], "products": ((idf[own][:, None] * v) @ vectors.T).astype(np.float32),
        "norms": np.maximum(norms, 1e-9), "mass": np.maximum((vectors**2).sum(1), 1e-12),
    }


def candidates(space: dict, at: np.ndarray, cell: np.ndarray, of_doc: np.ndarray):
    """Yields (number of cells, first cell, item of the space) of the passages that pass the limits. at: place of each word in the terms, -1 if none."""
    known = space["local"][at]
    use = known >= 0
    known, cell, n = known[use], cell[use], len(of_doc)
    least, norms_of, mass_of = (MASS * space["mass"]).astype(np.float32) * np.float32(1 - 1e-6), space["norms"], space["mass"]
    for begin in range(0, n, CELLS):
        end = min(n, begin + CELLS)
        upto = min(n, end + PASSAGES[-1] - 1)  # passages that begin before the end reach so far
        lo, hi = np.searchsorted(cell, [begin, upto])
        for size, dots, norms in passages_of(known[lo:hi], cell[lo:hi] - begin, upto - begin, space["products"], space["idf"], of_doc[begin:upto]):
            rows = np.flatnonzero((dots[: end - begin] >= least).any(1))
            own = dots[rows]
            good = (own >= MASS * mass_of) & (own >= COSINE * norms[rows][:, None] * norms_of)
            good |= own >= WHOLE * mass_of
            for r, item in zip(*(x.tolist() for x in np.nonzero(good))):
                yield size, begin + int(rows[r]), item


def hits_of(spark, block: list, pieces: list, all_terms: np.ndarray, all_df: np.ndarray, n: int, rank: int):
    """(a function of a text column that gives the hits of the items that hold these pieces, (place in the block, words); what was broadcast for it)."""
    terms = np.unique(np.concatenate([w for _, w in pieces]))
    df = all_df[np.searchsorted(all_terms, terms)]
    owners, piece_places = [k for k, _ in pieces], [places(w, terms) for _, w in pieces]
    idf = weights_of(piece_places, df, n)
    # only whole items are compared, and only those of these pieces are sent
    item_words, first = words_of(block[owners[0] : owners[-1] + 1]), owners[0]
    model = {
        "terms": terms, "ids": [int(i) for i, _ in block[first : owners[-1] + 1]], "words": [w.tolist() for w in item_words],
        "spaces": [([x - first for x in owners[k : k + rank]], space_of(spark, piece_places[k : k + rank], terms, idf, rank)) for k in range(0, len(pieces), rank)],
    }
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(HITS)
    def hits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        masks = [(bits(w), len(w), bits(w[-max(1, len(w) // 4) :]), max(1, len(w) // 4)) for w in m["words"]]
        for column in columns:
            parts = [found(m, masks, part.column(0)) for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], column=0)]
            yield pa.concat_arrays(parts) if parts else pa.array([], KIND)

    return hits.asNondeterministic(), shared  # so that it is run once a row, wherever its result is read


def found(m: dict, masks: list, column) -> pa.Array:
    """The hits of each text of a column."""
    words, counts = tokens(column)
    hits: list[dict[int, float]] = [{} for _ in counts]
    begins = np.cumsum(counts) - counts
    n_cells = -(-counts // CELL)
    of_doc = np.repeat(np.arange(len(counts)), n_cells)
    cell0 = np.cumsum(n_cells) - n_cells
    at = places(words, m["terms"])
    owner = np.repeat(np.arange(len(counts)), counts)
    cell = cell0[owner] + (np.arange(len(words)) - begins[owner]) // CELL
    tried: dict[tuple[int, int], int] = {}
    for owners, space in m["spaces"]:
        for size, c, k in candidates(space, at, cell, of_doc):
            item = owners[k]
            d = int(of_doc[c])
            mask, length, answer, n_answer = masks[item]
            a = int(begins[d]) + (c - int(cell0[d])) * CELL
            lo, hi = max(int(begins[d]), a - length), min(int(begins[d] + counts[d]), a + size * CELL + length)
            # regions of one item that begin within its length were seen already
            if tried.get((d, item), -1) >= hi and hits[d].get(item, 0) >= LCS:
                continue
            tried[d, item] = hi
            region = words[lo:hi].tolist()
            share = lcs(mask, length, region) / length
            if share >= LCS and lcs(answer, n_answer, region) / n_answer >= ANSWER:
                hits[d][item] = max(hits[d].get(item, 0.0), share)
    rows = []
    for h in hits:
        best: dict[int, float] = {}  # items of one id are one
        for k, share in h.items():
            best[m["ids"][k]] = max(share, best.get(m["ids"][k], 0.0))
        rows.append([{"item": i, "share": s} for i, s in sorted(best.items())])
    return pa.array(rows, KIND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a row of docs: id, contaminated, item_ids, lcs_share (of the best item; else 0)."""
    found = search(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text).alias("text")),
    )
    return found.select(
        F.col("id").alias(id_col),
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda x: x["item"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda x: x["share"])), F.lit(0.0)).alias("lcs_share"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, each by its own verdict, whatever its doc_id."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # whatever its columns are named
    found = search(docs.select(row, docs["text"].alias("text")), benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text"))
    return found.where(F.size("hits") == 0).select("row.*")


def op4_decontamination(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
