"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles (in the query every
shingle weighs 1, so similarity is Jaccard's). Over each element's region, weight
by rank, darts fall as a Poisson process that the element's hash alone decides.
The darts below the document's rank limit are thrown, each falls on a coordinate
of the signature, and the earliest of each coordinate stays. The limit is such
that k ln k + 2k darts are expected, so the work is linear in the shingles;
documents with an empty coordinate throw on with a higher limit.

Equal texts collapse to the smallest id before any join. Bands of four
coordinates are bucket keys; every bucket links its members to a leader rather
than to each other, links are checked against whole shingle sets, and linked
documents form classes. Buckets that still hold several classes choose another
leader. The documents of buckets that hold several classes even then meet once
more by a prefix filter: shingles are put in one order, those of a single class
first, then the rarer before the commoner, and two sets as alike as asked share
one of the first ``(1 - similarity) * size + 1``. Documents with a class's own
shingles in front thus meet nobody, however many share a passage. Those that do
meet are led once more, which settles two of a kind; where three or more still are
of several classes, they are compared whole in blocks of a bounded number of
documents and shingles, and a block gives back no more links than join its classes. No pairs within a
group are formed as rows, and a bucket of one class, however large, costs as many
pairs as members.

Classes come from contraction: every node takes the least of random ranks within
two links, so that chains of n links take about log n rounds and stars one, until
few enough links are left for one task.

Null, empty and blank texts have no shingles and are classes of their own, as
documents with a null id are. Texts of one to four words are one shingle. Rows
that share an id are one document. An empty table gives an empty result. Only id
and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, read, slices, small_batches, staged, utf8
from .shingles import MASK, mix, shingle_hashes, word_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
ROUNDS = 2
#: Documents and shingles in a block, and columns of the block's matrix that are multiplied at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 500_000, 4096
#: Links that one task takes, some 50 MB of them.
LINKS_AT_ONCE = 1_000_000
_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (sets by k) of weighted sets; set i has the next counts[i] elements.

    A coordinate is the hash of its earliest dart; sets without weight get zeros.
    """
    n = len(counts)
    out = np.zeros((n, k), dtype=np.uint64)
    owner = np.repeat(np.arange(n), counts)
    total = np.bincount(owner, weights=weights, minlength=n) if len(owner) else np.zeros(n)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        # the region of an element of weight w is cut at whole weights; the last piece is a part of a unit
        units = np.ceil(weights[mine]).astype(np.int64)
        which = np.repeat(mine, units)
        level = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
        seed = mix(elements[which] ^ (level.astype(np.uint64) * _A))
        part, doc = np.minimum(weights[which] - level, 1.0), owner[which]
        rank = np.zeros(len(which))
        darts, ranks, docs = [], [], []
        throw = 0
        while len(which):
            throw += 1
            dart = mix(seed + np.uint64(throw * int(_B) & MASK))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            on = rank < limit[doc]
            seed, part, doc, rank, dart, which = seed[on], part[on], doc[on], rank[on], dart[on], which[on]
            height = (mix(dart ^ _A) >> np.uint64(11)).astype(np.float64) / (1 << 53)
            hit = height < part
            darts.append(mix(dart ^ _B)[hit])
            ranks.append(rank[hit])
            docs.append(doc[hit])
        dart, rank, doc = np.concatenate(darts), np.concatenate(ranks), np.concatenate(docs)
        order = np.argsort(-rank, kind="stable")
        dart, doc = dart[order], doc[order]
        filled = np.zeros((n, k), dtype=bool)
        out[doc, (dart % np.uint64(k)).astype(np.int64)] = dart  # of darts on one coordinate the last, the earliest, stays
        filled[doc, (dart % np.uint64(k)).astype(np.int64)] = True
        todo &= ~filled.all(1)
        limit = limit * 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Hash of each band of coordinates with its number."""
    n, k = signature.shape
    parts = signature.reshape(n, bands, k // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _A), (n, bands)).copy()
    for j in range(k // bands):
        key = mix(key * _B + parts[:, :, j])
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, runs, bands) of (id, text): a hash of 128 bits of the shingles' order, their number, and the band keys."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            data, bounds = utf8(batch.column(1))
            words, counts = word_hashes(data, bounds)
            shingle, runs = shingle_hashes(words, counts, WIDTH)
            keys = band_keys(signatures(shingle, np.ones(len(shingle)), runs))
            owner = np.repeat(np.arange(len(counts)), counts)
            place = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
            same = []
            for salt in (_A, _B):  # sums of hashes of (word, place): equal for equal word sequences
                sums = np.zeros(len(counts), dtype=np.uint64)
                np.add.at(sums, owner, mix(words ^ mix(place * salt + salt)))
                same.append(sums.view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same[0]), pa.array(same[1]), pa.array(runs.astype(np.int64)), bands], names=["id", "h1", "h2", "runs", "bands"]
            )

    return docs.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, runs bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, members) of (id, text): the sorted hashes of the whole text's shingles."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            words, counts = word_hashes(*utf8(batch.column(1)))
            shingle, runs = shingle_hashes(words, counts, WIDTH)
            sets = [np.unique(x >> np.uint64(16)).tobytes() for x in np.split(shingle, np.cumsum(runs)[:-1])]
            # 48 bits of each hash
            sets = [np.frombuffer(x, dtype=np.uint8).reshape(-1, 8)[:, :6].tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "members"])

    return docs.mapInArrow(run, "id bigint, members binary")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity, with it."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, rows=500, column=2):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = len(x.as_buffer()) // 6, len(y.as_buffer()) // 6
                both = len(np.intersect1d(unpacked(x.as_buffer()), unpacked(y.as_buffer()), assume_unique=True)) if min(a, b) >= similarity * max(a, b) else 0
                keep.append(both / max(1, a + b - both))
            keep = np.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep)], names=["a", "b", "similarity"]).filter(pa.array(keep >= similarity))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similarity double")


def joined_up(batches):
    """(a, up) of links (a, b): up is the smallest node that is connected. All links, a bounded number, are here."""
    import pyarrow as pa

    pairs = [np.column_stack([b.column(k).to_numpy() for k in range(2)]) for b in batches if b.num_rows]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    up = np.arange(len(nodes))
    ends = ends.reshape(-1, 2)
    while True:
        # each end's root learns the least root that a link brings it, then all paths are shortened
        roots = up[ends]
        least = roots.min(1)
        if (roots == least[:, None]).all():
            break
        np.minimum.at(up, roots.ravel(), np.repeat(least, 2))
        while (up[up] != up).any():
            up = up[up]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["a", "up"])


def classes_of(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(id, class) of the links (a, b): class is the smallest id that is connected.

    While there are more than ``at_once`` links, a round gives the nodes that are
    left random ranks, contracts each to the lowest within two links, and drops
    links within one node: at least half of the nodes of a chain go in a round, all
    of a star. What is left then, a bounded number of links, one task settles. Nothing
    but counts comes to the driver; the rounds' maps, ever smaller, are put together
    at the end.
    """
    edges = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while edges.limit(at_once + 1).count() > at_once:

        def ranked(c: str, salt: int = len(rounds)):
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("r"), F.col(c).alias("i"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = staged(both.groupBy("a").agg(F.min(ranked("b")).alias("low")).select("a", F.least("low", ranked("a")).alias("low")), "near")
        far = both.join(near.select(F.col("a").alias("b"), F.col("low").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
        up = staged(far.join(near, "a").select("a", F.least("low", "far")["i"].alias("up")), "contracted")
        moved = edges
        for c in ("a", "b"):
            moved = moved.join(up.select(F.col("a").alias(c), F.col("up").alias(f"{c}_up")), c).drop(c).withColumnRenamed(f"{c}_up", c)
        moved = staged(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(edges)
        discard(near)
        edges = moved
        rounds.append(up)
    top = edges.coalesce(1).mapInArrow(joined_up, "a bigint, up bigint")
    if not rounds:
        out = staged(top.select(F.col("a").alias("id"), F.col("up").alias("class")), "classes")
        discard(edges)
        return out
    rounds.append(staged(top, "contracted"))
    found = rounds[-1]
    for step in reversed(rounds[:-1]):
        rest = found.select(F.col("a").alias("up"), F.col("up").alias("root"))
        found = step.join(rest, "up", "left").select("a", F.coalesce("root", "up").alias("up"))
    found = staged(found.select(F.col("a").alias("id"), F.col("up").alias("root")), "roots")
    least = staged(found.groupBy("root").agg(F.min("id").alias("class")), "least")
    out = staged(found.join(least, "root").select("id", "class"), "classes")
    for old in (edges, found, least, *rounds):
        discard(old)
    return out


def joining_links(ids: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int, float]]:
    """Links between documents of different classes, one for each two classes that they join, from whole sets."""
    m = len(ids)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, (_, column) = owner[shared], np.unique(column[shared], return_inverse=True)
    both = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        both += part @ part.T
    alike = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1)
    at = {c: c for c in classes.tolist()}

    def find(c):
        while at[c] != c:
            c = at[c]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu((alike >= similarity - 1e-6) & (classes[:, None] != classes[None, :])))):
        a, b = find(int(classes[i])), find(int(classes[j]))
        if a != b and both[i, j] >= similarity * (sizes[i] + sizes[j] - both[i, j]):
            at[max(a, b)] = min(a, b)
            links.append((int(ids[i]), int(ids[j]), float(alike[i, j])))
    return links


def unpacked(members) -> np.ndarray:
    """The hashes of a binary value of six bytes each."""
    return np.pad(np.frombuffer(members, dtype=np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()


def prefixes(crowd: DataFrame, sets: DataFrame, similarity: float, kept=staged) -> DataFrame:
    """(key, id, class, size) of crowd (id, class): the first shingles of each document, less those that no other class has.

    A document's size orders nothing away: of n shingles the first n - ceil(similarity * n) + 1 are kept.
    """

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, column=2):
            own = [unpacked(x.as_buffer()).view(np.int64) for x in batch.column(2)]
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(own))], names=["id", "class", "size", "key"]
            )

    each = crowd.join(sets, "id").select("id", "class", "members").mapInArrow(run, "id bigint, class bigint, size bigint, key bigint")
    # written, so that the join deals both sides and Spark can split a shingle that very many have
    each = kept(each, "shingles")
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key", "df")
    shared = each.join(kept(several, "shared"), "key")
    own = W.partitionBy("id")
    placed = shared.withColumn("place", F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "key")))
    # 1e-9: the product of the limit and a size is not to fall below a whole number by rounding
    return placed.where(F.col("place") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).select("key", "id", "class", "size")


def with_classes(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """buckets (band, id) with the class so far, which is the id itself where there is none."""
    return buckets.withColumn("class", F.col("id")) if labels is None else buckets.join(labels, "id", "left").withColumn("class", F.coalesce("class", "id"))


def crowded(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, class) of the documents of buckets that hold several classes; of two members the leader was one."""
    placed = with_classes(buckets, labels)
    mixed = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    return placed.join(mixed.where("n > 2 and low <> high").select("band"), "band").select("id", "class").distinct()


def block_links(keyed: DataFrame, labels: DataFrame | None, sets: DataFrame, similarity: float, kept=staged) -> DataFrame:
    """Links (a, b, similarity) between the classes of groups (key, id, size) of three or more that hold several; groups of the same members are taken once."""
    keyed = with_classes(keyed.select("key", "id", "size"), labels)
    several = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("class").alias("low"), F.max("class").alias("high"), F.sum(F.shiftright(F.xxhash64("id"), 8)).alias("s1"), F.bit_xor(F.xxhash64("id")).alias("s2"),
    )
    once = several.where("n > 2 and low <> high").groupBy("n", "s1", "s2").agg(F.min("key").alias("key"), F.max("total").alias("total"))
    once = once.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    each = keyed.join(kept(once, "groups"), "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "class").join(sets, "id")
    dealt = each.select("key", "x", "y", "id", "class", "members").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches):
        import pyarrow as pa

        def links(held):
            ids, classes = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (3, 4))
            found = joining_links(ids, classes, [unpacked(x.as_buffer()) for b in held for x in b.column(5)], similarity) if (classes != classes[0]).any() else []
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"]
            )

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                now = tuple(keys[begin])
                if held and now != last:
                    yield links(held)
                    held = []
                last = now
                held.append(batch.slice(begin, end - begin))
        if held:
            yield links(held)

    return dealt.mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One row a row of docs: id, class_id (the smallest id of its class), n_shingles."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        out = _classified(plain, similarity, rounds)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("runs").alias("n_shingles"))


def _classified(plain: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """(id, class_id, runs) of (id, text), written."""
    done: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(staged(df, name))
        return done[-1]

    rows = kept(sketch(plain), "sketches")
    some = rows.where("runs > 0 and id is not null")
    # rows that share an id are one document, and so are equal word sequences: the smallest id stands for them
    copies = kept(some.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "copies")
    members = kept(
        some.select("id", "h1", "h2").join(copies, ["h1", "h2"]).groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "members"
    )
    same_id = members.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    reps = members.where("id = rep").select("id")
    keyed = some.join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band")).distinct()
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    buckets = kept(keyed.join(shared, "band"), "buckets")
    involved = buckets.select("id").distinct()
    sets = kept(shingle_sets(plain.join(involved, "id", "left_semi")).groupBy("id").agg(F.max("members").alias("members")), "sets")
    links = kept(same_id.withColumn("similarity", F.lit(1.0)), "same")
    tried, labels = None, None

    def led(groups: DataFrame, key: str, salt: int) -> bool:
        """Links members of groups (key, id) to a leader where they hold several classes, once a pair; whether there was anything to try."""
        nonlocal links, tried, labels
        placed = with_classes(groups.select(key, "id"), labels)
        lead = placed.groupBy(key).agg(
            F.min_by(F.struct("id", "class"), F.xxhash64(F.lit(salt), "id") if salt else F.col("id")).alias("lead"), F.min("class").alias("low"), F.max("class").alias("high")
        )
        lead = lead.where("low <> high").select(key, F.col("lead.id").alias("leader"), F.col("lead.class").alias("leader_class"))
        pairs = placed.join(lead, key).where("class <> leader_class").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        pairs = kept(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            return False
        new = kept(checked(pairs, sets, similarity), "checked")
        links = links.unionByName(new)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if new.limit(1).count():
            labels = classes_of(links)
            done.append(labels)
        return True

    for k in range(rounds):
        if not led(buckets, "band", k):
            break
    crowd = kept(crowded(buckets, labels), "crowd")
    if crowd.limit(1).count():
        keyed = kept(prefixes(crowd, sets, similarity, kept), "prefixes")
        # most groups are of two, whom a leader settles
        led(keyed, "key", rounds)
        rest = kept(block_links(keyed, labels, sets, similarity, kept), "rest")
        if rest.limit(1).count():
            links = links.unionByName(rest)
            labels = classes_of(links)
            done.append(labels)
    if labels is None:
        labels = classes_of(links)
        done.append(labels)
    of_id = (
        members.select("id", "rep")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("id", F.coalesce("class", "rep").alias("class_id"))
    )
    out = rows.select("id", "runs").join(of_id, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "runs")
    out = staged(out, "near-classes")
    for old in done:  # band keys, sets and links are not read again
        discard(old)
    return out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those that are not the first of their class; of rows that share an id the one of the least text hash stays."""
    found = near_duplicates(docs, **options)
    gone = staged(found.where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    out = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = docs.where(docs["doc_id"].isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return out
    # only rows of such ids are dealt by id; equal texts of one id differ, if at all, in columns that nothing here reads
    again = staged(again.withColumnRenamed("doc_id", "__again"), "again")
    plain = out.join(again, out["doc_id"] == again["__again"], "left_anti")
    several = out.join(again, out["doc_id"] == again["__again"], "left_semi")
    row = F.struct(*[several[c] for c in out.columns])
    order = F.struct(F.xxhash64(F.coalesce(several["text"], F.lit(""))).alias("h"), F.to_json(row).alias("j"))
    one = several.groupBy(several["doc_id"].alias("__id")).agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return plain.unionByName(one)


def op10_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


#: All pairs that share a shingle, and the closure of those that are alike.
OP10_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, hash(w[i : i + 4]) g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w) + 1, 2)))) i from d)),
n as (select doc_id, count(*) n from s group by 1),
l as (select doc_id, list(g order by g) h from s group by 1),
c as (select min(doc_id) a, h from l group by h),
r as (select doc_id, g from s where doc_id in (select a from c)),
m as (select x.doc_id a, y.doc_id b, count(*) k from r x join r y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from m join n p on p.doc_id = a join n q on q.doc_id = b where k >= 0.8 * (p.n + q.n - k) union select a, doc_id from c join l using (h) where doc_id <> a),
e2 as (select a, b from e union select b, a from e),
reach as (select doc_id id, doc_id c from d union select id, b from reach join e2 on e2.a = reach.c)
select d.doc_id, min(c)::bigint class_id, greatest(len(w) - 4, least(len(w), 1))::bigint n_shingles from d join reach on id = doc_id group by d.doc_id, w
"""
